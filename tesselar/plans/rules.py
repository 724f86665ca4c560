"""The rule engine over the driver tables: a vocabulary of frequent words stands for the intents, so that rules fire."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselar.functions import text as T
from tesselar.operators import actions, enrich
from tesselar.plans.registry import Registry
from tesselar.sources.tables import table

R = Registry()
add = R.add
WORDS = {"cotacao": ["the", "der"], "frete": ["que", "con"], "reclamacao": ["für"], "atraso": ["worthless", "idiot"], "valor": ["reon"]}


def _pattern(words):
    return r"(?i)(^|[^\p{L}\p{N}_])(" + "|".join(words) + r")($|[^\p{L}\p{N}_])"


CASES = ", ".join(f"CASE WHEN regexp_matches(text, '{_pattern(w)}') THEN '{k}' END" for k, w in WORDS.items())
FOUND = f"SELECT doc_id, n_chars, list_filter([{CASES}], lambda x: x IS NOT NULL) AS i FROM documents"


@add("x6_intents", f"SELECT doc_id, array_to_string(i, ',') AS intents FROM ({FOUND})")
def x6(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.intents(F.col("text"), WORDS), ",").alias("intents"))


@add("h9_scores", f"SELECT doc_id, least(100, CASE WHEN list_contains(i, 'cotacao') THEN 20 ELSE 0 END + CASE WHEN list_contains(i, 'frete') THEN 20 ELSE 0 END + CASE WHEN n_chars > 50 THEN 15 ELSE 0 END) AS opportunity, CASE WHEN list_contains(i, 'reclamacao') THEN 20 ELSE 0 END + CASE WHEN list_contains(i, 'atraso') THEN 15 ELSE 0 END AS risk FROM ({FOUND})")
def h9(spark, d):
    none = F.array().cast("array<string>")
    rows = table(spark, d, "documents").select("doc_id", "n_chars", T.intents(F.col("text"), WORDS).alias("i"))
    return rows.select("doc_id", T.opportunity_score(F.col("i"), none, F.col("n_chars"), none, F.lit(False)).alias("opportunity"), T.risk_score(F.col("i")).alias("risk"))


@add("x4_emails", "SELECT doc_id, unnest(regexp_extract_all(text, '\\b[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}\\b')) AS email FROM documents")
def x4(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(T.emails(F.col("text"))).alias("email"))


@add("r3_kinds", f"SELECT doc_id, CASE WHEN len(list_intersect(i, ['cotacao', 'valor', 'frete'])) > 0 THEN 'lead' ELSE 'desconhecido' END AS kind FROM ({FOUND})")
def r3(spark, d):
    v = enrich.Vocabulary(vehicle_types=["qqq"], vehicle_bodies=["qqq"], intents=WORDS, roles={"lead": ["qqq"]})
    rows = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("contact_id"), "text", F.lit(1).alias("messages"), F.lit(1).alias("conversations"))
    return enrich.signals(rows, "text", v).select("doc_id", enrich.kind().alias("kind"))


@add("r9_actions", """
WITH c AS (SELECT c_custkey AS contact_id, c_acctbal / 100 AS score, CASE c_mktsegment WHEN 'BUILDING' THEN 'motorista' WHEN 'MACHINERY' THEN 'lead' ELSE 'desconhecido' END AS kind, c_nationkey * 10 AS messages FROM customer),
o AS (SELECT o_custkey AS contact_id, min(o_orderkey) AS oid, arg_min(o_totalprice / 10000, o_orderkey) AS s FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
e AS (SELECT DISTINCT o_custkey AS contact_id FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT contact_id, 'followup_cotacao' AS action_type, round(greatest(s, score), 4) AS priority_score, oid AS opportunity_id FROM c JOIN o USING (contact_id)
UNION ALL SELECT contact_id, 'qualificar_motorista', round(least(100, score + least(20, floor(messages / 10))), 4), NULL FROM c WHERE kind = 'motorista'
UNION ALL SELECT contact_id, 'pedir_cnpj', round(score, 4), NULL FROM c WHERE kind = 'lead' AND contact_id NOT IN (SELECT contact_id FROM e)
UNION ALL SELECT contact_id, 'completar_dados_comerciais', round(score, 4), NULL FROM c WHERE kind = 'lead'
UNION ALL SELECT contact_id, 'revisar_alto_potencial', round(score, 4), NULL FROM c WHERE score >= 80
""")
def r9(spark, d):
    k = F.col("c_mktsegment")
    contacts = table(spark, d, "customer").select(F.col("c_custkey").alias("contact_id"), F.when(k == "BUILDING", "motorista").when(k == "MACHINERY", "lead").otherwise("desconhecido").alias("kind"), F.array().cast("array<string>").alias("tags"), (F.col("c_acctbal") / 100).alias("score"), (F.col("c_nationkey") * 10).alias("messages"), F.lit("x").alias("summary"), F.lit(None).cast("timestamp_ntz").alias("last_at"))
    o = table(spark, d, "orders")
    opps = o.select(F.col("o_custkey").alias("contact_id"), F.col("o_orderkey").alias("opportunity_id"), F.lit("cotacao_frete").alias("opportunity_type"), F.when(F.col("o_orderstatus") == "O", "nova").otherwise("x").alias("status"), (F.col("o_totalprice") / 10000).alias("score"))
    seen = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("contact_id"), F.lit("CNPJ").alias("evidence_type"))
    made = actions.actions(contacts, opps, seen, F.lit("2024-06-01").cast("timestamp_ntz"))
    return made.select("contact_id", "action_type", F.round("priority_score", 4).alias("priority_score"), "opportunity_id")
