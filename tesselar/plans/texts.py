"""The text rules over whole messages: words of the rules are appended to the table's own texts, so that every rule fires somewhere."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselar.functions import text as T
from tesselar.operators import enrich, rollup
from tesselar.plans.registry import Registry
from tesselar.sources.tables import table

R = Registry()
add = R.add

# What is appended to a text, by conversation and turn.
TOLD = [
    "", "meu cnpj é 12.345.678/0001-95", "cpf 123.456.789-09 placa abc-1d23", "preciso cotar um frete de São Paulo para Curitiba", "sou motorista de carreta baú", "aqui é da Horizonte",
    "vi em www.fretebras.com.br/x1", "houve atraso e reclamação", "fale com ana@firma.com.br",
]
N = "(conv_id + turn) % 9"
ROWS = f"SELECT conv_id, turn, {N} AS n, text || ' | ' || {TOLD!r}[{N} + 1] AS told FROM conversations"


def rows(spark, d):
    n = (F.col("conv_id") + F.col("turn")) % 9
    told = F.concat("text", F.lit(" | "), F.element_at(F.array(*map(F.lit, TOLD)), (n + 1).cast("int")))
    return table(spark, d, "conversations").select("conv_id", "turn", n.alias("n"), told.alias("told"))


def _row_of(name, sql, values):
    """Queries that show lists as text, a row for each message."""

    @add(name, f"SELECT conv_id, turn, {sql} FROM ({ROWS})")
    def query(spark, d):
        return rows(spark, d).select("conv_id", "turn", *[(F.array_join(c, ",") if n in LISTS else c).alias(n) for n, c in values(F.col("told")).items()])

    return query


LISTS = {"cnpjs", "cpfs", "plates", "types", "bodies", "routes", "mentions", "roles", "intents", "own"}
_row_of(
    "x1_x2_x3_documents",
    "array_to_string(regexp_extract_all(told, '\\b\\d{2}[.\\s]?\\d{3}[.\\s]?\\d{3}[/\\s]?\\d{4}[-\\s]?\\d{2}\\b'), ',') AS cnpjs, array_to_string(regexp_extract_all(told, '\\b\\d{3}[.\\s]?\\d{3}[.\\s]?\\d{3}[-\\s]?\\d{2}\\b'), ',') AS cpfs, array_to_string(regexp_extract_all(told, '(?i)\\b[A-Z]{3}[-\\s]?\\d[A-Z0-9]\\d{2}\\b'), ',') AS plates",
    lambda t: {"cnpjs": T.cnpjs(t), "cpfs": T.cpfs(t), "plates": T.plates(t)},
)
_row_of("x5_vehicles", "CASE WHEN n = 4 THEN 'carreta' ELSE '' END AS types, CASE WHEN n = 4 THEN 'baú' ELSE '' END AS bodies", lambda t: {"types": T.keywords(t, ["carreta", "truck"]), "bodies": T.keywords(t, ["baú", "grade baixa"])})
_row_of("x7_routes", "CASE WHEN n = 3 THEN 'São Paulo → Curitiba' ELSE '' END AS routes", lambda t: {"routes": T.routes(F.element_at(F.split(t, r" \| "), -1))})
_row_of("x8_platform", "CASE WHEN n = 6 THEN 'www.fretebras.com.br/x1' ELSE '' END AS mentions", lambda t: {"mentions": T.platform_mentions(t)})
_row_of("x9_roles", "CASE WHEN conv_id % 10 = 0 THEN 'grupo' WHEN n = 4 THEN 'motorista' ELSE '' END AS roles", lambda t: {"roles": T.roles(t, F.when(F.col("conv_id") % 10 == 0, "group:1").otherwise("5"), {"motorista": ["motorista", "chofer"]})})
_row_of("x11_x12_self_declared", "CASE WHEN n = 1 THEN '12.345.678/0001-95' ELSE '' END AS own, CASE WHEN n = 5 THEN 'Horizonte' END AS affiliation", lambda t: {"own": T.self_declared_cnpjs(F.element_at(F.split(t, r" \| "), -1)), "affiliation": T.affiliation(F.element_at(F.split(t, r" \| "), -1))})

# A contact is a conversation; its rules see its own texts and the appended words, of the ten first and fifty last messages.
PICKED = f"(SELECT conv_id, turn, {N} AS n FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 10 OR row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 50)"
SIGNS = f"""
SELECT conv_id, any_value(messages) AS messages, bool_or(n = 1) AS cnpj, bool_or(n = 2) AS cpf, bool_or(n = 3) AS quote, bool_or(n = 4) AS driver, bool_or(n = 6) AS platform, bool_or(n = 7) AS complaint, bool_or(n = 8) AS mail, conv_id % 11 = 0 AS grp
FROM {PICKED} JOIN (SELECT conv_id, count(*) AS messages FROM conversations GROUP BY conv_id) USING (conv_id) GROUP BY conv_id
"""
KIND = "CASE WHEN grp THEN 'grupo' WHEN messages >= 20 AND quote THEN 'cliente' WHEN driver OR platform THEN 'motorista' WHEN quote THEN 'lead' ELSE 'desconhecido' END"
SETTLED = "CASE WHEN platform AND NOT grp AND now IN ('desconhecido', 'lead', 'grupo') THEN 'motorista' WHEN list_position(ranks, kind) >= list_position(ranks, now) THEN kind ELSE now END"
SETTLED = f"(SELECT *, {SETTLED} AS settled FROM (SELECT *, {KIND} AS kind, CASE WHEN conv_id % 7 = 0 THEN 'cliente' WHEN conv_id % 7 = 1 THEN 'lead' ELSE 'desconhecido' END AS now, ['desconhecido', 'lead', 'fornecedor', 'motorista', 'cliente', 'grupo'] AS ranks FROM ({SIGNS})))"


def contacts(spark, d):
    """Contacts with their messages and the appended words as their text; conversations three or more so that regular ones are found."""
    c = rows(spark, d)
    every = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages")).join(rollup.corpus(c, "conv_id", "turn", "told"), "conv_id", "left")
    i = F.col("conv_id")
    return every.select(
        "conv_id", F.when(i % 11 == 0, F.concat(F.lit("group:"), i)).otherwise(i.cast("string")).alias("contact_id"), F.coalesce("corpus", F.lit("")).alias("corpus"), "messages", F.lit(3).alias("conversations"), (i % 2 + 1).alias("accounts"),
        F.when(i % 7 == 0, "cliente").when(i % 7 == 1, "lead").otherwise("desconhecido").alias("current_kind"), F.array(F.lit("vip")).alias("old_tags"),
        F.when(i % 5 != 0, F.lit("2024-01-01")).alias("first_at"), F.lit("2024-02-01").alias("last_at"),
    )


@add("r3_r4_kinds", f"SELECT conv_id, settled AS kind FROM {SETTLED}")
def r4(spark, d):
    return enrich.enrich(contacts(spark, d)).select("conv_id", "kind")


INTENTS = "list_filter([CASE WHEN quote THEN 'cotacao' END, CASE WHEN quote THEN 'frete' END, CASE WHEN driver THEN 'motorista' END, CASE WHEN complaint THEN 'reclamacao' END, CASE WHEN complaint THEN 'atraso' END], lambda x: x IS NOT NULL)"
ROLES = "list_filter([CASE WHEN grp THEN 'grupo' END, CASE WHEN NOT grp AND driver THEN 'motorista' END], lambda x: x IS NOT NULL)"


@add("r5_tags", f"""
SELECT conv_id, array_to_string(list_sort(list_distinct(list_filter(['vip', 'whatsapp', CASE WHEN grp THEN 'grupo' END, CASE WHEN platform THEN 'fretebras' END, CASE WHEN platform THEN 'motorista' END, CASE WHEN driver THEN 'veiculo' END,
  CASE WHEN cnpj OR cpf THEN 'documento' END, CASE WHEN cnpj THEN 'cnpj' END, CASE WHEN cpf THEN 'cpf' END, CASE WHEN cpf THEN 'placa' END, CASE WHEN conv_id % 2 = 1 THEN 'multicanal' END,
  CASE WHEN settled NOT IN ('desconhecido', 'grupo') THEN settled END, CASE WHEN settled = 'cliente' THEN 'cliente_potencial' END, CASE WHEN quote THEN 'cotacao' END, CASE WHEN quote THEN 'frete' END, CASE WHEN driver THEN 'motorista' END,
  CASE WHEN complaint THEN 'reclamacao' END, CASE WHEN complaint THEN 'atraso' END, CASE WHEN quote AND NOT grp THEN NULL END], lambda x: x IS NOT NULL))), ',') AS tags FROM {SETTLED}
""")  # fmt: skip
def r5(spark, d):
    # the role of a lead comes with other words, so it is left to the unit tests
    v = enrich.Vocabulary(roles={"motorista": ["motorista"]})
    return enrich.enrich(contacts(spark, d), v).select("conv_id", F.array_join("tags", ",").alias("tags"))


@add("r6_evidence", f"""
SELECT conv_id, type, value, count(*) AS n FROM (
  SELECT conv_id, 'cnpj' AS type, '12.345.678/0001-95' AS value FROM {PICKED} WHERE n = 1
  UNION ALL SELECT conv_id, 'cpf', '123.456.789-09' FROM {PICKED} WHERE n = 2 UNION ALL SELECT conv_id, 'placa', 'abc-1d23' FROM {PICKED} WHERE n = 2
  UNION ALL SELECT conv_id, 'email', 'ana@firma.com.br' FROM {PICKED} WHERE n = 8
  UNION ALL SELECT conv_id, 'vehicle_type', 'carreta' FROM {SETTLED} WHERE driver UNION ALL SELECT conv_id, 'vehicle_body', 'baú' FROM {SETTLED} WHERE driver
  UNION ALL SELECT conv_id, 'intent', unnest({INTENTS}) FROM {SETTLED} UNION ALL SELECT conv_id, 'role', unnest({ROLES}) FROM {SETTLED}
  UNION ALL SELECT conv_id, 'tipo_relacionamento', settled FROM {SETTLED} WHERE settled <> 'desconhecido'
  UNION ALL SELECT conv_id, 'source_domain', 'fretebras' FROM {SETTLED} WHERE platform UNION ALL SELECT conv_id, 'role', 'motorista' FROM {SETTLED} WHERE platform) GROUP BY ALL
""")
def r6(spark, d):
    v = enrich.Vocabulary(roles={"motorista": ["motorista"]})
    # routes run into the words of the next turn, so they are compared by message in x7_routes
    found = enrich.enrich(contacts(spark, d), v)
    ids = found.select("conv_id", "contact_id")
    e = enrich.evidence(found).where("evidence_type <> 'route'").join(ids, "contact_id")
    return e.groupBy("conv_id", F.col("evidence_type").alias("type"), F.col("evidence_value").alias("value")).agg(F.count(F.lit(1)).alias("n"))


@add("r7_timeline", f"""
SELECT conv_id, unnest(list_filter([CASE WHEN conv_id % 5 <> 0 THEN 'first_contact' END, 'last_contact', CASE WHEN quote THEN 'quote_detected' END, CASE WHEN driver THEN 'vehicle_detected' END, CASE WHEN cnpj OR cpf THEN 'document_detected' END,
  CASE WHEN complaint THEN 'complaint_detected' END, CASE WHEN conv_id % 2 = 1 THEN 'multichannel_detected' END, CASE WHEN platform THEN 'fretebras_detected' END], lambda x: x IS NOT NULL)) AS event_type FROM {SETTLED}
""")
def r7(spark, d):
    found = enrich.enrich(contacts(spark, d))
    return enrich.timeline(found).join(found.select("conv_id", "contact_id"), "contact_id").select("conv_id", "event_type")


@add("r8_opportunities", f"SELECT conv_id, unnest(list_filter([CASE WHEN quote THEN 'cotacao_frete' END, CASE WHEN settled = 'motorista' THEN 'motorista_parceiro' END, CASE WHEN settled = 'fornecedor' THEN 'fornecedor_potencial' END], lambda x: x IS NOT NULL)) AS opportunity_type FROM {SETTLED}")
def r8(spark, d):
    found = enrich.enrich(contacts(spark, d))
    return enrich.opportunities(found).join(found.select("conv_id", "contact_id"), "contact_id").select("conv_id", "opportunity_type")
