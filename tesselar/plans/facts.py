"""Extraction and facts over the events and conversations tables. Ids choose the cases, so that every rule fires."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselar.operators import enrich, extract, facts, gateway, merge, read, resolve, rollup, windows
from tesselar.plans.registry import Registry
from tesselar.sources.tables import table

R = Registry()
add = R.add

# What is appended to a message's own text, one for each kind of find.
TOLD = ["meu cnpj é 12.345.678/0001-95", "meu email é ana@firma.com.br", "quero cotar um frete", "sou motorista de carreta", "aqui é da Horizonte"]


def chats(spark, d):
    c = table(spark, d, "conversations")
    n = F.col("conv_id") + F.col("turn")
    text = F.concat("text", F.lit(" | "), F.element_at(F.array(*map(F.lit, TOLD)), (n % 5 + 1).cast("int")))
    other = F.concat("conv_id", F.when(n % 9 == 1, "@lid").otherwise("@s.whatsapp.net"))
    return c.select(
        F.lit("acc").alias("source_key"), F.concat_ws("-", "conv_id", "turn").alias("external_key"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("captured_at"),
        F.when(n % 7 == 0, "1@broadcast").when(n % 2 == 0, "99@g.us").otherwise(other).alias("remote_jid"),
        F.concat(F.lit("5"), "turn", F.lit("@s.whatsapp.net")).alias("participant"), (F.col("role") == "assistant").alias("from_me"), F.when(n % 4 == 1, "imageMessage").otherwise("conversation").alias("message_type"), text.alias("text"),
        F.when(n % 3 != 0, F.concat(F.lit("P"), "conv_id")).alias("push_name"),
    )


CHATS = """
SELECT conv_id || '-' || turn AS external_key, '+' || CASE WHEN n % 2 = 0 THEN '5' || turn ELSE conv_id::VARCHAR END AS subject, role = 'assistant' AS sent, n % 5 AS told, n % 2 = 1 AND n % 9 = 1 AS lid, n % 4 = 1 AS media,
  CASE WHEN n % 3 <> 0 THEN 'P' || conv_id END AS push_name FROM (SELECT *, conv_id + turn AS n FROM conversations) WHERE n % 7 <> 0
"""
FINDS = """
SELECT * FROM (VALUES (0, 'observation.recorded', 'mentioned_cnpj', '12.345.678/0001-95'), (0, 'identity.observed', 'cnpj', '12345678000195'), (1, 'observation.recorded', 'mentioned_email', 'ana@firma.com.br'),
  (1, 'identity.observed', 'email', 'ana@firma.com.br'), (2, 'observation.recorded', 'whatsapp_signals', NULL), (2, 'observation.recorded', 'relationship', 'lead'), (3, 'observation.recorded', 'whatsapp_signals', NULL),
  (3, 'observation.recorded', 'relationship', 'motorista'), (3, 'observation.recorded', 'policy.no_cold_outreach', 'true')) f(told, event_type, key, value)
"""


@add("r11_extracted_events", f"""
WITH c AS ({CHATS}), e AS (
  SELECT external_key, subject, 'interaction.message_' || CASE WHEN sent THEN 'sent' ELSE 'received' END AS event_type, NULL AS key, NULL AS value, CASE WHEN lid THEN 'whatsapp_lid' ELSE 'whatsapp_jid' END || '=' || subject AS identities, media AS has_media, push_name AS name FROM c
  UNION ALL SELECT external_key, subject, event_type, key, value, 'whatsapp_jid=' || subject || CASE WHEN event_type LIKE 'identity%' THEN ',' || key || '=' || value ELSE '' END, NULL, CASE WHEN event_type LIKE 'identity%' THEN push_name END FROM c JOIN ({FINDS}) USING (told) WHERE NOT sent
  UNION ALL SELECT external_key, subject, 'observation.recorded', 'affiliation', NULL, 'whatsapp_jid=' || subject, NULL, NULL FROM c WHERE sent OR told = 4)
SELECT external_key, subject, event_type, key, value, identities, has_media, name, CASE WHEN key IS NULL THEN 'msg:' || external_key WHEN key IN ('whatsapp_signals', 'affiliation') THEN NULL
  ELSE left(sha256(CASE WHEN event_type LIKE 'identity%' THEN 'identity' ELSE 'obs' END || '|' || subject || '|' || key || '|' || value || '|acc:' || external_key), 40) END AS event_id FROM e
""")  # fmt: skip
def r11(spark, d):
    e = extract.extract(chats(spark, d))
    whole = F.coalesce(F.col("key").isin("whatsapp_signals", "affiliation"), F.lit(False))
    who = F.array_join(F.transform("identities", lambda i: F.concat_ws("=", i["type"], i["value"])), ",")
    data = lambda path: F.get_json_object("payload", f"$.data.{path}")
    return e.select(
        "external_key", "subject", "event_type", "key", F.when(~whole, F.col("value")).alias("value"), who.alias("identities"), data("has_media").cast("boolean").alias("has_media"),
        F.coalesce(data("push_name"), data("name")).alias("name"), F.when(~whole, F.col("event_id")).alias("event_id"),
    )


@add("r11_handled_messages", f"""
WITH c AS ({CHATS}) SELECT 'msg:' || external_key AS event_id, CASE WHEN sent THEN 'message_sent' ELSE 'message_received' END AS interaction_type, CASE WHEN sent THEN 'outbound' ELSE 'inbound' END AS direction, external_key AS external_interaction_id, count(*) OVER (PARTITION BY subject, lid) AS of_identity FROM c
""")  # fmt: skip
def r11_handled(spark, d):
    """Extracted messages past the gateway: each is an interaction of the person of its sender's number."""
    known = spark.createDataFrame([], "experience_key string, experience_version string")
    told = extract.as_events(extract.extract(chats(spark, d)).where("event_type LIKE 'interaction%'"), F.xxhash64("external_key"))
    out = gateway.handle(told, gateway.held({}), known)
    i = out["interactions"]
    return i.join(i.groupBy("person").agg(F.count(F.lit(1)).alias("of_identity")), "person").select("event_id", "interaction_type", "direction", "external_interaction_id", "of_identity")


@add("r13_unmapped_fields", "SELECT left(sha256('unmapped|' || event_type || '|s:' || event_id), 40) AS event_id, 'unmapped.' || event_type AS key, 'k' AS fields FROM events")
def r13(spark, d):
    e = table(spark, d, "events").select(F.lit("s").alias("source_key"), F.col("event_id").alias("external_key"), F.col("event_type").alias("envelope_type"), F.col("props").alias("content"), F.col("ts").alias("captured_at"))
    return extract.unmapped(e).select("event_id", "key", F.array_join("fields", ",").alias("fields"))


def facts_of(spark, d):
    e, n, run = table(spark, d, "events"), F.col("event_id"), F.col("user_id").cast("string")
    kind = F.element_at(F.array(*map(F.lit, ["interaction.message_sent", "observation.recorded", "score.calculated", "experience.answer_recorded", "experience.identity_captured", "experience.run_completed"])), (n % 6 + 1).cast("int"))
    k = F.get_json_object("props", "$.k")
    data = F.concat(F.lit('{"key":"'), F.when(n % 5 != 0, F.concat(F.lit("k"), n % 4)).otherwise(""), F.lit('","value":'), F.when(n % 4 == 1, "null").otherwise(k), F.lit(',"score_key":"s","score_value":'), k, F.lit(',"score":'), k, F.lit(',"channel":"web","question_key":"'), F.when(n % 9 != 0, "q").otherwise(""), F.lit('"}'))
    return e.select(
        n.alias("event_id"), F.lit("s").alias("source"), kind.alias("event_type"), F.col("ts").alias("occurred_at"), n.alias("arrival"), data.alias("data"), F.when(n % 4 == 0, "chat").alias("channel"), F.lit(None).cast("string").alias("direction"),
        F.when(n % 8 != 3, run).alias("run_id"), F.when(n % 10 == 3, "other").otherwise("form").alias("experience_key"), F.lit("1").alias("experience_version"), F.when(n % 12 == 4, F.col("value")).alias("person_id"),
    )


FACTS = """
SELECT event_id AS n, ts, user_id::VARCHAR AS u, value, json_extract_string(props, '$.k') AS k, event_id % 6 AS kind, CASE WHEN event_id % 8 <> 3 THEN user_id::VARCHAR END AS run FROM events
"""
VALID = f"SELECT * FROM ({FACTS}) WHERE kind > 2 AND n % 10 <> 3 AND run IS NOT NULL AND NOT (kind = 3 AND n % 9 = 0)"


def experience(spark, d):
    known = spark.createDataFrame([("form", "1")], "experience_key string, experience_version string")
    return facts.valid_experience(facts_of(spark, d), known)


@add("r16_interactions", f"SELECT n AS event_id, 'message_sent' AS interaction_type, CASE WHEN n % 4 = 0 THEN 'chat' ELSE 'web' END AS channel, run AS external_interaction_id FROM ({FACTS}) WHERE kind = 0")
def r16(spark, d):
    return facts.interactions(facts_of(spark, d)).select("event_id", "interaction_type", "channel", "external_interaction_id")


@add("r17_observations", f"SELECT n AS event_id, 'k' || n % 4 AS key, CASE WHEN n % 4 = 1 THEN '{{}}' ELSE k END AS value, sha256('k' || n % 4 || ':' || CASE WHEN n % 4 = 1 THEN 'null' ELSE k END) AS value_hash, 'declared' AS source_kind FROM ({FACTS}) WHERE kind = 1 AND n % 5 <> 0")
def r17(spark, d):
    return facts.observations(facts_of(spark, d)).select("event_id", "key", "value", "value_hash", "source_kind")


@add("r19_scores", f"SELECT n AS event_id, 's' AS score_key, k::DOUBLE AS score_value, ts AS calculated_at FROM ({FACTS}) WHERE kind = 2")
def r19(spark, d):
    return facts.scores(facts_of(spark, d)).select("event_id", "score_key", "score_value", "calculated_at")


@add("r20_experience_errors", f"SELECT n AS event_id, CASE WHEN n % 10 = 3 THEN 'EXPERIENCE_NOT_FOUND' ELSE 'VALIDATION_ERROR' END AS error FROM ({FACTS}) WHERE kind > 2 AND (n % 10 = 3 OR run IS NULL OR (kind = 3 AND n % 9 = 0))")
def r20e(spark, d):
    return experience(spark, d).where("error IS NOT NULL").select("event_id", "error")


@add("r20_experience_runs", f"SELECT run AS run_id, CASE WHEN bool_or(kind = 5) THEN 'completed' ELSE 'started' END AS status, arg_min(ts, n) AS started_at, arg_max(ts, n) AS last_activity_at, arg_max(ts, n) FILTER (kind = 5) AS completed_at, arg_min(value, n) FILTER (kind = 4 AND n % 12 = 4) AS person_id, count(*) FILTER (kind = 3) AS answers, arg_max(k::DOUBLE, n) FILTER (kind = 5) AS score FROM ({VALID}) GROUP BY run")
def r20(spark, d):
    return facts.runs(experience(spark, d)).select("run_id", "status", "started_at", "last_activity_at", "completed_at", "person_id", "answers", "score")


@add("w3_answers_of_runs", f"SELECT run AS run_id, arg_max(CASE WHEN n % 4 <> 1 THEN k ELSE '{{}}' END, (ts, n)) AS value, count(*) AS total FROM ({VALID}) WHERE kind = 3 GROUP BY run")
def w3(spark, d):
    a = facts.answers(experience(spark, d).withColumn("occurred_at", F.struct("occurred_at", "arrival")))
    last = windows.first_of(a, [*facts.RUN, "question_key"], [F.desc("answered_at")])
    return last.join(a.groupBy("run_id").agg(F.count(F.lit(1)).alias("total")), "run_id").select("run_id", "value", "total")


@add("r1_persons", """
WITH RECURSIVE p AS (SELECT n, CASE WHEN strong < n THEN strong WHEN weak < n THEN weak ELSE n END AS up FROM (
  SELECT event_id AS n, min(event_id) OVER (PARTITION BY user_id) AS strong, min(event_id) OVER (PARTITION BY event_type, json_extract_string(props, '$.k')) AS weak FROM events)),
r AS (SELECT n, up FROM p UNION SELECT r.n, p.up FROM r JOIN p ON r.up = p.n WHERE p.up <> r.up)
SELECT n AS arrival, min(up) AS person, false AS conflict FROM r GROUP BY n
""")  # fmt: skip
def r1(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("source"), F.col("event_id").alias("arrival"), "user_id", F.get_json_object("props", "$.k").alias("k"))
    pairs = F.array(F.struct(F.lit("email").alias("type"), F.concat("user_id", F.lit("@x.co")).alias("value")), F.struct(F.lit("visitor").alias("type"), F.col("k").alias("value")))
    return resolve.persons(e.select("source", "arrival", F.inline(pairs)))


@add("k9_evidence_once", "SELECT min(event_id) AS event_id, user_id, event_type, json_extract_string(props, '$.k') AS value FROM events n WHERE event_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM events s WHERE s.event_id % 2 = 1 AND s.user_id = n.user_id AND s.event_type = n.event_type AND json_extract_string(s.props, '$.k') = json_extract_string(n.props, '$.k')) GROUP BY user_id, event_type, json_extract_string(props, '$.k')")
def k9(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").alias("value"))
    return merge.insert_new(e.where("event_id % 2 = 1"), e.where("event_id % 2 = 0"), ["user_id", "event_type", "value"], [F.col("event_id")])


@add("w5_first_of_batch", "SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def w5(spark, d):
    return windows.first_of(table(spark, d, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


@add("a10_action_status", "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS pending, max(o_orderdate) AS newest FROM orders")
def a10(spark, d):
    return table(spark, d, "orders").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderstatus") == "O").alias("pending"), F.max("o_orderdate").alias("newest"))


@add("a10_actions_by_status_and_type", "SELECT 'o_orderstatus' AS dimension, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def a10_by(spark, d):
    return rollup.by_status(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@add("l3_message_page", "SELECT conv_id, turn, role FROM conversations ORDER BY turn DESC, conv_id DESC LIMIT 500 OFFSET 20")
def l3(spark, d):
    return read.message_page(table(spark, d, "conversations"), "turn", ["conv_id"], limit=10_000, offset=20).select("conv_id", "turn", "role")


@add("l3_message_page_ascending", "SELECT conv_id, turn, role FROM conversations ORDER BY turn, conv_id LIMIT 1")
def l3_ascending(spark, d):
    return read.message_page(table(spark, d, "conversations"), "turn", ["conv_id"], descending=False, limit=-5).select("conv_id", "turn", "role")


@add("r10_conversations", """
SELECT conv_id, messages, CASE WHEN quote AND driver THEN 'cotacao/frete/carreta' WHEN quote THEN 'cotacao/frete' WHEN driver THEN 'motorista/carreta' ELSE 'geral' END AS subject,
  'Conversa com ' || messages || ' mensagem(s).' || CASE WHEN quote AND driver THEN ' Tópicos principais: cotacao, frete, motorista.' WHEN quote THEN ' Tópicos principais: cotacao, frete.' WHEN driver THEN ' Tópicos principais: motorista.' ELSE '' END AS summary
FROM (SELECT conv_id, count(*) AS messages, bool_or((conv_id + turn) % 5 = 2) AS quote, bool_or((conv_id + turn) % 5 = 3) AS driver FROM conversations GROUP BY conv_id)
""")  # fmt: skip
def r10(spark, d):
    c = chats(spark, d).select(F.split_part("external_key", F.lit("-"), F.lit(1)).alias("conversation_id"), F.lit("5").alias("contact_id"), F.split_part("external_key", F.lit("-"), F.lit(2)).cast("int").alias("position"), "text")
    return enrich.conversation_signals(c).select(F.col("conversation_id").cast("long").alias("conv_id"), "messages", "subject", "summary")


@add("p10_context_sections", """
SELECT user_id, section, rank, seen_at, id FROM (SELECT user_id, section, seen_at, id, row_number() OVER (PARTITION BY user_id, section ORDER BY seen_at DESC, id DESC) AS rank FROM (
  SELECT user_id, 'recent_interactions' AS section, ts AS seen_at, event_id AS id FROM events WHERE event_type = 'click' UNION ALL SELECT user_id, 'scores', ts, event_id FROM events WHERE value > 1)) WHERE rank <= 20
""")  # fmt: skip
def p10(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "value")
    sections = {"recent_interactions": e.where("event_type = 'click'"), "scores": e.where("value > 1"), "answers": e}
    found = read.context(sections, "user_id", "ts", "event_id", include="scores, recent_interactions, nothing")
    return found.select("user_id", "section", "rank", F.col("at").alias("seen_at"), F.get_json_object("item", "$.event_id").cast("long").alias("id"))
