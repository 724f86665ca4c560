"""Ingestion over the events table: a person and type stand for an event's key, so keys repeat."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselar.operators import gateway, ingest
from tesselar.plans.registry import Registry
from tesselar.sources.tables import table

R = Registry()
add = R.add


def arriving(spark, d):
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_type").alias("source"), (F.col("user_id") * 100 + k).cast("string").alias("event_id"), F.when(F.col("event_id") % 11 == 0, "other.x").otherwise("score.set").alias("event_type"),
        F.when(F.col("event_id") % 13 == 0, "2.0").otherwise("1.0").alias("schema_version"), F.format_string('{"k":%d,"v":%d}', k, F.col("event_id") % 2).alias("payload"), F.col("event_id").alias("arrival"),
    )


DECIDED = """
SELECT arrival, CASE WHEN NOT ok THEN 'SCHEMA_UNSUPPORTED' WHEN first_content <> content THEN 'EVENT_ID_CONFLICT' WHEN kind <> 'score.set' THEN 'VALIDATION_ERROR' WHEN nth = 1 THEN 'accepted' ELSE 'duplicate' END AS decision, source, key FROM (
  SELECT *, row_number() OVER w AS nth, first_value(content) OVER w AS first_content FROM (
    SELECT event_id AS arrival, event_type AS source, user_id * 100 + json_extract_string(props, '$.k')::INT AS key, event_id % 13 <> 0 AS ok, CASE WHEN event_id % 11 = 0 THEN 'other.x' ELSE 'score.set' END AS kind, kind || (event_id % 2) AS content FROM events)
  WINDOW w AS (PARTITION BY source, key, ok ORDER BY arrival))
"""


@add("r22_ingestion_decisions", f"SELECT arrival, decision FROM ({DECIDED})")
def r22(spark, d):
    return ingest.decide(arriving(spark, d)).select("arrival", "decision")


@add("k17_conflict_cases", f"SELECT source, key::VARCHAR AS event_id, count(*) AS seen FROM ({DECIDED}) WHERE decision = 'EVENT_ID_CONFLICT' GROUP BY ALL")
def k17(spark, d):
    return ingest.cases(ingest.decide(arriving(spark, d))).select("source", "event_id", "seen")


@add("e1_edges", "SELECT nullif(user_id, 7) AS person, event_type AS company, min(ts) AS first_seen_at, max(ts) AS last_seen_at FROM events GROUP BY 1, 2")
def e1(spark, d):
    e = table(spark, d, "events").select(F.nullif("user_id", F.lit(7)).alias("person"), F.col("event_type").alias("company"), "ts")
    return ingest.edges(e, ["person", "company"], "ts")


# Events of six families for the gateway: a user's e-mail stands for the person, a domain for the company of every third event. Every tenth event is of
# an experience that is not known, every 25th of the second half shows the e-mails of two users.
MIXED = """
m AS (SELECT event_id AS n, user_id AS u, ts, (SELECT max(event_id) FROM events) AS most, json_extract_string(props, '$.k') AS k, event_id % 5 AS kind, event_id % 3 = 0 AS firm FROM events),
users AS (SELECT u, min(n) AS first FROM m WHERE kind < 3 GROUP BY u),
j AS (SELECT m.*, a.first AS person, kind = 0 AND n % 25 = 0 AND n > most / 2 AND b.first IS NOT NULL AS conflict, kind = 3 AND n % 10 = 3 AS lost FROM m LEFT JOIN users a ON a.u = m.u LEFT JOIN users b ON b.u = m.u + 1),
d AS (SELECT u % 40 AS d, min(n) AS company FROM j WHERE firm AND NOT conflict AND kind <> 3 GROUP BY 1)
"""


def mixed(spark, d):
    e, n, u = table(spark, d, "events"), F.col("event_id"), F.col("user_id")
    most = e.agg(F.max("event_id")).first()[0] or 0
    kind = F.element_at(F.array(*map(F.lit, ["interaction.call", "observation.recorded", "score.calculated", "experience.answer_recorded", "company.observed"])), (n % 5 + 1).cast("int"))
    mail = lambda c: F.struct(F.lit("email").alias("type"), F.concat(c, F.lit("@x.co")).alias("value"))
    k = F.get_json_object("props", "$.k")
    parts = F.struct(
        F.struct(F.when((n % 25 == 0) & (n > most / 2), F.array(mail(u), mail(u + 1))).otherwise(F.array(mail(u))).alias("identities")).alias("subject"),
        F.when(n % 3 == 0, F.struct(F.concat(F.lit("d"), u % 40, F.lit(".com")).alias("domain"))).alias("company"),
        F.struct(F.when(n % 10 == 3, "other").otherwise("form").alias("experience_key"), F.lit("1").alias("experience_version"), u.cast("string").alias("external_run_id")).alias("context"),
        F.struct(F.lit("k").alias("key"), k.alias("value"), F.lit("s").alias("score_key"), k.cast("int").alias("score_value"), F.lit("q").alias("question_key")).alias("data"),
    )
    return e.select(F.lit("s").alias("source"), n.cast("string").alias("event_id"), kind.alias("event_type"), F.lit("1.0").alias("schema_version"), F.col("ts").alias("occurred_at"), F.to_json(parts).alias("payload"), n.alias("arrival"))


def handled(spark, d):
    return gateway.handle(mixed(spark, d), gateway.held({}), spark.createDataFrame([("form", "1")], "experience_key string, experience_version string"))


@add("r14_gateway_log", f"WITH {MIXED} SELECT n AS arrival, CASE WHEN conflict THEN 'conflict' WHEN lost THEN 'failed' ELSE 'processed' END AS status, CASE WHEN conflict OR lost THEN 1 ELSE 0 END AS retry_count, CASE WHEN conflict THEN 'IDENTITY_CONFLICT' WHEN lost THEN 'EXPERIENCE_NOT_FOUND' END AS error_code FROM j")
def r14_log(spark, d):
    return handled(spark, d)["log"].select("arrival", "status", "retry_count", "error_code")


@add("r14_gateway_facts", f"""
WITH {MIXED} SELECT n AS arrival, CASE kind WHEN 0 THEN 'interaction' WHEN 2 THEN 'score' ELSE 'observation' END AS fact, CASE WHEN kind <> 4 THEN person END AS person, CASE WHEN firm THEN company END AS company, CASE kind WHEN 0 THEN 'call' WHEN 2 THEN k ELSE '"' || k || '"' END AS value
FROM j LEFT JOIN d ON d.d = u % 40 WHERE NOT conflict AND (kind < 3 OR (kind = 4 AND firm))
""")  # fmt: skip
def r14_facts(spark, d):
    out = handled(spark, d)
    told = [out["interactions"].withColumn("value", F.col("interaction_type")), out["observations"], out["scores"].withColumn("value", F.col("score_value").cast("int").cast("string"))]
    rows = [df.select("arrival", F.lit(x).alias("fact"), "person", "company", "value") for df, x in zip(told, ("interaction", "observation", "score"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@add("r14_gateway_cases", f"WITH {MIXED} SELECT n::VARCHAR AS event_id, CASE WHEN conflict THEN 'identity_conflict' ELSE 'ingestion_error' END AS case_type, CASE WHEN conflict THEN 'high' ELSE 'medium' END AS severity FROM j WHERE conflict OR lost")
def r14_cases(spark, d):
    return handled(spark, d)["cases"].select("event_id", "case_type", "severity")


@add("r14_gateway_runs", f"WITH {MIXED} SELECT u::VARCHAR AS run_id, min_by(ts, n) AS started_at, max_by(ts, n) AS last_activity_at, count(*) AS answers FROM j WHERE kind = 3 AND NOT lost GROUP BY u")
def r14_runs(spark, d):
    return handled(spark, d)["runs"].select("run_id", "started_at", "last_activity_at", "answers")
