"""Joins on time, admission, grouping sets and windows over the driver tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselar.operators import admission, asof, summaries
from tesselar.plans.registry import Registry
from tesselar.sources.tables import table
from tesselar.streaming import state

R = Registry()
add = R.add


@add("asof_score_at_interaction", """
SELECT i.event_id, s.event_id AS score_id, s.value AS score FROM (SELECT * FROM events WHERE event_type = 'click') i
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) s ON i.user_id = s.user_id AND i.ts >= s.ts
""")  # fmt: skip
def as_of(spark, d):
    e = table(spark, d, "events")
    scores = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("since"), F.col("event_id").alias("score_id"), F.col("value").alias("score"))
    return asof.as_of(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), scores, ["user_id"], "ts", "since", "score_id").select("event_id", "score_id", "score")


@add("within_an_hour", "SELECT e.event_id, o.event_id AS other_id FROM events e JOIN events o ON e.user_id = o.user_id AND o.ts BETWEEN e.ts - INTERVAL 30 MINUTE AND e.ts + INTERVAL 60 MINUTE WHERE e.event_type = 'error' AND o.event_type = 'click'")
def within(spark, d):
    e = table(spark, d, "events")
    others = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("other_id"), F.col("ts").alias("other_at"))
    return asof.within(e.where("event_type = 'error'").select("event_id", "user_id", "ts"), others, ["user_id"], "ts", "other_at", 1800, 3600).select("event_id", "other_id")


@add("admission_sliding_limit", """
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t0, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT user_id, event_id, n, [t0] AS held, true AS admitted FROM e WHERE n = 1
  UNION ALL
  SELECT user_id, event_id, n, CASE WHEN len(kept) < 3 THEN list_append(kept, t0) ELSE kept END, len(kept) < 3 FROM (
    SELECT e.user_id, e.event_id, e.n, e.t0, list_filter(w.held, lambda t: t > e.t0 - 86400000000) AS kept FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1))
SELECT event_id, admitted FROM w
""")  # fmt: skip
def admitted(spark, d):
    return admission.admitted(table(spark, d, "events").select("event_id", "user_id", "ts"), ["user_id"], "ts", [F.col("event_id")], 3, 86_400).select("event_id", "admitted")


@add("a4_a10_grouping_sets", """
SELECT CASE grouping(o_orderstatus, o_orderpriority) WHEN 0 THEN 'o_orderstatus,o_orderpriority' WHEN 1 THEN 'o_orderstatus' WHEN 2 THEN 'o_orderpriority' ELSE 'all' END AS dimensions, o_orderstatus, o_orderpriority,
  count(*) AS n, count(o_clerk) AS done, max(o_orderdate) AS newest
FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS o_clerk FROM orders) GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), (o_orderpriority), ())
""")  # fmt: skip
def grouping_sets(spark, d):
    o = table(spark, d, "orders").withColumn("o_clerk", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")))
    sets = [["o_orderstatus", "o_orderpriority"], ["o_orderstatus"], ["o_orderpriority"], []]
    return summaries.by_sets(o, sets, {"n": F.count(F.lit(1)), "done": F.count("o_clerk"), "newest": F.max("o_orderdate")})


@add("a11_health_windows", """
SELECT event_type AS source, from_at, from_at + INTERVAL 24 HOUR AS to_at, count(*) AS received, count(*) FILTER (value > 90) AS failed FROM (
  SELECT *, unnest(generate_series(time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 18 HOUR, time_bucket(INTERVAL 6 HOUR, ts), INTERVAL 6 HOUR)) AS from_at FROM events) GROUP BY 1, 2, 3
""")  # fmt: skip
def health_windows(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("source"), F.when(F.col("value") > 90, "failed").otherwise("processed").alias("status"), F.col("ts").alias("at"))
    return state.source_health(e, "at", "24 hours", "6 hours").drop("last_at")


@add("user_sessions", """
SELECT user_id, min(ts) AS from_at, max(ts) + INTERVAL 6 HOUR AS to_at, count(*) AS events FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (
    SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, session
""")  # fmt: skip
def user_sessions(spark, d):
    return state.sessions(table(spark, d, "events"), "user_id", "ts", "6 hours")


@add("daily_sketches_counted", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def sketches(spark, d):
    daily = summaries.daily_sketches(table(spark, d, "events"), ["event_type"], "ts", "user_id", "value")
    return summaries.merged_sketches(daily, ["event_type"], [0.5]).select("event_type", "n")
