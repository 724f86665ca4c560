"""Reads, roll-ups, windows and merges over the driver tables, each with its SQL.

Tables stand for the engine's: customer for contacts, orders for opportunities and actions, events for
interactions and scores, conversations for messages, nation for the dictionary of sources.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselar.functions import keys as K
from tesselar.operators import merge, read, reports, rollup, windows
from tesselar.plans.registry import Registry
from tesselar.sources import tables
from tesselar.sources.tables import table

R = Registry()
add = R.add
NOW = "2024-01-30 12:00:00"


# the two sides of these cover the table: what was there before SPLIT, and what came since
SPLIT = "2024-01-02 00:00:00"


def sides(spark, d):
    e, at = table(spark, d, "events"), F.lit(SPLIT).cast("timestamp_ntz")
    return e.where(F.col("ts") < at), e.where(F.coalesce(F.col("ts") >= at, F.lit(True)))


BEFORE, SINCE = f"(SELECT * FROM events WHERE ts < TIMESTAMP '{SPLIT}')", f"(SELECT * FROM events WHERE coalesce(ts >= TIMESTAMP '{SPLIT}', true))"


@add("s1_pending_scan", "SELECT event_id, user_id, event_type, ts FROM events WHERE nullif(event_type, 'error') IS NULL AND user_id > 0 AND value > 0 AND props IS NOT NULL ORDER BY ts, event_id LIMIT 500")
def s1(spark, d):
    e = table(spark, d, "events")
    rows = tables.pending(e, F.nullif("event_type", F.lit("error")), [F.col("user_id") > 0, F.col("value") > 0, F.col("props").isNotNull()], [F.col("ts"), F.col("event_id")], 500)
    return rows.select("event_id", "user_id", "event_type", "ts")


@add("s2_incremental_overlap", f"SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 3 HOURS ORDER BY ts, event_id LIMIT 500")
def s2(spark, d):
    return tables.since(table(spark, d, "events"), "ts", NOW, 3.0, ["ts", "event_id"], 500).select("event_id", "ts")


@add("s3_envelopes", "SELECT lower(coalesce(nullif(CASE WHEN event_id % 5 = 0 THEN '' ELSE upper(event_type) END, ''), 'unknown')) AS source_key, 'event' AS envelope_type, coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN '' ELSE 'x' || event_id END, ''), event_id::VARCHAR) AS external_key, props AS content, ts AS captured_at FROM events")
def s3(spark, d):
    e = table(spark, d, "events")
    source = F.when(F.col("event_id") % 5 == 0, "").otherwise(F.upper("event_type"))
    first = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("x"), F.col("event_id")))
    return tables.envelopes(e, source, [first, F.col("event_id")], [F.col("ts")], "event", F.col("props"))


@add("s9_passthrough_adapter", "SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k') END, sha256(event_type || ':' || CASE WHEN event_id % 2 = 0 THEN props ELSE '{}' END)) AS external_id, ts AS occurred_at FROM events")
def s9(spark, d):
    body = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise("{}")
    i, t = tables.passthrough(body, "$.k", "$.at", F.col("event_type"), F.col("ts"))
    return table(spark, d, "events").select("event_id", i.alias("external_id"), t.alias("occurred_at"))


@add("s11_point_lookup", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 77")
def s11(spark, d):
    return reports.lookup(table(spark, d, "customer"), "c_custkey", 77).select("c_custkey", "c_name", "c_acctbal")




@add("k11_open_opportunities", "SELECT o_orderkey, o_custkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS r FROM orders WHERE o_orderkey % 2 = 0) n WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM orders s WHERE s.o_orderkey % 2 = 1 AND s.o_orderstatus = 'O' AND s.o_custkey = n.o_custkey AND s.o_orderpriority = n.o_orderpriority)")
def k11(spark, d):
    o = table(spark, d, "orders")
    return merge.insert_new(o.where("o_orderkey % 2 = 1 AND o_orderstatus = 'O'"), o.where("o_orderkey % 2 = 0"), ["o_custkey", "o_orderpriority"], [F.col("o_orderkey")]).select("o_orderkey", "o_custkey", "o_orderpriority")


@add("k13_upsert_actions", """
SELECT coalesce(s.o_orderkey, i.o_orderkey) AS o_orderkey, coalesce(i.o_totalprice, s.o_totalprice) AS o_totalprice, coalesce(s.o_orderdate, i.o_orderdate) AS o_orderdate
FROM (SELECT * FROM orders WHERE o_orderstatus <> 'F') s FULL JOIN (SELECT o_orderkey, o_totalprice * 2 AS o_totalprice, o_orderdate FROM orders WHERE o_orderstatus = 'F' OR o_orderkey % 5 = 0) i ON s.o_orderkey = i.o_orderkey
""")  # fmt: skip
def k13(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus")
    new = o.where("o_orderstatus = 'F' OR o_orderkey % 5 = 0").select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice"), "o_orderdate")
    return merge.upsert(o.where("o_orderstatus <> 'F'").drop("o_orderstatus"), new, ["o_orderkey"], {"o_totalprice": "set"})


@add("k14_status_transition", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 3 <> 0 THEN 'done' ELSE o_orderstatus END AS status FROM orders")
def k14(spark, d):
    o = table(spark, d, "orders")
    changes = o.where("o_orderkey % 4 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "bogus").otherwise("done").alias("status"))
    return merge.transition(o.select("o_orderkey", F.col("o_orderstatus").alias("status")), changes, "o_orderkey", ["new", "done"])


@add("k16_sync_state", "SELECT event_type, max(ts) AS last_seen_at, max(ts) FILTER (value < 100) AS last_success_at, max(ts) FILTER (value >= 100) AS last_error_at, left(max_by(props, CASE WHEN value >= 100 THEN ts END), 1000) AS last_error FROM events GROUP BY event_type")
def k16(spark, d):
    return merge.sync_state(table(spark, d, "events"), "event_type", "ts", F.col("value") < 100, F.col("props"))


@add("p1_contact_search", "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), 'mer#0000007') OR contains(c_custkey::VARCHAR, 'mer#0000007')")
def p1(spark, d):
    return read.search(table(spark, d, "customer"), "MER#0000007", ["c_custkey", "c_name"]).select("c_custkey", "c_name")


@add("p1_phone_suffix_search", "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '+55 00000042') OR contains(regexp_replace(c_name, '\\D', '', 'g'), '00000042')")
def p1b(spark, d):
    return read.search(table(spark, d, "customer"), "+55 00000042", ["c_name"], phone="c_name").select("c_custkey", "c_name")


@add("p4_action_filters", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' AND o_totalprice >= 300000")
def p4(spark, d):
    return read.where_given(table(spark, d, "orders"), o_orderstatus="O", o_orderpriority="1-URGENT", o_totalprice__ge=300000.0, o_custkey=None).select("o_orderkey", "o_custkey", "o_totalprice")


TAGS = "SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority))) AS tags FROM orders GROUP BY o_custkey"


def tags(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("tags"))


@add("p3_array_membership", f"SELECT o_custkey, array_to_string(tags, ',') AS tags FROM ({TAGS}) WHERE list_contains(tags, '1-URGENT') AND len(tags) < 5")
def p3(spark, d):
    return read.where_given(tags(spark, d), tags__has="1-URGENT").where(F.size("tags") < 5).select("o_custkey", F.array_join("tags", ",").alias("tags"))


@add("p8_case_filter", "SELECT l_orderkey AS event_id, l_linenumber AS case_id, l_shipdate AS created_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_suppkey % 2 = 0 AND l_shipdate >= TIMESTAMP '1993-01-01' AND o_orderstatus = 'F'")
def p8(spark, d):
    # a line is a case of its order's event, and the order's state the source
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("source"), F.col("o_orderkey").alias("event_id"))
    severity = F.when(F.col("l_suppkey") % 2 == 0, "high").otherwise("medium")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("case_id"), F.col("l_returnflag").alias("status"), F.col("l_linestatus").alias("case_type"), severity.alias("severity"), F.col("l_shipdate").alias("created_at"))
    cases = lines.join(o, "event_id")
    return read.cases_where(cases, o, status="R", case_type="F", severity="high", since="1993-01-01", source="F").select("event_id", "case_id", "created_at")


@add("p9_workspace_isolation", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def p9(spark, d):
    members = table(spark, d, "events").select(F.col("user_id").alias("c_custkey"), F.col("event_type").alias("workspace_id"))
    return read.of_workspace(table(spark, d, "customer"), members, "c_custkey", "purchase").select("c_custkey", "c_name")


@add("j1_actions_with_contacts", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_mktsegment = 'BUILDING'")
def j1(spark, d):
    contacts = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return read.left_one(table(spark, d, "orders"), contacts, {"o_custkey": "c_custkey"}, c_mktsegment="BUILDING").select("o_orderkey", "c_name")


@add("j6_identity_semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '2-HIGH')")
def j6(spark, d):
    ids = table(spark, d, "orders").where("o_orderstatus = 'P' AND o_orderpriority = '2-HIGH'")
    return reports.held_by(table(spark, d, "customer"), ids, {"c_custkey": "o_custkey"}).select("c_custkey")


@add("j9_results_of_person_runs", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def j9(spark, d):
    return reports.joined(table(spark, d, "lineitem"), table(spark, d, "orders").select("o_orderkey"), {"l_orderkey": "o_orderkey"}).select("l_orderkey", "l_linenumber", "l_extendedprice")


@add("j13_source_dictionary", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def j13(spark, d):
    n = reports.named(table(spark, d, "nation"), table(spark, d, "region"), {"n_regionkey": "r_regionkey"}).select("n_nationkey", "n_name", "r_name")
    return reports.named(table(spark, d, "customer"), n, {"c_nationkey": "n_nationkey"}).select("c_custkey", "n_name", "r_name")


# an equi-join in SQL too: starts_with over both whole tables would compare all pairs
@add("j17_prefix_join", "SELECT c_custkey, o_orderkey FROM (SELECT o_orderkey, unnest(range(1, length(o_orderkey::VARCHAR) + 1)) AS n FROM orders) JOIN customer ON c_custkey::VARCHAR = left(o_orderkey::VARCHAR, n)")
def j17(spark, d):
    return prefix_pairs(table(spark, d, "customer"), table(spark, d, "orders"))


def prefix_pairs(customers, orders):
    wanted = customers.select("c_custkey", F.col("c_custkey").cast("string").alias("prefix"))
    # an equi-join on the leading digits of each length that occurs; a key has 20 digits at most, so there are no more lengths
    lengths = [r[0] for r in wanted.select(F.length("prefix")).distinct().collect()]
    o = orders.select("o_orderkey", F.col("o_orderkey").cast("string").alias("digits"))
    heads = o.select("o_orderkey", F.explode(F.array_compact(F.array(*[F.when(F.length("digits") >= n, F.substring("digits", 1, n)) for n in lengths]))).alias("prefix"))
    return heads.join(wanted, "prefix").select("c_custkey", "o_orderkey")


@add("a1_conversation_rollup", "SELECT user_id, count(*) AS total, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY user_id")
def a1(spark, d):
    return rollup.span(table(spark, d, "events"), "user_id", "ts")


@add("a3_contact_rollup_zero", "SELECT c_custkey, coalesce(total, 0) AS total, first_at, last_at FROM customer LEFT JOIN (SELECT user_id AS c_custkey, count(*) AS total, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY 1) USING (c_custkey)")
def a3(spark, d):
    e = table(spark, d, "events").withColumnRenamed("user_id", "c_custkey")
    return rollup.join_back(table(spark, d, "customer").select("c_custkey"), e, "c_custkey", "ts", zero=True)


@add("a4_normalization_status", "SELECT count(*) AS total, count(nullif(event_type, 'error')) AS done, count(*) - count(nullif(event_type, 'error')) AS pending FROM events")
def a4(spark, d):
    return rollup.status(table(spark, d, "events").withColumn("done", F.nullif("event_type", F.lit("error"))), "done")


@add("a5_status_by_source", "SELECT nullif(user_id % 7, 3) AS account, count(*) AS total, count(nullif(event_type, 'error')) AS done, count(*) - count(nullif(event_type, 'error')) AS pending FROM events GROUP BY 1")
def a5(spark, d):
    e = table(spark, d, "events").select(F.nullif(F.col("user_id") % 7, F.lit(3)).alias("account"), F.nullif("event_type", F.lit("error")).alias("done"))
    return rollup.status(e, "done", ["account"])


@add("a6_enrichment_status", "SELECT (SELECT count(*) FROM customer) AS contacts, (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS enriched, (SELECT count(*) FROM customer) - (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS pending, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS opportunities, (SELECT max(o_orderdate) FROM orders) AS last_run")
def a6(spark, d):
    return reports.enrichment_status(table(spark, d, "customer"), F.col("c_acctbal") > 0, table(spark, d, "orders"), F.col("o_orderstatus") == "O", "o_orderdate")


@add("a7_contacts_by_type", "SELECT nullif(c_mktsegment, 'BUILDING') AS kind, count(*) AS n FROM customer WHERE nullif(c_mktsegment, 'BUILDING') IS NOT NULL GROUP BY 1 ORDER BY n DESC, kind")
def a7(spark, d):
    return reports.by_type(table(spark, d, "customer"), F.nullif("c_mktsegment", F.lit("BUILDING")))


@add("a8_top_tags", "SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS tag FROM part) GROUP BY tag ORDER BY n DESC, tag LIMIT 15")
def a8(spark, d):
    return rollup.top_elements(table(spark, d, "part"), F.split("p_name", " "), 15)


@add("a9_action_summary", "SELECT o_orderpriority AS kind, count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'P') AS pending, count(*) FILTER (o_orderstatus = 'F') AS finished, max(o_orderdate) AS last_at FROM orders GROUP BY 1")
def a9(spark, d):
    return reports.summary(table(spark, d, "orders"), F.col("o_orderpriority"), F.col("o_orderstatus"), {"open": "O", "pending": "P", "finished": "F"}, "o_orderdate")


@add("a11_source_health", f"SELECT s.user_id, last_at, coalesce(recent, 0) AS recent, coalesce(recent_failed, 0) AS recent_failed, coalesce(recent, 0) > 0 AS feeding FROM (SELECT c_custkey AS user_id FROM customer) s LEFT JOIN (SELECT user_id, max(ts) AS last_at, count(*) FILTER (ts >= TIMESTAMP '{NOW}' - INTERVAL 24 HOURS) AS recent, count(*) FILTER (ts >= TIMESTAMP '{NOW}' - INTERVAL 24 HOURS AND event_type = 'error') AS recent_failed FROM events GROUP BY user_id) e ON s.user_id = e.user_id")
def a11(spark, d):
    sources = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return rollup.source_health(sources, table(spark, d, "events"), "user_id", "ts", F.col("event_type") == "error", F.lit(NOW).cast("timestamp_ntz"))


@add("a12_paged_total", "SELECT c_custkey, count(*) OVER () AS total FROM customer WHERE c_mktsegment = 'MACHINERY' ORDER BY c_custkey LIMIT 20 OFFSET 20")
def a12(spark, d):
    rows = table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select("c_custkey")
    return reports.with_total(rows, read.sorted_page(rows, "c_custkey", ["c_custkey"], False, "c_custkey", page=2, size=20))


@add("a13_batch_premerge", "SELECT user_id, arg_min(event_type, event_id) FILTER (event_type <> 'error') AS name, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY user_id")
def a13(spark, d):
    e = table(spark, d, "events").withColumn("name", F.when(F.col("event_type") != "error", F.col("event_type")))
    return reports.premerged(e, "user_id", "name", "event_id", "ts")


@add("a15_distinct_evidence_types", "SELECT o_custkey, array_to_string(list_sort(list_distinct(list(l_returnflag || l_linestatus))), ',') AS kinds FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey")
def a15(spark, d):
    rows = reports.joined(table(spark, d, "lineitem"), table(spark, d, "orders").select("o_orderkey", "o_custkey"), {"l_orderkey": "o_orderkey"})
    return reports.distinct_types(rows, "o_custkey", F.concat("l_returnflag", "l_linestatus")).select("o_custkey", F.array_join("kinds", ",").alias("kinds"))


@add("a16_corpus", """
SELECT conv_id, string_agg(text, ' ' ORDER BY up > 10, CASE WHEN up <= 10 THEN up ELSE -up END) AS corpus FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS up, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS down FROM conversations WHERE text <> '') WHERE up <= 10 OR down <= 50 GROUP BY conv_id
""")  # fmt: skip
def a16(spark, d):
    return rollup.corpus(table(spark, d, "conversations"), "conv_id", "turn", "text")


@add("a17_misses", f"SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM {SINCE} WHERE (user_id, event_type) NOT IN (SELECT user_id, event_type FROM {BEFORE})) WHERE r <= 5")
def a17_misses(spark, d):
    before, since = (e.select("event_id", "user_id", "event_type") for e in sides(spark, d))
    return rollup.misses(since, before, ["user_id", "event_type"], "event_type", [F.col("event_id")], 5).select("event_type", "event_id")


@add("a17_name_differences", "SELECT c_custkey, c_name AS name, o_clerk AS other FROM customer JOIN (SELECT o_custkey, min(o_orderpriority) AS o_clerk FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE c_name IS DISTINCT FROM o_clerk")
def a17_differences(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"))
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderpriority").alias("name"))
    return rollup.differences(c, o, ["c_custkey"], "name")


@add("a18_evidence_counts", "SELECT o_custkey, l_returnflag, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def a18(spark, d):
    rows = reports.joined(table(spark, d, "lineitem"), table(spark, d, "orders").select("o_orderkey", "o_custkey"), {"l_orderkey": "o_orderkey"})
    return reports.counts(rows, "o_custkey", "l_returnflag")


@add("a19_dashboard", "SELECT count(*) FILTER (n > 70) AS feeding, count(*) FILTER (bad > 0) AS with_errors, CASE WHEN sum(n) = 0 THEN 0 ELSE round(100.0 * sum(n - bad) / sum(n), 1) END AS percent FROM (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad FROM events GROUP BY user_id)")
def a19(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("bad"))
    return reports.dashboard(e, F.col("n") > 70)


@add("w1_latest_observations", "SELECT user_id, event_type, event_id, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1) WHERE rank <= 20")
def w1(spark, d):
    return windows.latest_per_key(table(spark, d, "events"), "user_id", "event_type", "ts", "event_id", 20).select("user_id", "event_type", "event_id", "value", "rank")


@add("w2_latest_scores", "SELECT user_id, event_type, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE value > 1) WHERE r = 1) WHERE rank <= 3")
def w2(spark, d):
    scores = table(spark, d, "events").where("value > 1")
    return windows.latest_per_key(scores, "user_id", "event_type", "ts", "event_id", 3).select("user_id", "event_type", "value", "rank")


@add("w3_latest_answers", "SELECT o_custkey, o_orderpriority, o_orderkey, answers FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS r, count(*) OVER (PARTITION BY o_custkey) AS answers FROM orders) WHERE r = 1")
def w3(spark, d):
    o = table(spark, d, "orders")
    total = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("answers"))
    newest = windows.first_of(o, ["o_custkey", "o_orderpriority"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])
    return newest.join(total, "o_custkey").select("o_custkey", "o_orderpriority", "o_orderkey", "answers")


FIRST_LAST = "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN u <= 10 THEN u ELSE 10 + v END) AS position FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS v FROM events) WHERE u <= 10 OR v <= 50"


@add("w4_first_and_last_messages", FIRST_LAST)
def w4(spark, d):
    return windows.first_and_last(table(spark, d, "events"), "user_id", ["ts", "event_id"], 10, 50).select("user_id", "event_id", "position")


@add("w6_first_envelope", "SELECT props, min(ts) AS ts, arg_min(event_id, ts) AS event_id FROM events GROUP BY props")
def w6(spark, d):
    return windows.first_of(table(spark, d, "events"), ["props"], [F.col("ts"), F.col("event_id")]).select("props", "ts", "event_id")


@add("w7_top_open_opportunity", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders WHERE o_orderstatus = 'O') WHERE r = 1")
def w7(spark, d):
    return windows.first_of(table(spark, d, "orders").where("o_orderstatus = 'O'"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@add("w8_first_matching_message", "SELECT conv_id, min(turn) AS turn, arg_min(role, turn) AS role FROM conversations WHERE contains(lower(text), ' de ') GROUP BY conv_id")
def w8(spark, d):
    hits = table(spark, d, "conversations").where(F.contains(F.lower("text"), F.lit(" de ")))
    return windows.first_of(hits, ["conv_id"], [F.col("turn")]).select("conv_id", "turn", "role")


@add("l1_sorted_page", "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS kind FROM customer ORDER BY kind DESC NULLS LAST, c_custkey LIMIT 50 OFFSET 1150")
def l1(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("kind"))
    return read.sorted_page(c, "kind", ["kind", "c_custkey"], True, "c_custkey", page=24, size=50)


@add("l2_clamped_page", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 100")
def l2(spark, d):
    return read.page_of(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", ["c_custkey"], False, "c_name", page=0, size=1_000)


@add("l4_keyset_by_id", "SELECT c_custkey, c_name FROM customer WHERE c_custkey > 500 ORDER BY c_custkey LIMIT 51")
def l4(spark, d):
    return read.after(table(spark, d, "customer").select("c_custkey", "c_name"), [("c_custkey", False)], [500], 50)


@add("l5_keyset_by_time", "SELECT event_id, ts FROM events WHERE (ts < TIMESTAMP '2024-01-15 00:00:00' OR (ts = TIMESTAMP '2024-01-15 00:00:00' AND event_id < 5000)) ORDER BY ts DESC, event_id DESC LIMIT 101")
def l5(spark, d):
    import datetime

    return read.after(table(spark, d, "events").select("event_id", "ts"), [("ts", True), ("event_id", True)], [datetime.datetime(2024, 1, 15), 5000], 100)


@add("l8_priority_sort", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC NULLS LAST, o_orderdate DESC, o_orderkey LIMIT 100")
def l8(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'O'").orderBy(F.col("o_totalprice").desc_nulls_last(), F.desc("o_orderdate"), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@add("l9_enrichment_queue", "SELECT c_custkey FROM customer LEFT JOIN (SELECT user_id, max(ts) AS last_at, max(ts) FILTER (event_type = 'signup') AS done_at FROM events GROUP BY user_id) ON c_custkey = user_id ORDER BY CASE WHEN done_at IS NULL THEN 0 ELSE 1 END, last_at DESC NULLS LAST, c_custkey LIMIT 200")
def l9(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last_at"), F.max(F.when(F.col("event_type") == "signup", F.col("ts"))).alias("done_at"))
    rows = table(spark, d, "customer").join(e, F.col("c_custkey") == F.col("user_id"), "left")
    return read.queue(rows, "done_at", "last_at", "c_custkey", 200).select("c_custkey")


@add("l11_context_section", "SELECT user_id, event_id, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 20")
def l11(spark, d):
    return windows.ranked(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 20).select("user_id", "event_id", "rank")


@add("u1_union_distinct", f"SELECT user_id, event_type FROM {BEFORE} UNION SELECT user_id, event_type FROM {SINCE}")
def u1(spark, d):
    before, since = (e.select("user_id", "event_type") for e in sides(spark, d))
    return reports.union_once(before, since)


@add("k3_insert_ignore", f"SELECT min(event_id) AS event_id, user_id, event_type FROM {SINCE} WHERE (user_id, event_type) NOT IN (SELECT user_id, event_type FROM {BEFORE}) GROUP BY user_id, event_type")
def k3(spark, d):
    before, since = sides(spark, d)
    return merge.insert_new(before, since, ["user_id", "event_type"], [F.col("event_id")]).select("event_id", "user_id", "event_type")


@add("k10_timeline_cap", f"SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM {SINCE}) n LEFT JOIN (SELECT user_id, count(*) AS c FROM {BEFORE} GROUP BY user_id) h USING (user_id) WHERE r + coalesce(c, 0) <= 10")
def k10(spark, d):
    before, since = sides(spark, d)
    return windows.capped(since, "user_id", [F.col("ts"), F.col("event_id")], before, 10).select("event_id", "user_id")


@add("a17_recall", f"SELECT event_type, count(*) AS total, count(*) FILTER (hit) AS found, avg(hit::INT) AS recall FROM (SELECT event_type, (user_id, event_type) IN (SELECT user_id, event_type FROM {BEFORE}) AS hit FROM {SINCE}) GROUP BY event_type")
def a17(spark, d):
    before, since = (e.select("event_id", "user_id", "event_type") for e in sides(spark, d))
    return rollup.recall(since, before, ["user_id", "event_type"], "event_type")


@add("k1_upsert_contacts", "SELECT coalesce(s.contact_id, i.contact_id) AS contact_id, coalesce(nullif(s.name, ''), i.name, s.name) AS name, coalesce(s.phone, i.phone) AS phone, round(greatest(s.last_at, i.last_at), 2) AS last_at FROM (SELECT c_custkey AS contact_id, CASE WHEN c_mktsegment = 'MACHINERY' THEN '' ELSE c_name END AS name, nullif(c_nationkey, 3) AS phone, c_acctbal AS last_at FROM customer WHERE c_acctbal < 5000) s FULL JOIN (SELECT c_custkey AS contact_id, 'new ' || c_name AS name, c_nationkey + 100 AS phone, c_acctbal + 1 AS last_at FROM customer WHERE coalesce(c_acctbal >= 0, true)) i ON s.contact_id = i.contact_id")
def k1(spark, d):
    c, k, b = table(spark, d, "customer"), F.col("c_custkey").alias("contact_id"), F.col("c_acctbal")
    stored = c.where(b < 5000).select(k, F.when(F.col("c_mktsegment") == "MACHINERY", "").otherwise(F.col("c_name")).alias("name"), F.nullif("c_nationkey", F.lit(3)).alias("phone"), b.alias("last_at"))
    new = c.where(F.coalesce(b >= 0, F.lit(True))).select(k, F.concat(F.lit("new "), "c_name").alias("name"), (F.col("c_nationkey") + 100).alias("phone"), (b + 1).alias("last_at"))
    return merge.upsert(stored, new, ["contact_id"], {"name": "fill", "phone": "keep", "last_at": "max"}).withColumn("last_at", F.round("last_at", 2))


@add("u2_missing_evidence", f"SELECT o_custkey, array_to_string(list_sort(list_filter(['1-URGENT', '2-HIGH', '3-MEDIUM', '9-NONE'], lambda x: NOT list_contains(tags, x))), ',') AS missing FROM ({TAGS})")
def u2(spark, d):
    wanted = F.array(*map(F.lit, ["1-URGENT", "2-HIGH", "3-MEDIUM", "9-NONE"]))
    return tags(spark, d).select("o_custkey", F.array_join(F.array_sort(F.array_except(wanted, "tags")), ",").alias("missing"))


@add("u3_tags_overlap", f"SELECT o_custkey FROM ({TAGS}) WHERE len(list_intersect(list_transform(tags, lambda x: lower(x)), ['5-low', '2-high'])) > 0 AND len(tags) <= 4")
def u3(spark, d):
    lowered = F.transform("tags", F.lower)
    return tags(spark, d).where(F.arrays_overlap(lowered, F.array(F.lit("5-low"), F.lit("2-high"))) & (F.size("tags") <= 4)).select("o_custkey")


@add("f9_domains", "SELECT page_id, regexp_replace(split_part(split_part(regexp_replace(lower(trim(url)), '^https?://', ''), '/', 1), '?', 1), '^www\\.', '') AS domain FROM pages")
def f9(spark, d):
    return table(spark, d, "pages").select("page_id", K.domain(F.col("url")).alias("domain"))


@add("f9_domain_ambiguity", "SELECT domain, count(DISTINCT page_id) AS pages, count(DISTINCT page_id) > 1 AS ambiguous FROM (SELECT page_id, regexp_replace(split_part(split_part(regexp_replace(lower(trim(url)), '^https?://', ''), '/', 1), '?', 1), '^www\\.', '') AS domain FROM pages) GROUP BY domain")
def f9b(spark, d):
    p = table(spark, d, "pages").select("page_id", K.domain(F.col("url")).alias("domain"))
    return p.groupBy("domain").agg(F.countDistinct("page_id").alias("pages")).withColumn("ambiguous", F.col("pages") > 1)


@add("h3_deterministic_ids", "SELECT event_id, left(sha256(event_type || '|' || user_id || '|' || event_id), 40) AS id FROM events")
def h3(spark, d):
    return table(spark, d, "events").select("event_id", K.deterministic_id(F.col("event_type"), F.col("user_id").cast("string"), F.col("event_id").cast("string")).alias("id"))


@add("h8_json_dig", "SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k, sha256(event_type || ':' || json_extract_string(props, '$.k')) AS hash FROM events")
def h8(spark, d):
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").select("event_id", k.cast("int").alias("k"), K.value_hash(F.col("event_type"), k).alias("hash"))


@add("h12_falsy_score", "SELECT o_orderkey, coalesce(nullif(round(o_totalprice * (o_orderkey % 3), 2), 0), c_acctbal) AS score FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def h12(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    score = K.falsy_or(F.round(F.col("o_totalprice") * (F.col("o_orderkey") % 3), 2), F.col("c_acctbal"))
    return table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", score.alias("score"))


@add("f18_digits_suffix", "SELECT c_custkey, regexp_replace(c_name, '\\D', '', 'g') AS digits, right(regexp_replace(c_name, '\\D', '', 'g'), 8) AS suffix FROM customer")
def f18(spark, d):
    n = K.digits(F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", n.alias("digits"), F.right(n, F.lit(8)).alias("suffix"))
