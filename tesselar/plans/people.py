"""Persons, companies, replays and the rest of the read surface over the driver tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselar.functions import keys as K
from tesselar.operators import companies, extract, facts, ingest, merge, read, reports, windows
from tesselar.plans.registry import Registry
from tesselar.sources import tables
from tesselar.sources.tables import table

R = Registry()
add = R.add

# A page is an event that names the company of its host; two thirds of them name one of three CNPJs of it, too.
HOSTS = "SELECT page_id, split_part(split_part(regexp_replace(lower(trim(url)), '^https?://', ''), '/', 1), '?', 1) AS host, page_id % 4 AS k FROM pages"
HOST = "regexp_replace(host, '^www\\.', '')"
FOLD = f"""
e AS (SELECT page_id AS arrival, nullif({HOST}, '') AS domain, nullif(k, 0) AS k FROM ({HOSTS}) WHERE nullif({HOST}, '') IS NOT NULL),
first_k AS (SELECT domain, k, min(arrival) AS at FROM e WHERE k IS NOT NULL GROUP BY domain, k),
first_of AS (SELECT domain, min(arrival) AS at FROM e GROUP BY domain),
named AS (SELECT first_k.domain, k, first_k.at, CASE WHEN first_k.at = min(first_k.at) OVER (PARTITION BY first_k.domain) THEN first_of.at ELSE first_k.at END AS company FROM first_k JOIN first_of USING (domain)),
r AS (SELECT e.arrival, e.domain, e.k, CASE WHEN e.k IS NOT NULL THEN named.company WHEN (SELECT count(*) FROM first_k f WHERE f.domain = e.domain AND f.at < e.arrival) <= 1 THEN first_of.at END AS company
  FROM e JOIN first_of USING (domain) LEFT JOIN named ON named.domain = e.domain AND named.k = e.k)
"""


def company_events(spark, d):
    p = table(spark, d, "pages")
    k = F.col("page_id") % 4
    # the number is of the host, so no two hosts share one
    number = F.lpad(F.conv(F.substring(F.md5(K.domain(F.col("url"))), 1, 10), 16, 10), 13, "0")
    return p.select(F.col("page_id").alias("arrival"), F.when(k > 0, F.concat(number, k.cast("string"))).alias("cnpj"), F.col("url").alias("domain"), F.lit(None).cast("string").alias("name"))


@add("r2_companies", f"WITH {FOLD} SELECT arrival, company, CASE WHEN company IS NULL THEN 'ambiguous' WHEN company = arrival THEN 'created' ELSE 'resolved' END AS decision FROM r")
def r2(spark, d):
    return companies.companies(company_events(spark, d)).select("arrival", "company", "decision")


@add("r2_ambiguity_cases", f"WITH {FOLD} SELECT arrival, 'possible_duplicate_company' AS case_type, (SELECT count(*) FROM first_k f WHERE f.domain = r.domain AND f.at < r.arrival) AS candidates FROM r WHERE company IS NULL")
def r2_cases(spark, d):
    return companies.ambiguity_cases(companies.companies(company_events(spark, d))).select("arrival", "case_type", F.col("candidates").cast("long").alias("candidates"))


@add("j16_company_candidates", """
WITH c AS (SELECT s_suppkey AS company_id, lpad(s_suppkey::VARCHAR, 14, '0') AS cnpj, 'n' || s_nationkey || '.com' AS domain, 'firm ' || s_nationkey AS name FROM supplier),
e AS (SELECT c_custkey AS arrival, lpad(c_custkey::VARCHAR, 14, '0') AS cnpj, 'n' || c_nationkey || '.com' AS domain, 'firm ' || c_nationkey AS name FROM customer)
SELECT arrival, 'cnpj' AS matched_on, min(company_id) AS company_id, count(*) AS candidates FROM e JOIN c USING (cnpj) GROUP BY arrival
UNION ALL SELECT arrival, 'domain', min(company_id), count(*) FROM e JOIN c USING (domain) GROUP BY arrival UNION ALL SELECT arrival, 'name', min(company_id), count(*) FROM e JOIN c USING (name) GROUP BY arrival
""")
def j16(spark, d):
    def named(df, key, nation, as_):
        return df.select(F.col(key).alias(as_), F.lpad(F.col(key).cast("string"), 14, "0").alias("cnpj"), F.concat(F.lit("n"), nation, F.lit(".com")).alias("domain"), F.concat(F.lit("firm "), nation).alias("name"))

    return companies.candidates(companies.company_keys(named(table(spark, d, "customer"), "c_custkey", "c_nationkey", "arrival")), named(table(spark, d, "supplier"), "s_suppkey", "s_nationkey", "company_id"))


@add("r18_company_events", f"""
WITH {FOLD} SELECT arrival, company, 'segment' AS key, (arrival % 5)::VARCHAR AS value, sha256('segment:' || (arrival % 5)) AS value_hash, CASE WHEN arrival % 2 = 0 THEN (arrival % 7) / 10.0 END::DOUBLE AS confidence,
  CASE WHEN arrival % 4 = 1 THEN 'crm' ELSE 'declared' END AS source_kind, TIMESTAMP '2024-01-01' + to_seconds(arrival) AS observed_at
FROM r WHERE company IS NOT NULL AND arrival % 3 <> 0
""")  # fmt: skip
def r18(spark, d):
    n = F.col("page_id")
    told = F.concat(F.when(n % 2 == 0, F.concat(F.lit(',"confidence":0.'), n % 7)).otherwise(""), F.when(n % 4 == 1, ',"source_kind":"crm"').otherwise(""))
    data = F.concat(F.lit('{"key":"'), F.when(n % 3 == 0, "").otherwise("segment"), F.lit('","value":'), n % 5, told, F.lit("}"))
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=n)
    return companies.company_observations(table(spark, d, "pages").select(n.alias("arrival"), data.alias("data"), at.alias("occurred_at")), companies.companies(company_events(spark, d)))


def identities(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("source"), F.col("event_id").alias("arrival"), "user_id", "event_id")
    pairs = F.array(F.struct(F.lit("email").alias("type"), F.concat("user_id", F.lit("@x.co")).alias("value")), F.struct(F.lit("email").alias("type"), F.when(F.col("event_id") % 6 == 0, "no address").otherwise(F.concat("user_id", F.lit("@x.co"))).alias("value")))
    return e.select("source", "arrival", F.inline(pairs))


@add("r15_identity_counts", "SELECT event_id AS arrival, CASE WHEN event_id % 6 = 0 THEN 1 ELSE 2 END AS identities_linked, CASE WHEN event_id % 6 = 0 THEN 1 ELSE 0 END AS identities_invalid FROM events")
def r15_counts(spark, d):
    return companies.identity_counts(identities(spark, d))


@add("r15_identity_edges", "SELECT min(event_id) OVER (PARTITION BY user_id) AS person, min(event_id) OVER (PARTITION BY event_type) AS company, ts FROM events".join(["SELECT person, company, min(ts) AS first_seen_at, max(ts) AS last_seen_at FROM (", ") GROUP BY person, company"]))
def r15_edges(spark, d):
    e = table(spark, d, "events")
    firms = e.select(F.col("event_id").alias("arrival"), F.lit(None).cast("string").alias("cnpj"), F.concat("event_type", F.lit(".com")).alias("domain"), F.lit(None).cast("string").alias("name"))
    return companies.identity_events(identities(spark, d), firms, e.select(F.col("event_id").alias("arrival"), F.col("ts").alias("occurred_at")))


# Orders in state O capture an e-mail for their customer, those in state F have given theirs to one; a name with a space is no address.
LINKS = """
WITH c AS (SELECT o_orderkey AS arrival, o_custkey AS person, sha256('email:c' || o_custkey % 300 || '-' || lower(o_orderpriority) || '@x.co') AS hash FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority NOT LIKE '% %'),
f AS (SELECT sha256('email:c' || o_custkey % 300 || '-' || lower(o_orderpriority) || '@x.co') AS hash, min(o_custkey) AS owner FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority NOT LIKE '% %' GROUP BY 1),
r AS (SELECT c.*, f.owner AS stored, coalesce(f.owner, first_value(person) OVER (PARTITION BY c.hash ORDER BY arrival)) AS owner, row_number() OVER (PARTITION BY c.hash ORDER BY arrival) AS nth FROM c LEFT JOIN f ON f.hash = c.hash)
"""


def links(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("arrival"), F.col("o_custkey").alias("person"), F.lit("s").alias("source"), F.lit("email").alias("type"), F.concat(F.lit("c"), F.col("o_custkey") % 300, F.lit("-"), "o_orderpriority", F.lit("@x.co")).alias("value"), "o_orderstatus")
    owners = o.where("o_orderstatus = 'F'").select("person", K.identity(F.col("type"), F.col("value"))["hash"].alias("key")).where("key IS NOT NULL").groupBy("key").agg(F.min("person").alias("person"))
    return companies.linked_identities(o.where("o_orderstatus = 'O'").drop("o_orderstatus"), owners)


@add("r21_linked_identities", LINKS + "SELECT arrival, person, hash FROM r WHERE stored IS NULL AND nth = 1")
def r21(spark, d):
    return links(spark, d)[0].select("arrival", "person", F.col("key").alias("hash"))


@add("r21_linked_conflicts", LINKS + "SELECT arrival, owner <> person AS conflict FROM r")
def r21_conflicts(spark, d):
    return links(spark, d)[1]


# Failed and conflicting events whose value is over 50 succeed when they run again; those of even users are not run.
LOG = "SELECT event_id, event_type, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'conflict' ELSE 'processed' END AS status, value > 50 AS ok, user_id % 2 = 1 AS again FROM events"


def log_of(spark, d):
    e, t = table(spark, d, "events"), F.col("event_type")
    status = F.when(t == "error", "failed").when(t == "signup", "conflict").otherwise("processed")
    return e.select(F.lit("s").alias("source"), F.col("event_id").cast("string").alias("event_id"), status.alias("status"), F.lit(1).alias("retry_count"), F.when(F.col("value") > 50, "processed").otherwise(status).alias("now"), (F.col("user_id") % 2 == 1).alias("again"))


def handled_of(log):
    return log.where("again AND status <> 'processed'").select("source", "event_id", F.col("now").alias("status"))


@add("replay_of_failed_events", f"SELECT event_id::VARCHAR AS event_id, CASE WHEN again AND ok THEN 'processed' ELSE status END AS status, CASE WHEN status <> 'processed' AND again AND NOT ok THEN 2 ELSE 1 END AS retry_count FROM ({LOG})")
def replay(spark, d):
    log = log_of(spark, d)
    return ingest.replay(log.drop("now", "again"), handled_of(log)).select("event_id", "status", "retry_count")


@add("replay_closes_cases", f"SELECT event_id::VARCHAR AS event_id, CASE WHEN status <> 'processed' AND again AND ok THEN 'resolved' ELSE 'open' END AS status, CASE WHEN status <> 'processed' AND again AND ok THEN 'reprocessed' END AS resolution FROM ({LOG}) WHERE event_type IN ('signup', 'click')")
def replay_cases(spark, d):
    log = log_of(spark, d)
    told = table(spark, d, "events").where(F.col("event_type").isin("signup", "click")).select(F.lit("s").alias("source"), F.col("event_id").cast("string").alias("event_id"), F.lit("open").alias("status"), F.lit(None).cast("string").alias("resolution"))
    return ingest.closed_cases(told, handled_of(log)).select("event_id", "status", "resolution")


# Stored events of each state, and arrivals that equal them or not, in any order, some of a family without a handler.
ARRIVALS = """
SELECT event_id AS arrival, user_id || '-' || json_extract_string(props, '$.k') AS key, event_id % 2 AS v, user_id % 5 = 0 AS unknown, user_id % 4 AS state, event_id % 13 <> 0 AS ok FROM events
"""


@add("r22_retries", f"""
SELECT arrival, CASE WHEN NOT ok THEN 'SCHEMA_UNSUPPORTED' WHEN v <> 0 THEN 'EVENT_ID_CONFLICT' WHEN state = 0 THEN 'duplicate' WHEN state = 2 THEN 'IDENTITY_CONFLICT' WHEN unknown THEN 'VALIDATION_ERROR'
  WHEN row_number() OVER (PARTITION BY key, v, ok ORDER BY arrival) = 1 THEN 'retry' ELSE 'duplicate' END AS decision FROM ({ARRIVALS})
""")  # fmt: skip
def r22_retries(spark, d):
    e, u, n = table(spark, d, "events"), F.col("user_id"), F.col("event_id")
    kind, key = F.when(u % 5 == 0, "other.x").otherwise("score.set"), F.concat_ws("-", "user_id", F.get_json_object("props", "$.k"))
    arriving = e.select(F.lit("s").alias("source"), key.alias("event_id"), kind.alias("event_type"), F.when(n % 13 == 0, "2.0").otherwise("1.0").alias("schema_version"), F.format_string('{"v":%d}', n % 2).alias("payload"), n.alias("arrival"))
    state = F.element_at(F.array(*map(F.lit, ["processed", "failed", "conflict", "pending"])), (u % 4 + 1).cast("int"))
    stored = e.select(F.lit("s").alias("source"), key.alias("event_id"), kind.alias("event_type"), K.payload_hash(F.lit('{"v":0}')).alias("payload_hash"), state.alias("status")).distinct()
    return ingest.decide(arriving, stored).select("arrival", "decision")


def people(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("person"), F.col("c_name").alias("name"), "c_nationkey")


@add("p5_people_by_name", "SELECT c_custkey AS person, c_name AS name FROM customer WHERE c_name ILIKE '%R#00000001%' AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def p5(spark, d):
    members = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("workspace_id"))
    return companies.people_where(read.of_workspace(people(spark, d), members, "c_nationkey", 1), "r#00000001").select("person", "name")


@add("p5_people_by_identity", "SELECT c_custkey AS person, c_name AS name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def p5_identity(spark, d):
    held = table(spark, d, "orders").select(F.col("o_custkey").alias("person"), F.lit("email").alias("type"), F.concat("o_orderpriority", F.lit("@x.co")).alias("value"))
    return companies.people_where(people(spark, d), identity=(" Email", "1-urgent@X.co "), identities=held).select("person", "name")


FIRMS = "SELECT s_suppkey AS company, s_name AS name, 'n' || s_nationkey || '.com' AS domain, lpad(s_suppkey::VARCHAR, 14, '0') AS cnpj FROM supplier"


def firms(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("company"), F.col("s_name").alias("name"), F.concat(F.lit("n"), "s_nationkey", F.lit(".com")).alias("domain"), F.lpad(F.col("s_suppkey").cast("string"), 14, "0").alias("cnpj"))


@add("p6_companies_by_name_and_domain", f"SELECT company, name FROM ({FIRMS}) WHERE name ILIKE '%r#0000%' AND domain = 'n7.com'")
def p6(spark, d):
    return companies.companies_where(firms(spark, d), name="R#0000", domain="N7.com").select("company", "name")


@add("p6_companies_by_cnpj", f"SELECT company, name FROM ({FIRMS}) WHERE cnpj = '00000000000042'")
def p6_cnpj(spark, d):
    return companies.companies_where(firms(spark, d), cnpj="00.000.000/0000-42").select("company", "name")


@add("p2_conjunctive_filters", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity >= 45")
def p2(spark, d):
    return read.where_given(table(spark, d, "lineitem"), l_returnflag="R", l_linestatus="F", l_quantity__ge=45, l_shipmode=None).select("l_orderkey", "l_linenumber")


@add("j2_contacts_with_state", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'")
def j2(spark, d):
    states = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return read.left_one(table(spark, d, "customer"), states, {"c_custkey": "o_custkey"}, o_orderstatus="P").select("c_custkey", "o_orderkey")


@add("j3_conversations_with_account", "SELECT DISTINCT conv_id, n_name FROM conversations LEFT JOIN nation ON n_nationkey = conv_id % 30")
def j3(spark, d):
    c = table(spark, d, "conversations").select("conv_id").distinct().withColumn("account", F.col("conv_id") % 30)
    return read.left_one(c, table(spark, d, "nation").select("n_nationkey", "n_name"), {"account": "n_nationkey"}).select("conv_id", "n_name")


@add("j7_companies_of_persons", "SELECT user_id, id, name, rank FROM (SELECT user_id, id, s_name AS name, row_number() OVER (PARTITION BY user_id ORDER BY last_at DESC, id) AS rank FROM (SELECT user_id, json_extract_string(props, '$.k')::INT AS id, max(ts) AS last_at FROM events GROUP BY 1, 2) JOIN supplier ON s_suppkey = id) WHERE rank <= 3")
def j7(spark, d):
    relations = ingest.edges(table(spark, d, "events").select("user_id", F.get_json_object("props", "$.k").cast("int").alias("id"), "ts"), ["user_id", "id"], "ts")
    both = relations.join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), "id")
    return windows.ranked(both, ["user_id"], [F.desc("last_seen_at"), F.col("id")], 3).select("user_id", "id", "name", "rank")


@add("j8_runs_of_experiences", "SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment <> 'BUILDING') WHERE rank <= 2")
def j8(spark, d):
    experiences = table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").select("c_custkey")
    runs = reports.joined(table(spark, d, "orders"), experiences, {"o_custkey": "c_custkey"})
    return windows.ranked(runs, ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")], 2).select("o_custkey", "o_orderkey", "rank")


@add("j10_cases_with_events", "SELECT o_orderkey, o_orderstatus, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'P' AND c_mktsegment = 'MACHINERY'")
def j10(spark, d):
    cases, events = read.where_given(table(spark, d, "orders"), o_orderstatus="P"), read.where_given(table(spark, d, "customer"), c_mktsegment="MACHINERY")
    return reports.joined(cases, events, {"o_custkey": "c_custkey"}).select("o_orderkey", "o_orderstatus", "c_name")


@add("j19_in_order", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (42, 7, 1000, 3) ORDER BY list_position([42, 7, 1000, 3], c_custkey)")
def j19(spark, d):
    return read.in_order(table(spark, d, "customer").select("c_custkey", "c_name"), [42, 7, 1000, 3], "c_custkey")


@add("k2_upsert_conversations", "SELECT coalesce(s.id, i.id) AS id, coalesce(s.name, i.name) AS name, least(s.first_at, i.first_at) AS first_at, greatest(s.last_at, i.last_at) AS last_at FROM (SELECT user_id AS id, min(event_type) AS name, min(ts) AS first_at, max(ts) AS last_at FROM events WHERE value < 60 GROUP BY 1) s FULL JOIN (SELECT user_id AS id, 'new' AS name, min(ts) AS first_at, max(ts) AS last_at FROM events WHERE value >= 40 GROUP BY 1) i ON s.id = i.id")
def k2(spark, d):
    e = table(spark, d, "events")
    stored = e.where("value < 60").groupBy(F.col("user_id").alias("id")).agg(F.min("event_type").alias("name"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))
    # incoming rows of one key are merged before
    new = e.where("value >= 40").select(F.col("user_id").alias("id"), F.lit("new").alias("name"), F.col("ts").alias("first_at"), F.col("ts").alias("last_at"))
    return merge.upsert(stored, new, ["id"], {"name": "keep", "first_at": "min", "last_at": "max"})


@add("k7_insert_ignore_envelopes", "SELECT sha256(event_type || ':' || props) AS content_hash, min(event_id) AS event_id FROM events WHERE value >= 10 AND sha256(event_type || ':' || props) NOT IN (SELECT sha256(event_type || ':' || props) FROM events WHERE value < 10) GROUP BY 1")
def k7(spark, d):
    e = table(spark, d, "events").withColumn("content_hash", K.value_hash(F.col("event_type"), F.col("props")))
    return merge.insert_new(e.where("value < 10"), e.where("value >= 10"), ["content_hash"], [F.col("event_id")]).select("content_hash", "event_id")


@add("k12_enrichment_state", "SELECT coalesce(s.kind, i.kind) AS kind, coalesce(s.id, i.id) AS id, coalesce(i.at, s.at) AS at FROM (SELECT o_orderpriority AS kind, o_custkey AS id, max(o_orderdate) AS at FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2) s FULL JOIN (SELECT o_orderpriority AS kind, o_custkey AS id, arg_max(o_orderdate, o_orderkey) AS at FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2) i ON s.kind = i.kind AND s.id = i.id")
def k12(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("kind"), F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("at"), "o_orderstatus", "o_orderkey")
    stored = o.where("o_orderstatus = 'F'").groupBy("kind", "id").agg(F.max("at").alias("at"))
    return merge.upsert(stored, o.where("o_orderstatus <> 'F'"), ["kind", "id"], {"at": "set"}, [F.col("o_orderkey")])


@add("k15_update_by_key", "SELECT c_custkey, coalesce(best, c_acctbal) AS score FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS best FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def k15(spark, d):
    stored = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("score"))
    # only keys that are stored
    best = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("score"))
    return merge.upsert(stored, best.join(stored.select("c_custkey"), "c_custkey", "left_semi"), ["c_custkey"], {"score": "set"})


@add("k5_mark_processed", "SELECT event_id, CASE WHEN event_type = 'click' THEN ts WHEN value > 20 THEN TIMESTAMP '2024-02-01' END AS normalized_at FROM events")
def k5(spark, d):
    e = table(spark, d, "events").select("event_id", "value", F.when(F.col("event_type") == "click", F.col("ts")).alias("normalized_at"))
    return merge.mark_processed(e, e.where("value > 20"), "event_id", F.lit("2024-02-01").cast("timestamp_ntz")).select("event_id", "normalized_at")


@add("k18_recommendations", "SELECT o_orderkey AS case_id, CASE WHEN o_orderstatus = 'O' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N') THEN 'recommendation_ready' WHEN o_orderstatus = 'O' THEN 'open' ELSE o_orderstatus END AS status FROM orders")
def k18(spark, d):
    cases = table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.when(F.col("o_orderstatus") == "O", "open").otherwise(F.col("o_orderstatus")).alias("status"))
    told = table(spark, d, "lineitem").where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("case_id"), "l_linenumber")
    return merge.recommend(cases, told)[1].select("case_id", "status")


@add("w9_first_conversation", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def w9(spark, d):
    # the smallest id, as no order is asked for
    return windows.first_of(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@add("l12_newest_runs", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200")
def l12(spark, d):
    return read.newest(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 200)


@add("l6_cursor_page", "SELECT c_custkey, c_name FROM customer WHERE c_custkey > 900 ORDER BY c_custkey LIMIT 201")
def l6(spark, d):
    # a page that asks for too many rows gets the most that is given
    at = int(read.read_cursor(read.cursor("c", "900"))[1])
    return read.after(table(spark, d, "customer").select("c_custkey", "c_name"), [("c_custkey", False)], [at], read.page_size(10_000))


@add("h5_parsed_json", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN props ELSE '\"' || event_type || ' said \\\"x' || '\"' END AS value FROM events")
def h5(spark, d):
    raw = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat("event_type", F.lit(' said "x')))
    parsed = K.parsed_json(raw)
    same = F.col("event_id") % 2 == 0
    # numbers may be spelt otherwise, so the parsed form is shown where it differs from the text's
    return table(spark, d, "events").select("event_id", F.when(same & (F.get_json_object(parsed, "$.k") == F.get_json_object("props", "$.k")), F.col("props")).otherwise(parsed).alias("value"))


@add("h7_first_text", "SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 3 = 0 AND text <> '' THEN text WHEN (conv_id + turn) % 3 = 1 THEN 'caption' END AS text FROM conversations")
def h7(spark, d):
    n = (F.col("conv_id") + F.col("turn")) % 3
    full = F.to_json(F.struct(F.col("text").alias("conversation")))
    message = F.when(n == 0, full).when(n == 1, '{"conversation": "", "extendedTextMessage": {"text": 5}, "imageMessage": null, "documentMessage": {"caption": "caption"}}').otherwise("[1]")
    return table(spark, d, "conversations").select("conv_id", "turn", K.first_text(message).alias("text"))


@add("p14_response_shape", "SELECT c_custkey AS id, c_name AS name, nullif(c_mktsegment, 'BUILDING') AS kind, c_acctbal > 0 AS active FROM customer")
def p14(spark, d):
    return read.shown(table(spark, d, "customer"), {"id": "c_custkey", "name": "c_name", "kind": F.nullif("c_mktsegment", F.lit("BUILDING")), "active": F.col("c_acctbal") > 0})


@add("p15_message_view", "SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'OUTBOUND' ELSE 'INBOUND' END AS direction, CASE WHEN turn % 3 = 0 OR trim(text) = '' THEN '[sem texto extraído]' ELSE text END AS content, ['TEXT', 'AUDIO', 'IMAGE', 'PDF', 'TEXT', 'TEXT'][turn % 6 + 1] AS type FROM conversations")
def p15(spark, d):
    kinds = F.array(*map(F.lit, ["", "ptt", "imageMessage", "documentMessage", "stickerMessage", "extendedTextMessage"]))
    view = read.message_view(F.element_at(kinds, (F.col("turn") % 6 + 1).cast("int")), F.col("role") == "assistant", F.when(F.col("turn") % 3 == 0, "  ").otherwise(F.col("text")))
    return table(spark, d, "conversations").select("conv_id", "turn", *[c.alias(n) for n, c in view.items() if n != "raw_type"])


@add("p15_timeline_view", "SELECT event_id, CASE WHEN event_type = 'click' THEN 'MESSAGE' WHEN event_type = 'purchase' THEN 'OPPORTUNITY' ELSE 'SIGNAL' END AS type FROM events")
def p15_timeline(spark, d):
    t = F.col("event_type")
    return table(spark, d, "events").select("event_id", read.timeline_view(F.when(t == "click", "last_message").when(t == "purchase", "New opportunity").otherwise(F.lit(" "))).alias("type"))


@add("sliding_rate_count", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS recent FROM events")
def sliding(spark, d):
    return windows.sliding_count(table(spark, d, "events"), "user_id", "ts", 3600).select("event_id", "recent")


@add("cursors_advanced", "SELECT coalesce(e.event_type, c.event_type) AS source, greatest(e.at, c.at) AS cursor FROM (SELECT event_type, max(ts) AS at FROM events GROUP BY 1) e FULL JOIN (SELECT event_type, min(ts) AS at FROM events WHERE event_type <> 'click' GROUP BY 1) c ON e.event_type = c.event_type")
def cursors(spark, d):
    e = table(spark, d, "events")
    known = e.where("event_type <> 'click'").groupBy(F.col("event_type").alias("source")).agg(F.min("ts").alias("cursor"))
    return tables.advanced(known, e, "event_type", "ts")


@add("since_cursors", "SELECT event_id FROM events LEFT JOIN (SELECT event_type AS t, max(ts) AS seen FROM events WHERE event_type <> 'click' GROUP BY 1) ON t = event_type WHERE seen IS NULL OR ts > seen - INTERVAL 48 HOURS")
def since_cursors(spark, d):
    e = table(spark, d, "events")
    known = e.where("event_type <> 'click'").groupBy(F.col("event_type").alias("source")).agg(F.max("ts").alias("cursor"))
    return tables.since_cursors(e, known, "event_type", "ts", 48).select("event_id")


@add("s5_configured_readers", "SELECT 'events' AS source, event_id::VARCHAR AS id FROM events UNION ALL SELECT 'orders', 'o' || o_orderkey FROM orders")
def s5(spark, d):
    s = tables.Sources()
    s.adapters["as events"] = lambda df: df.select(F.lit("events").alias("source"), F.col("event_id").cast("string").alias("id"))
    s.reader("orders")(lambda spark, o: table(spark, o["folder"], "orders").select(F.lit("orders").alias("source"), F.concat(F.lit("o"), "o_orderkey").alias("id")))
    config = [{"type": "parquet", "folder": d, "name": "events", "adapter": "as events"}, {"type": "orders", "folder": d}, {"type": "parquet", "folder": d, "name": "pages", "enabled": False}]
    return s.read(spark, config)


@add("s10_recorded_events", "SELECT event_id, 'observation.recorded' AS event_type, 'segment' AS key, event_type AS value, user_id || '@x.co' AS identity FROM events")
def s10(spark, d):
    who = F.array(F.struct(F.lit("email").alias("type"), F.concat("user_id", F.lit("@x.co")).alias("value")))
    made = ingest.recorded_observation(F.col("event_id").cast("string"), F.col("ts").cast("string"), who, F.lit("segment"), F.col("event_type"), F.lit(0.5))
    get = lambda path: F.get_json_object(made, path)
    return table(spark, d, "events").select("event_id", get("$.event_type").alias("event_type"), get("$.data.key").alias("key"), get("$.data.value").alias("value"), get("$.subject.identities[0].value").alias("identity"))


# Chat rows: ids of the conversations make jids of all kinds, some in upper case; texts are those of the table.
JIDS = "SELECT *, (conv_id + turn) % 6 AS n, [conv_id || '@s.whatsapp.net', conv_id || '@g.us', conv_id || '@lid', 'status@broadcast', conv_id || '@G.US', '12@Newsletter'][(conv_id + turn) % 6 + 1] AS jid FROM conversations"


def jids(spark, d):
    c = table(spark, d, "conversations")
    n, i = (F.col("conv_id") + F.col("turn")) % 6, F.col("conv_id").cast("string")
    kinds = F.array(*[F.concat(i, F.lit(x)) for x in ("@s.whatsapp.net", "@g.us", "@lid")], F.lit("status@broadcast"), F.concat(i, F.lit("@G.US")), F.lit("12@Newsletter"))
    return c.withColumn("n", n).withColumn("jid", F.element_at(kinds, (n + 1).cast("int")))


@add("p11_conversational_filter", f"SELECT conv_id, turn FROM ({JIDS}) WHERE NOT (ends_with(lower(jid), '@broadcast') OR ends_with(lower(jid), '@newsletter')) AND role <> 'system' AND turn % 4 <> 3")
def p11_messages(spark, d):
    kind = F.when(F.col("role") == "system", "protocolMessage").when(F.col("turn") % 4 == 3, "call").otherwise("conversation")
    return jids(spark, d).where(extract.conversational(F.col("jid"), kind, F.lit("2024-01-01").cast("timestamp_ntz"))).select("conv_id", "turn")


@add("f15_subjects", f"SELECT conv_id, turn, CASE WHEN n IN (1, 4) THEN '+5' || turn WHEN n = 3 THEN NULL WHEN n = 5 THEN '+12' ELSE '+' || conv_id END AS subject FROM ({JIDS})")
def f15(spark, d):
    return jids(spark, d).select("conv_id", "turn", extract.subject(F.col("jid"), F.concat(F.lit("5"), "turn", F.lit("@s.whatsapp.net"))).alias("subject"))


@add("f16_jid_tests", f"SELECT conv_id, turn, n IN (1, 4) AS is_group, n = 2 AS is_lid FROM ({JIDS})")
def f16(spark, d):
    return jids(spark, d).select("conv_id", "turn", K.is_group(F.col("jid")).alias("is_group"), K.is_lid(F.col("jid")).alias("is_lid"))


@add("f1_f2_f4_jids", f"SELECT conv_id, turn, CASE WHEN n = 0 THEN conv_id::VARCHAR END AS phone, CASE n WHEN 0 THEN 'individual' WHEN 1 THEN 'grupo' WHEN 2 THEN 'lid' WHEN 3 THEN 'broadcast' ELSE 'desconhecido' END AS chat, CASE n WHEN 0 THEN conv_id::VARCHAR WHEN 1 THEN '5' || turn WHEN 2 THEN 'lid:' || conv_id WHEN 3 THEN 'broadcast:status' ELSE 'unknown:m' || turn END AS contact FROM ({JIDS})")
def f1(spark, d):
    j, none = F.col("jid"), F.lit("{}")
    return jids(spark, d).select("conv_id", "turn", K.phone_of_jid(j).alias("phone"), K.chat_type(j).alias("chat"), K.contact_id(j, F.concat(F.lit("5"), "turn", F.lit("@s.whatsapp.net")), none, F.concat(F.lit("m"), "turn")).alias("contact"))


@add("f3_push_names", "SELECT c_custkey, c_custkey % 4 IN (1) AS useful FROM customer")
def f3(spark, d):
    names = F.array(F.lit(" Você "), F.col("c_name"), F.concat(F.lit("+55 11 "), F.lpad(F.col("c_custkey").cast("string"), 8, "9")), F.lit("x"))
    return table(spark, d, "customer").select("c_custkey", K.useful_push_name(F.element_at(names, (F.col("c_custkey") % 4 + 1).cast("int"))).alias("useful"))


@add("f7_f8_addresses", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN lower(replace(c_name, '#', '.')) || '@x.co' END AS email, CASE c_custkey % 3 WHEN 0 THEN '+551' || lpad(c_custkey::VARCHAR, 9, '0') WHEN 1 THEN '+' || lpad(c_custkey::VARCHAR, 9, '1') END AS phone FROM customer")
def f7(spark, d):
    k = F.col("c_custkey")
    number = lambda n, by: F.lpad(k.cast("string"), n, by)
    mail = F.when(k % 2 == 0, F.concat(F.lit(" "), F.regexp_replace("c_name", "#", "."), F.lit("@X.co "))).otherwise(F.concat("c_name", F.lit("@x")))
    phone = F.when(k % 3 == 0, F.concat(F.lit("(1"), number(9, "0"), F.lit(")"))).when(k % 3 == 1, F.concat(F.lit("+"), number(9, "1"))).otherwise(F.concat(F.lit("9"), number(5, "0")))
    return table(spark, d, "customer").select("c_custkey", K.email(mail).alias("email"), K.phone_e164(phone).alias("phone"))


@add("f10_f11_f12_f17_companies", "SELECT s_suppkey, lpad(s_suppkey::VARCHAR, 14, '7') AS cnpj, left(lpad(s_suppkey::VARCHAR, 14, '7'), 8) AS root, 'supplier' || split_part(s_name, '#', 2) AS name, 'supplier' || s_suppkey AS handle FROM supplier")
def f10(spark, d):
    number = F.lpad(F.col("s_suppkey").cast("string"), 14, "7")
    shown = F.concat(F.substring(number, 1, 2), F.lit("."), F.substring(number, 3, 3), F.lit("."), F.substring(number, 6, 3), F.lit("/"), F.substring(number, 9, 4), F.lit("-"), F.substring(number, 13, 2))
    return table(spark, d, "supplier").select("s_suppkey", K.cnpj(shown).alias("cnpj"), K.cnpj_root(shown).alias("root"), K.company_name(F.concat(F.lit(" "), "s_name", F.lit("  Ltda."))).alias("name"), K.handle(F.concat(F.lit("@@Supplier"), "s_suppkey", F.lit("/?a=b"))).alias("handle"))


@add("f13_identities", "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 2 THEN 'phone' ELSE 'visitor' END AS type, CASE WHEN c_custkey % 3 <> 2 THEN '+551' || lpad(c_custkey::VARCHAR, 9, '0') ELSE c_name END AS value, c_custkey % 3 <> 2 AS strong FROM customer")
def f13(spark, d):
    k = F.col("c_custkey")
    kind, value = F.when(k % 3 == 0, " Phone").when(k % 3 == 1, "whatsapp").otherwise("Visitor"), F.when(k % 3 == 2, F.col("c_name")).otherwise(F.concat(F.lit("1"), F.lpad(k.cast("string"), 9, "0")))
    i = K.identity(kind, value)
    return table(spark, d, "customer").select("c_custkey", i["type"].alias("type"), i["value"].alias("value"), i["strong"].alias("strong"))


@add("h2_h13_payloads", "SELECT event_id, sha256('{\"a\":' || json_extract_string(props, '$.k') || ',\"b\":{\"c\":1,\"d\":2}}') AS hash, CASE WHEN event_id % 2 = 0 THEN ts WHEN event_id % 3 <> 0 THEN TIMESTAMP '1970-01-01' + to_seconds(event_id) END AS at FROM events")
def h2(spark, d):
    k = F.get_json_object("props", "$.k")
    body = F.concat(F.lit('{"b": {"d": 2, "c": 1}, "a": '), k, F.lit("}"))
    at = K.event_time(F.when(F.col("event_id") % 2 == 0, F.col("ts")), F.when(F.col("event_id") % 3 != 0, F.col("event_id")).otherwise(0))
    return table(spark, d, "events").select("event_id", K.payload_hash(body).alias("hash"), at.cast("timestamp_ntz").alias("at"))


@add("h6_message_text", "SELECT conv_id, turn, CASE (conv_id + turn) % 3 WHEN 0 THEN nullif(text, '') WHEN 1 THEN text END AS text FROM conversations")
def h6(spark, d):
    n, t = (F.col("conv_id") + F.col("turn")) % 3, F.col("text")
    message = F.when(n == 0, F.to_json(F.struct(t.alias("conversation")))).when(n == 1, F.to_json(F.struct(F.struct(t.alias("caption")).alias("imageMessage")))).otherwise(F.lit('{"conversation": null, "imageMessage": {"caption": "not read"}}'))
    return table(spark, d, "conversations").select("conv_id", "turn", K.message_text(message).alias("text"))


@add("j4_persons_of_workspace", "SELECT count(*) AS n, min(c_custkey) AS least FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def j4(spark, d):
    members = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("workspace_id"))
    return read.of_workspace(table(spark, d, "customer"), members, "c_nationkey", 2).agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("least"))


@add("p7_interaction_filter", "SELECT event_id, ts FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-10'")
def p7(spark, d):
    import datetime

    rows = table(spark, d, "events").select("event_id", F.concat(F.lit("interaction."), "event_type").alias("event_type"), F.col("ts").alias("occurred_at"), F.lit("{}").alias("data"), *[F.lit(None).cast("string").alias(c) for c in ("channel", "direction", "run_id")])
    return read.where_given(facts.interactions(rows), interaction_type="click", occurred_at__ge=datetime.datetime(2024, 1, 10)).select("event_id", F.col("occurred_at").alias("ts"))
