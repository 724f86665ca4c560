"""Idempotency: literal sequences, in one batch or several."""

from pyspark.sql import functions as F

from tesselar.functions import keys as K
from tesselar.operators import ingest

SCHEMA = "source string, event_id string, event_type string, schema_version string, payload string, arrival long"
ROWS = [
    ("s", "1", "observation.x", "1.0", '{"a":1,"b":2}', 1), ("s", "1", "observation.x", "1.2", '{"b":2,"a":1}', 2), ("s", "1", "observation.x", "1.0", '{"a":9}', 3), ("s", "1", "observation.x", "1.0", '{"a":9}', 4),
    ("t", "1", "observation.x", "1.0", '{"a":9}', 5), ("s", "2", "weird.x", "1.0", "{}", 6), ("s", "3", "score.x", "2.0", "{}", 7), ("s", "3", "score.x", "1.0", "{}", 8), ("s", "4", "score.x", None, "{}", 9),
]
WANT = ["accepted", "duplicate", "EVENT_ID_CONFLICT", "EVENT_ID_CONFLICT", "accepted", "VALIDATION_ERROR", "SCHEMA_UNSUPPORTED", "accepted", "SCHEMA_UNSUPPORTED"]


def test_one_batch(spark):
    got = ingest.decide(spark.createDataFrame(ROWS, SCHEMA).repartition(3))
    assert [r.decision for r in got.orderBy("arrival").collect()] == WANT
    assert [(r.source, r.event_id, r.seen) for r in ingest.cases(got).collect()] == [("s", "1", 2)]
    assert ingest.cases(got, ingest.cases(got)).count() == 0


def test_again_and_in_parts(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    first = ingest.stored_events(ingest.decide(df.where("arrival <= 2")))
    rest = ingest.decide(df.where("arrival > 2"), first)
    assert [r.decision for r in rest.orderBy("arrival").collect()] == WANT[2:]
    again = {r.decision for r in ingest.decide(df, ingest.stored_events(ingest.decide(df))).collect()}
    assert "accepted" not in again


def test_stored_events_of_each_state(spark):
    """A pending event is handled after a crash like a failed one; only equal arrivals count; an unknown family fails each time."""
    arrivals = [("s", k, "weird.x" if k == "u" else "score.x", "1.0", p, n) for n, (k, p) in enumerate([("p", "{}"), ("p", "{}"), ("f", '{"a":1}'), ("f", "{}"), ("f", "{}"), ("c", "{}"), ("c", '{"a":1}'), ("d", "{}"), ("u", "{}"), ("u", "{}"), ("n", "{}")])]
    stored = spark.createDataFrame([("s", k, "weird.x" if k == "u" else "score.x", "{}", s) for k, s in [("p", "pending"), ("f", "failed"), ("c", "conflict"), ("d", "processed"), ("u", "failed")]], "source string, event_id string, event_type string, payload string, status string")
    stored = stored.withColumn("payload_hash", K.payload_hash(F.col("payload"))).drop("payload")
    got = ingest.decide(spark.createDataFrame(arrivals, SCHEMA), stored).orderBy("arrival").collect()
    assert [r.decision for r in got] == ["retry", "duplicate", "EVENT_ID_CONFLICT", "retry", "duplicate", "IDENTITY_CONFLICT", "EVENT_ID_CONFLICT", "duplicate", "VALIDATION_ERROR", "VALIDATION_ERROR", "accepted"]


def test_payloads_are_parsed_once(spark):
    rows = [("s", "1", "score.set", "1.0", '{"a":1}', 0), ("s", "1", "score.set", "1.0", '{"a":2}', 1), ("s", "1", "score.set", "1.0", '{"a": 1}', 2)]
    df = ingest.decide(spark.createDataFrame(rows, "source string, event_id string, event_type string, schema_version string, payload string, arrival long"))
    assert "sha2" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert {r["arrival"]: r["decision"] for r in df.collect()} == {0: "accepted", 1: "EVENT_ID_CONFLICT", 2: "duplicate"}
