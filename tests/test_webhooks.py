"""Webhook bodies of mixed sources in one stream: adapters, wrapped bodies, poison kept and counted."""

import hashlib
import json

from pyspark.sql import functions as F

from tesselar.operators import gateway
from tesselar.sources.store import Store
from tesselar.streaming import webhooks

ENDPOINTS = [
    ("crm", "crm", "active", "score.calculated", None, None), ("site", "site", "active", "observation.recorded", "meta.id", "meta.at"), ("old", "site", "disabled", None, None, None), ("plain", "plain", "active", None, None, None),
]


def crm():
    """An adapter of a type of its own: lines of 'key=value'."""
    key, value = F.split_part("body", F.lit("="), F.lit(1)), F.split_part("body", F.lit("="), F.lit(2))
    data = F.struct(key.alias("score_key"), value.try_cast("double").alias("score_value"))
    return F.when(F.contains("body", F.lit("=")), F.struct(F.concat(F.lit("crm-"), F.md5("body")).alias("event_id"), F.col("event_type").alias("event_type"), F.col("received_at").alias("occurred_at"), F.to_json(F.struct(data.alias("data"))).alias("payload")))


def test_mixed_sources_and_poison(spark, tmp_path):
    ends = spark.createDataFrame(ENDPOINTS, "source_key string, source_type string, status string, event_type string, event_id_path string, occurred_at_path string")
    known = spark.createDataFrame([], "experience_key string, experience_version string")
    line = lambda source, body, minute=0: json.dumps({"source_key": source, "body": body, "received_at": f"2024-01-01T00:{minute:02d}:00"})
    site = json.dumps({"key": "k", "value": 5, "meta": {"id": "a1", "at": "2023-05-06T07:08:09Z"}})
    files = [
        [line("crm", "x=4"), line("site", site), "{ this is no json", line("none", "{}"), line("old", "{}"), line("crm", "nothing"), "[1, 2]"],
        [line("site", site, 1), line("site", json.dumps({"key": "k", "value": 6, "meta": {"id": "a1"}}), 2), line("site", "not json", 3), line("site", "[1,2]", 4), line("plain", "", 5), line("crm", "y=5", 6)],
    ]
    folder, store = tmp_path / "in", Store(spark, str(tmp_path / "store"), buckets=4)
    folder.mkdir()
    for n, lines in enumerate(files):
        (folder / f"{n}.json").write_text("\n".join(lines))
        webhooks.webhooks(spark, str(folder), store, ends, known, str(tmp_path / "state"), {"crm": crm}).awaitTermination()
    log = {(r.source, r.event_id): (r.event_type, r.status, r.occurred_at.isoformat()) for r in store.read("log", gateway.SCHEMAS["log"]).collect()}
    hashed = lambda source, body: hashlib.sha256(f"{source}:{body}".encode()).hexdigest()
    md5 = lambda x: "crm-" + hashlib.md5(x.encode()).hexdigest()
    assert log == {
        ("crm", md5("x=4")): ("score.calculated", "processed", "2024-01-01T00:00:00"), ("crm", md5("y=5")): ("score.calculated", "processed", "2024-01-01T00:06:00"),
        ("site", "a1"): ("observation.recorded", "processed", "2023-05-06T07:08:09"), ("site", hashed("site", "not json")): ("observation.recorded", "processed", "2024-01-01T00:03:00"),
        ("site", hashed("site", "[1,2]")): ("observation.recorded", "processed", "2024-01-01T00:04:00"), ("plain", hashed("plain", "")): ("webhook.received", "failed", "2024-01-01T00:05:00"),
    }
    aside = sorted((r.source_key or "", r.reason) for r in store.read("quarantine", webhooks.QUARANTINE).collect())
    assert aside == [("", "unreadable"), ("", "unreadable"), ("crm", "adapter found no event"), ("none", "unknown endpoint"), ("old", "endpoint disabled")]
    assert sorted((r.score_key, r.score_value) for r in store.read("scores", gateway.SCHEMAS["scores"]).collect()) == [("x", 4.0), ("y", 5.0)]
    assert [(r.key, r.value) for r in store.read("observations", gateway.SCHEMAS["observations"]).collect()] == [("k", "5")]
    # the other content under the same id leaves the original as it is, with a case
    assert sorted((r.event_id, r.case_type) for r in store.read("cases", gateway.SCHEMAS["cases"]).collect()) == [("a1", "event_id_conflict")]


def test_wrapped_bodies(spark):
    bodies = ['{"a":{"b":"x"},"t":"2020-01-02T03:04:05+02:00"}', "5", '"s"', "oops", "", None]
    df = spark.createDataFrame([("s", b, None, "a.b", "t") for b in bodies], "source_key string, body string, event_type string, event_id_path string, occurred_at_path string")
    rows = df.withColumn("received_at", F.lit("2024-01-01").cast("timestamp_ntz")).select(webhooks.passthrough().alias("e")).select("e.*").collect()
    assert [json.loads(r.payload)["data"] for r in rows] == [{"a": {"b": "x"}, "t": "2020-01-02T03:04:05+02:00"}, {"value": 5}, {"value": "s"}, {"_raw": "oops"}, {}, {}]
    assert rows[0].event_id == "x" and rows[0].occurred_at.isoformat() == "2020-01-02T01:04:05" and rows[4].event_id == hashlib.sha256(b"s:").hexdigest()
