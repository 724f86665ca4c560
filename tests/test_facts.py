"""Extraction and facts: literal cases."""

import datetime as dt

from pyspark.sql import functions as F

from tesselar.operators import extract, facts

AT = dt.datetime(2024, 1, 1)
CHAT = "source_key string, external_key string, captured_at timestamp_ntz, remote_jid string, participant string, from_me boolean, message_type string, text string"


def test_extraction(spark):
    rows = [
        ("s", "1", AT, "55@s.whatsapp.net", None, False, "conversation", "meu email é eu@gmail.com"), ("s", "2", AT, "1@broadcast", None, False, "conversation", "motorista"), ("s", "3", dt.datetime(1970, 1, 1), "55@s.whatsapp.net", None, False, None, "motorista"),
        ("s", "4", AT, "55@s.whatsapp.net", None, False, "reactionMessage", "motorista"), ("s", "5", AT, "9@g.us", None, False, None, "motorista"), ("s", "6", AT, "9@g.us", "7@lid", None, None, None), ("s", "7", AT, "88@s.whatsapp.net", None, True, None, "frete"),
        ("s", "8", AT, None, None, None, None, ""), ("s", "9", AT, "77@s.whatsapp.net", None, False, None, "motorista"),
    ]
    got = [(r.external_key, r.subject, r.event_type.split(".")[0], r.key) for r in extract.extract(spark.createDataFrame(rows, CHAT), ["+77"]).collect()]
    want = [("1", "+55", "interaction", None), ("1", "+55", "observation", "mentioned_email"), ("6", "+7", "interaction", None), ("7", "+88", "interaction", None), ("7", "+88", "observation", "affiliation"), ("9", "+77", "interaction", None)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert extract.extract(spark.createDataFrame([], CHAT)).count() == 0


def test_experience_run(spark):
    schema = "source string, event_type string, occurred_at timestamp_ntz, arrival long, data string, run_id string, experience_key string, experience_version string, person_id string"
    kinds = [("run_started", "{}", None), ("answer_recorded", '{"question_key":"a","value":1}', None), ("answer_recorded", '{"question_key":"a","value":2}', None), ("answer_recorded", "{}", None), ("identity_captured", "{}", "p1"), ("identity_captured", "{}", "p2"), ("run_completed", '{"score":87}', None)]
    rows = [("s", f"experience.{k}", AT + dt.timedelta(minutes=i), i, data, "r", "form", "1", p) for i, (k, data, p) in enumerate(kinds)]
    rows += [("s", "experience.run_started", AT, 90, "{}", "r", "none", "1", None), ("s", "experience.run_started", AT, 91, None, "r2", "form", "1", None), ("s", "experience.run_started", AT, 92, "{}", None, None, "1", None)]
    known = spark.createDataFrame([("form", "1"), ("form", "1")], "experience_key string, experience_version string")
    valid = facts.valid_experience(spark.createDataFrame(rows, schema).repartition(3), known)
    assert {r.arrival: r.error for r in valid.where("error IS NOT NULL").collect()} == {3: "VALIDATION_ERROR", 90: "EXPERIENCE_NOT_FOUND", 92: "VALIDATION_ERROR"}
    runs = {r.run_id: r for r in facts.runs(valid).collect()}
    assert (runs["r"].status, runs["r"].person_id, runs["r"].answers, runs["r"].score, runs["r"].completed_at) == ("completed", "p1", 2, 87.0, AT + dt.timedelta(minutes=6))
    assert (runs["r2"].status, runs["r2"].answers, runs["r2"].score) == ("started", 0, None)


def test_extracted_payloads(spark):
    import json

    rows = [("s", "1", AT, "55@s.whatsapp.net", None, False, "imageMessage", "meu email é ana@firma.com.br", "Ana"), ("s", "2", AT, "66@lid", None, False, None, None, None), ("s", "3", AT, "77@s.whatsapp.net", None, False, "conversation", "oi", "Eu")]
    df = spark.createDataFrame(rows, CHAT + ", push_name string")
    got = {(r.external_key, r.key): (r, json.loads(r.payload)) for r in extract.extract(df, ["+77"]).collect()}
    r, p = got["1", None]
    assert p["subject"]["identities"] == [{"type": "whatsapp_jid", "value": "+55"}] and p["context"] == {"channel": "whatsapp", "direction": "inbound"}
    assert p["data"] == {"channel": "whatsapp", "direction": "inbound", "message_type": "imageMessage", "has_media": True, "external_interaction_id": "1", "source_ref": "s:1", "push_name": "Ana"}
    r, p = got["1", "email"]
    assert p["subject"]["identities"] == [{"type": "whatsapp_jid", "value": "+55"}, {"type": "email", "value": "ana@firma.com.br"}] and p["data"] == {"name": "Ana"}
    r, p = got["1", "mentioned_email"]
    assert p["data"] == {"key": "mentioned_email", "value": "ana@firma.com.br", "confidence": 0.5, "source_kind": "extracted", "source_ref": "s:1"}
    # another kind of id, no media without a type; an own number is no identity, and its text tells nothing
    assert got["2", None][1]["subject"]["identities"] == [{"type": "whatsapp_lid", "value": "+66"}] and got["2", None][1]["data"]["has_media"] is False
    assert got["3", None][1]["subject"]["identities"] == [] and not any(k == "3" and key for k, key in got)


def test_limits_of_pages(spark):
    from tesselar.operators import read

    df = spark.range(600).select("id", (F.col("id") % 7).alias("at"))
    assert read.message_page(df, "at", ["id"], limit=9_000).count() == 500 and read.message_page(df, "at", ["id"], limit=-1).count() == 1
    assert [r.id for r in read.message_page(df, "at", ["id"], descending=False, limit=2, offset=1).collect()] == [7, 14]
    assert read.page_of(df, "id", ["id"], False, "id", size=1).count() == 5 and read.page_of(df, "id", ["id"], False, "id", page=-3, size=900).count() == 100
