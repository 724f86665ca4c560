"""Raw chat rows by literal cases."""

from tesselar.operators import normalize

SCHEMA = "external_message_id string, whatsapp_message_id string, source_account_id string, instance_name string, remote_jid string, participant string, from_me boolean, push_name string, message_type string, message_timestamp long, message_datetime timestamp, raw_key string, raw_message string, loaded_at long"


def row(i, jid, **over):
    base = {"external_message_id": i, "whatsapp_message_id": None, "source_account_id": "acc", "instance_name": None, "remote_jid": jid, "participant": None, "from_me": False, "push_name": None, "message_type": "conversation", "message_timestamp": 1_700_000_000, "message_datetime": None, "raw_key": None, "raw_message": '{"conversation":"oi"}', "loaded_at": 1}
    return tuple((base | over).values())


def test_messages_contacts_conversations(spark):
    raw = spark.createDataFrame([
        row("m1", "55@s.whatsapp.net", push_name="Ana"), row("m1", "55@s.whatsapp.net", loaded_at=2, raw_message='{"conversation":"later"}'), row("m2", "9@g.us", participant="77@s.whatsapp.net", push_name="5511"),
        row("m3", "9@g.us"), row("m4", "55@s.whatsapp.net", from_me=True, push_name="Me", message_timestamp=0), row(None, None, whatsapp_message_id="w"),
    ], SCHEMA)
    m = normalize.messages(raw)
    got = {r.message_id: r for r in m.collect()}
    assert set(got) == {"m1", "m2", "m3", "m4", "w"}
    assert (got["m1"].text, got["m1"].contact_id, got["m1"].conversation_id, got["m1"].name) == ("oi", "55", "acc:55@s.whatsapp.net", "Ana")
    assert (got["m2"].contact_id, got["m2"].conversation_contact_id, got["m2"].name) == ("77", "group:9", None)
    assert got["m3"].contact_id == "group:9" and got["m4"].name == "Me" and got["m2"].phone == "77" and got["m4"].sent_at is None and got["w"].contact_id == "unknown:w"
    c = {r.contact_id: r for r in normalize.contacts(m).collect()}
    assert set(c) == {"55", "77", "group:9", "unknown:w"} and (c["55"].name, c["55"].phone, c["55"].messages) == ("Ana", "55", 2) and c["group:9"].messages == 1
    assert c["77"].phone is None and c["77"].kind == "desconhecido"
    silent = {r.contact_id: r for r in normalize.contacts(m.where("message_id = 'm2'")).collect()}
    assert silent["group:9"].messages == 0 and silent["group:9"].kind == "grupo" and silent["group:9"].first_at is not None
    v = {r.conversation_id: r for r in normalize.conversations(m).collect()}
    assert v["acc:9@g.us"].messages == 2 and v["acc:9@g.us"].contact_id == "group:9"
