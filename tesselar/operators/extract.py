"""Events out of chat messages: an interaction for each, and what its text tells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselar.functions import keys as K
from tesselar.functions import text as T
from tesselar.functions.vocabulary import TECHNICAL_MESSAGES, Vocabulary

# Fixed values of the rules.
PRICED, NOT_TO_CONTACT, EARLIEST = ("cotacao", "valor", "frete"), ("motorista", "fornecedor"), "2020-01-01 00:00:00"
PLAIN_MESSAGES = ("conversation", "extendedTextMessage")
EVENT = "struct<event_type: string, key: string, value: string, confidence: double, source_kind: string>"


def conversational(jid: Column, message_type: Column, at: Column) -> Column:
    """Neither broadcast nor newsletter nor technical, and dated: what counts as a message."""
    lowered = F.lower(F.coalesce(jid, F.lit("")))
    noise = lowered.endswith("@broadcast") | lowered.endswith("@newsletter") | F.coalesce(message_type.isin(TECHNICAL_MESSAGES), F.lit(False))
    return ~noise & (at >= F.lit(EARLIEST).cast("timestamp_ntz"))


def subject(jid: Column, participant: Column) -> Column:
    """Phone-like id of the sender: the participant of a group, else the other side."""
    who = F.when(K.is_group(jid), participant).otherwise(jid)
    number = K.blank(K.digits(F.split_part(who, F.lit("@"), F.lit(1))))
    return F.when(number.isNotNull(), F.concat(F.lit("+"), number))


def relationship(intents: Column, roles: Column, vehicle: Column, platform: Column) -> Column:
    """Driver, supplier or lead, else null."""
    driver = T.has(roles, "motorista") | T.has(intents, "motorista") | (T.has(intents, "disponibilidade") & vehicle) | platform
    return F.when(driver, "motorista").when(T.has(intents, *PRICED) & vehicle, "fornecedor").when(T.has(intents, *PRICED), "lead")


def _event(kind: str, key: Column, value: Column, confidence: float | None, origin: str | None) -> Column:
    return F.struct(F.lit(kind).alias("event_type"), key.alias("key"), value.alias("value"), F.lit(confidence).cast("double").alias("confidence"), F.lit(origin).alias("source_kind"))


def extract(messages: DataFrame, own_numbers: list[str] = (), vocabulary: Vocabulary | None = None, kind_key: str = "relationship") -> DataFrame:
    """(source_key, external_key, subject, event_id, event_type, occurred_at, source_ref, key, value, confidence, source_kind, identities, payload).

    messages: source_key, external_key, captured_at, remote_jid, participant, from_me, message_type, text, and perhaps push_name. ``payload`` is the event's
    body, which the gateway reads; see ``as_events``. An interaction tells the sender's id (of its kind, but never an own number), the channel, whether it has media and the name
    that the sender goes by; an identity tells that name, too. A message without a
    sender's number gives nothing, one without text its interaction alone; of an outbound text only the affiliation counts.
    Interactions carry no text. ``kind_key`` names the observation of the relationship. Ids are hashes of the parts, values as JSON, so extracting again gives the same events.
    """
    v, none = vocabulary or Vocabulary(), F.lit(None).cast("string")
    messages = messages if "push_name" in messages.columns else messages.withColumn("push_name", none)
    rows = messages.where(conversational(F.col("remote_jid"), F.col("message_type"), F.col("captured_at"))).withColumn("subject", subject(F.col("remote_jid"), F.col("participant"))).where("subject IS NOT NULL")
    text, sent = F.col("text"), F.coalesce("from_me", F.lit(False))
    roles = {k: w for k, w in v.roles.items() if k != "lead"}
    found = rows.withColumns({
        "_cnpjs": F.array_distinct(T.cnpjs(text)), "_emails": F.array_distinct(T.emails(text)), "_own_cnpjs": T.self_declared_cnpjs(text), "_own_emails": T.self_declared_emails(text), "_intents": T.intents(text, v.intents),
        "_types": T.keywords(text, v.vehicle_types), "_bodies": T.keywords(text, v.vehicle_bodies), "_roles": T.keys_present(text, roles), "_platform": F.size(T.platform_mentions(text)) > 0, "_affiliation": T.affiliation(text),
    })
    vehicle = (F.size("_types") > 0) | (F.size("_bodies") > 0)
    found = found.withColumn("_kind", relationship(F.col("_intents"), F.col("_roles"), vehicle, F.col("_platform")))
    obs = lambda key, value, confidence, origin: _event("observation.recorded", F.lit(key), value, confidence, origin)
    identity = lambda key, value: _event("identity.observed", F.lit(key), value, None, None)
    signal = F.to_json(F.struct(F.col("_intents").alias("intents"), F.col("_types").alias("vehicle_types"), F.col("_bodies").alias("vehicle_bodies"), F.col("_roles").alias("roles"), F.col("_platform").alias("fretebras")))
    company = lambda value: F.to_json(F.struct(F.lit("internal").alias("type"), value.alias("empresa")))
    inbound = F.concat(
        F.transform("_cnpjs", lambda x: obs("mentioned_cnpj", x, 0.5, "extracted")),
        F.transform(F.filter("_cnpjs", lambda x: F.array_contains("_own_cnpjs", x)), lambda x: identity("cnpj", F.coalesce(K.cnpj(x), x))),
        F.transform("_emails", lambda x: obs("mentioned_email", x, 0.5, "extracted")),
        F.transform(F.filter("_emails", lambda x: F.array_contains("_own_emails", x) & ~K.generic_webmail(x)), lambda x: identity("email", F.lower(x))),
        F.array_compact(F.array(
            F.when((F.size("_intents") > 0) | vehicle | (F.size("_roles") > 0) | F.col("_platform"), obs("whatsapp_signals", signal, 0.6, "extracted")),
            F.when(F.col("_kind").isNotNull(), obs(kind_key, F.col("_kind"), 0.5, "legacy_classifier_rerun")),
            F.when(F.col("_kind").isin(*NOT_TO_CONTACT), obs("policy.no_cold_outreach", F.lit("true"), 0.5, "derived")),
        )),
    )
    declared = F.array_compact(F.array(F.when(F.col("_affiliation").isNotNull(), obs("affiliation", company(F.col("_affiliation")), 0.7, "self_declared")).when(sent, obs("affiliation", company(none), 0.9, "structural"))))
    message = F.array(F.struct(F.concat(F.lit("interaction.message_"), F.when(sent, "sent").otherwise("received")).alias("event_type"), none.alias("key"), none.alias("value"), F.lit(None).cast("double").alias("confidence"), none.alias("source_kind")))
    silent = K.blank(text).isNull() | F.col("subject").isin(list(own_numbers))
    empty = F.array().cast(f"array<{EVENT}>")
    told = F.when(silent, empty).otherwise(F.concat(F.when(sent, empty).otherwise(inbound), declared))
    out = found.withColumn("source_ref", F.concat_ws(":", "source_key", "external_key")).select("*", F.inline(F.concat(message.cast(f"array<{EVENT}>"), told)))
    short = F.when(F.col("event_type").startswith("identity"), "identity").otherwise("obs")
    event_id = F.when(F.col("key").isNull(), F.concat(F.lit("msg:"), "external_key")).otherwise(K.deterministic_id(short, F.col("subject"), F.col("key"), F.col("value"), F.col("source_ref")))
    who = lambda kind, value: F.struct(kind.alias("type"), value.alias("value"))
    jid = who(F.lit("whatsapp_jid"), F.col("subject"))
    sender = who(F.when(K.is_lid(F.col("remote_jid")), "whatsapp_lid").otherwise("whatsapp_jid"), F.col("subject"))
    nobody = F.array().cast("array<struct<type: string, value: string>>")
    is_message, is_identity = F.col("key").isNull(), F.col("event_type").startswith("identity")
    identities = F.when(is_message, F.when(F.col("subject").isin(list(own_numbers)), nobody).otherwise(F.array(sender))).when(is_identity, F.array(jid, who(F.col("key"), F.col("value")))).otherwise(F.array(jid))
    named = out.withColumns({"event_id": event_id, "identities": identities, "direction": F.when(sent, "outbound").otherwise("inbound")})
    media = ~F.coalesce(F.col("message_type").isin(*PLAIN_MESSAGES), F.lit(True))
    spoken = F.struct(F.lit("whatsapp").alias("channel"), "direction", "message_type", media.alias("has_media"), F.col("external_key").alias("external_interaction_id"), "source_ref", "push_name")
    # values that are JSON already, and texts that have to be quoted
    quoted = F.to_json(F.array("value"))
    value = F.when(F.col("key").isin("whatsapp_signals", "affiliation", "policy.no_cold_outreach"), F.col("value")).otherwise(F.substring(quoted, F.lit(2), F.length(quoted) - 2))
    rest = F.to_json(F.struct("key", "confidence", "source_kind", "source_ref"))
    observed = F.concat(F.substring(rest, F.lit(1), F.length(rest) - 1), F.lit(',"value":'), value, F.lit("}"))
    data = F.when(is_message, F.to_json(spoken)).when(is_identity, F.to_json(F.struct(F.col("push_name").alias("name")))).otherwise(observed)
    context = F.when(is_message, F.to_json(F.struct(F.lit("whatsapp").alias("channel"), "direction"))).otherwise(F.lit("{}"))
    payload = F.concat(F.lit('{"subject":'), F.to_json(F.struct("identities")), F.lit(',"context":'), context, F.lit(',"data":'), data, F.lit("}"))
    return named.select("source_key", "external_key", "subject", "event_id", "event_type", F.col("captured_at").alias("occurred_at"), "source_ref", "key", "value", "confidence", "source_kind", "identities", payload.alias("payload"))


def as_events(extracted: DataFrame, arrival: Column) -> DataFrame:
    """Extracted events as the gateway takes them. ``arrival`` must tell them apart, in the order in which they are to be handled."""
    return extracted.select(F.col("source_key").alias("source"), "event_id", "event_type", F.lit("1.0").alias("schema_version"), "occurred_at", "payload", arrival.alias("arrival"))


def unmapped(envelopes: DataFrame) -> DataFrame:
    """An observation of the sorted field names of a content that no extractor knows, never of its values."""
    ref = F.concat_ws(":", "source_key", "external_key")
    names = F.array_sort(F.coalesce(F.json_object_keys("content"), F.array().cast("array<string>")))
    return envelopes.select(K.deterministic_id(F.lit("unmapped"), F.col("envelope_type"), ref).alias("event_id"), F.concat(F.lit("unmapped."), "envelope_type").alias("key"), names.alias("fields"), ref.alias("source_ref"), F.col("captured_at").alias("occurred_at"))
