"""Normal forms of identities, names and payloads as Column -> Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesselar.functions.vocabulary import LEGAL_SUFFIX, WEBMAIL

PHONE_SUFFIX, GROUP_SUFFIX, LID_SUFFIX, STATUS = "@s.whatsapp.net", "@g.us", "@lid", "status@broadcast"


def blank(c: Column) -> Column:
    """Null for null and for the empty string."""
    return F.nullif(c, F.lit(""))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\D", "")


def _user(jid: Column) -> Column:
    return F.split_part(F.split_part(jid, F.lit("@"), F.lit(1)), F.lit(":"), F.lit(1))


def phone_of_jid(jid: Column) -> Column:
    user = _user(jid)
    return F.when(jid.contains(PHONE_SUFFIX) & user.rlike(r"(?U)^\d+$"), user)


def chat_type(jid: Column) -> Column:
    return F.when(jid.endswith(PHONE_SUFFIX), "individual").when(jid.endswith(GROUP_SUFFIX), "grupo").when(jid.endswith(LID_SUFFIX), "lid").when(jid == STATUS, "broadcast").otherwise("desconhecido")


def useful_push_name(name: Column) -> Column:
    n = F.trim(F.coalesce(name, F.lit("")))
    bare = F.regexp_replace(n, r"[-+ ]", "")
    bad = (n == "") | F.lower(n).isin("você", "voce", "vc") | n.rlike(r"(?U)^\d+$") | (bare.rlike(r"(?U)^\d+$") & (F.length(bare) > 6)) | n.contains("@") | (F.length(n) < 2)
    return ~bad


def contact_id(jid: Column, participant: Column, raw_key: Column, message_id: Column) -> Column:
    """One id for a person on all channels: a phone where one is known."""
    unknown = F.concat(F.lit("unknown:"), F.coalesce(message_id, F.lit("")))
    key = lambda name: phone_of_jid(F.get_json_object(raw_key, f"$.{name}"))
    lid = F.when(F.split_part(participant, F.lit("@"), F.lit(2)) == "lid", F.concat(F.lit("lid:"), _user(participant)))
    local = F.split_part(jid, F.lit("@"), F.lit(1))
    group = F.coalesce(phone_of_jid(participant), lid, key("participantPn"), key("participant"), F.concat(F.lit("group:"), local))
    return (
        F.when(blank(jid).isNull(), unknown)
        .when(jid.endswith(GROUP_SUFFIX), group)
        .when(jid.endswith(PHONE_SUFFIX), F.coalesce(phone_of_jid(jid), blank(_user(jid)), unknown))
        .when(jid.endswith(LID_SUFFIX), F.coalesce(key("senderPn"), key("previousRemoteJid"), F.concat(F.lit("lid:"), local)))
        .when(jid == STATUS, F.lit("broadcast:status"))
        .otherwise(unknown)
    )


def message_text(message: Column) -> Column:
    """Text by the first message kind that is present, even if its value is null."""
    present = F.coalesce(F.json_object_keys(message), F.array().cast("array<string>"))
    get = lambda path: F.get_json_object(message, f"$.{path}")
    kinds = [("conversation", blank(get("conversation"))), ("extendedTextMessage", get("extendedTextMessage.text")), ("imageMessage", get("imageMessage.caption")), ("videoMessage", get("videoMessage.caption"))]
    kinds.append(("documentMessage", F.coalesce(*[blank(get(f"documentMessage.{x}")) for x in ("caption", "title", "fileName")])))
    kinds += [(k, get(f"{k}.displayName")) for k in ("contactMessage", "contactsArrayMessage")]
    out = F.lit(None).cast("string")
    for name, value in reversed(kinds):
        out = F.when(F.array_contains(present, name), value).otherwise(out)
    return out


def email(c: Column) -> Column:
    v = F.lower(F.trim(c))
    return F.when(v.rlike(r"(?U)^[^@\s]+@[^@\s]+\.[^@\s]+$"), v)


def phone_e164(c: Column) -> Column:
    s = F.trim(c)
    d = digits(s)
    n = F.length(d)
    return F.when(s.startswith("+") & n.between(8, 15), F.concat(F.lit("+"), d)).when(n.isin(10, 11), F.concat(F.lit("+55"), d)).when(n.isin(12, 13) & d.startswith("55"), F.concat(F.lit("+"), d))


def domain(c: Column) -> Column:
    v = F.regexp_replace(F.lower(F.trim(c)), r"^https?://", "")
    v = F.split_part(F.split_part(v, F.lit("/"), F.lit(1)), F.lit("?"), F.lit(1))
    return blank(F.regexp_replace(v, r"^www\.", ""))


def cnpj(c: Column) -> Column:
    d = digits(c)
    return F.when(F.length(d) == 14, d)


def cnpj_root(c: Column) -> Column:
    return F.substring(cnpj(c), 1, 8)


def company_name(c: Column) -> Column:
    v = F.trim(F.regexp_replace(F.lower(F.trim(c)), "(?iuU)" + LEGAL_SUFFIX, ""))
    v = F.regexp_replace(v, r"(?U)[^\w\s&.-]", "")
    return blank(F.trim(F.regexp_replace(v, r"(?U)\s+", " ")))


def handle(c: Column) -> Column:
    v = F.split_part(F.regexp_replace(F.lower(F.trim(c)), r"^https?://", ""), F.lit("?"), F.lit(1))
    return blank(F.regexp_replace(F.regexp_replace(v, r"/+$", ""), r"^@+", ""))


def value_hash(kind: Column, value: Column) -> Column:
    return F.sha2(F.concat(kind, F.lit(":"), value), 256)


def identity(kind: Column, value: Column) -> Column:
    """struct(type, value, hash, strong); null where the value is invalid. Only e-mail and phone are strong, the others hold within a source."""
    t = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    phone = phone_e164(value)
    as_phone = (t == "phone") | ((t == "whatsapp") & phone.isNotNull())
    final = F.when(as_phone, "phone").when(t == "", "unknown").otherwise(t)
    v = F.when(t == "email", email(value)).when(as_phone, phone).when(t == "whatsapp", blank(F.lower(F.trim(value)))).when(t.isin("instagram", "linkedin"), handle(value)).otherwise(blank(F.trim(value)))
    return F.when(v.isNotNull(), F.struct(final.alias("type"), v.alias("value"), value_hash(final, v).alias("hash"), final.isin("email", "phone").alias("strong")))


def is_group(jid: Column) -> Column:
    return F.lower(F.coalesce(jid, F.lit(""))).endswith(GROUP_SUFFIX)


def is_lid(jid: Column) -> Column:
    return F.contains(F.lower(F.coalesce(jid, F.lit(""))), F.lit(LID_SUFFIX))


def parsed_json(value: Column) -> Column:
    """The JSON form of a string: of the value that it spells, else of the string itself (H-5)."""
    quoted = F.to_json(F.array(value))
    return F.coalesce(F.to_json(F.try_parse_json(value)), F.when(value.isNotNull(), F.substring(quoted, F.lit(2), F.length(quoted) - 2)))


def first_text(message: Column) -> Column:
    """Text by the first of five kinds that is a non-empty string (H-7)."""
    paths = ["conversation", "extendedTextMessage.text", "imageMessage.caption", "videoMessage.caption", "documentMessage.caption"]
    parsed = F.try_parse_json(message)
    texts = [F.when(F.schema_of_variant(F.try_variant_get(parsed, f"$.{p}", "variant")) == "STRING", F.try_variant_get(parsed, f"$.{p}", "string")) for p in paths]
    return F.coalesce(*[blank(t) for t in texts])


def generic_webmail(c: Column) -> Column:
    return F.lower(F.trim(F.substring_index(F.coalesce(c, F.lit("")), "@", -1))).isin(WEBMAIL)


def deterministic_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 40)


def payload_hash(json: Column) -> Column:
    """Of the canonical form: keys sorted at every level."""
    return F.sha2(F.to_json(F.parse_json(json)), 256)


def event_time(at: Column, epoch: Column) -> Column:
    return F.coalesce(at, F.when(epoch > 0, F.timestamp_seconds(epoch)))


def falsy_or(a: Column, b: Column) -> Column:
    """a, but b where a is null or zero."""
    return F.coalesce(F.nullif(a, F.lit(0)), b)


def family(event_type: Column) -> Column:
    return F.substring_index(event_type, ".", 1)


def supported_major(version: Column, major: int = 1) -> Column:
    return F.coalesce(F.split_part(version, F.lit("."), F.lit(1)).try_cast("int") == major, F.lit(False))
