"""Raw chat rows to contacts, conversations and messages in one projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesselar.functions import keys as K


def messages(raw: DataFrame) -> DataFrame:
    """One row for each message id, the first loaded. Raw columns: external_message_id, whatsapp_message_id, source_account_id,
    instance_name, remote_jid, participant, from_me, push_name, message_type, message_timestamp, message_datetime, raw_key, raw_message, loaded_at.
    A group's messages belong to their senders, its conversation to the group."""
    jid, account = F.coalesce("remote_jid", F.lit("")), F.coalesce(K.blank(F.col("source_account_id")), K.blank(F.col("instance_name")), F.lit("unknown"))
    message = F.coalesce(K.blank(F.col("external_message_id")), K.blank(F.col("whatsapp_message_id")), F.lit(""))
    sender = K.contact_id(jid, F.col("participant"), F.col("raw_key"), message)
    group = jid.endswith(K.GROUP_SUFFIX)
    out = raw.select(
        message.alias("message_id"), F.concat_ws(":", account, jid).alias("conversation_id"), sender.alias("contact_id"), account.alias("source_account_id"), jid.alias("remote_jid"),
        F.when(group, F.concat(F.lit("group:"), F.split_part(jid, F.lit("@"), F.lit(1)))).otherwise(sender).alias("conversation_contact_id"), K.chat_type(jid).alias("chat_type"),
        K.event_time(F.col("message_datetime"), F.col("message_timestamp")).alias("sent_at"), F.coalesce("from_me", F.lit(False)).alias("from_me"),
        F.when(sender.rlike(r"(?U)^\d+$"), sender).when(~group, K.phone_of_jid(jid)).alias("phone"), F.when(~group, K.phone_of_jid(jid)).alias("contact_phone"),
        F.when(K.useful_push_name(F.col("push_name")), F.col("push_name")).alias("name"),
        F.col("message_type"), K.message_text(F.col("raw_message")).alias("text"), F.col("loaded_at"),
    )
    first = F.row_number().over(W.partitionBy("message_id").orderBy("loaded_at", "conversation_id"))
    return out.withColumn("_n", first).where("_n = 1").drop("_n")


def contacts(rows: DataFrame) -> DataFrame:
    """Contacts of senders with their first name and phone, messages and span; a group that sent nothing itself has none."""
    named, phoned = (F.when(F.col(c).isNotNull(), F.struct("loaded_at", "message_id")) for c in ("name", "contact_phone"))
    people = rows.groupBy("contact_id").agg(F.min_by("name", named).alias("name"), F.min_by("contact_phone", phoned).alias("phone"), F.count(F.lit(1)).alias("messages"), F.min("sent_at").alias("first_at"), F.max("sent_at").alias("last_at"))
    groups = rows.where("chat_type = 'grupo'").groupBy(F.col("conversation_contact_id").alias("contact_id")).agg(F.min("sent_at").alias("g_first"), F.max("sent_at").alias("g_last"))
    both = people.join(groups, "contact_id", "full")
    kind = F.when(F.col("contact_id").startswith("group:") & F.col("messages").isNull(), "grupo").otherwise("desconhecido")
    return both.select("contact_id", "name", "phone", kind.alias("kind"), F.coalesce("messages", F.lit(0)).alias("messages"), F.least("first_at", "g_first").alias("first_at"), F.greatest("last_at", "g_last").alias("last_at"))


def conversations(rows: DataFrame) -> DataFrame:
    return rows.groupBy("conversation_id", F.col("conversation_contact_id").alias("contact_id"), "source_account_id", "remote_jid", "chat_type").agg(F.count(F.lit(1)).alias("messages"), F.min("sent_at").alias("first_at"), F.max("sent_at").alias("last_at"))
