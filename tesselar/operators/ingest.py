"""Idempotent ingestion: what becomes of each arriving event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselar.functions import keys as K
from tesselar.operators.settle import settled

FAMILIES = ["identity", "interaction", "observation", "company", "score", "experience"]


#: Stored events that an equal arrival has handled again.
OPEN = ["pending", "failed"]


def decide(arriving: DataFrame, stored: DataFrame | None = None, major: int = 1) -> DataFrame:
    """``arriving`` (source, event_id, event_type, schema_version, payload, arrival) with payload_hash and decision.

    SCHEMA_UNSUPPORTED for another major version (nothing of it is stored). The original of a key is the stored event (source, event_id, event_type,
    payload_hash, and perhaps status), else the first arrival. An arrival that differs from it is an EVENT_ID_CONFLICT and leaves it as it is. An equal one is a
    duplicate of a processed event, an IDENTITY_CONFLICT of one in conflict, and else has it handled: as accepted if it is new, as retry if it is
    stored as pending or failed, and as VALIDATION_ERROR, each time, if no handler knows its family. Of equal arrivals the first is handled and the
    others are duplicates, which stands if the first is processed; see ``gateway.answers`` for when it is not.

    First arrivals are minima by key that are combined before their exchange, so a key that very many arrivals share is no window; whole arrivals are exchanged once.
    """
    # payloads are parsed once
    rows = settled(arriving.withColumn("payload_hash", K.payload_hash(F.col("payload"))).withColumn("_ok", K.supported_major(F.col("schema_version"), major)))
    sound = rows.where("_ok").select("source", "event_id", "arrival", "event_type", "payload_hash")
    first = sound.groupBy("source", "event_id").agg(F.min(F.struct("arrival", "event_type", "payload_hash")).alias("_f"))
    first = first.select("source", "event_id", F.struct("_f.event_type", "_f.payload_hash").alias("_original"), F.col("_f.arrival").alias("_head"), F.lit(None).cast("string").alias("_status"))
    if stored is not None:
        state = F.col("status") if "status" in stored.columns else F.lit("processed")
        old = stored.groupBy("source", "event_id").agg(F.min(F.struct("event_type", "payload_hash", state.alias("status"))).alias("_old"))
        old = old.select("source", "event_id", F.struct("_old.event_type", "_old.payload_hash").alias("_stored"), F.col("_old.status").alias("_was"))
        # the first arrival that equals the stored event
        again = sound.join(old, ["source", "event_id"]).where(F.col("_stored") == F.struct("event_type", "payload_hash")).groupBy("source", "event_id").agg(F.min("arrival").alias("_again"))
        first = first.join(old.join(again, ["source", "event_id"], "left"), ["source", "event_id"], "left").select(
            "source", "event_id", F.coalesce("_stored", "_original").alias("_original"), F.when(F.col("_stored").isNull(), F.col("_head")).otherwise(F.col("_again")).alias("_head"), F.col("_was").alias("_status")
        )
    both = rows.alias("r").join(first, ["source", "event_id"], "left")
    known = K.family(F.col("r.event_type")).isin(FAMILIES)
    decision = (
        F.when(~F.col("_ok"), "SCHEMA_UNSUPPORTED").when(F.col("_original") != F.struct("r.event_type", "r.payload_hash"), "EVENT_ID_CONFLICT").when(F.col("_status") == "processed", "duplicate")
        .when(F.col("_status") == "conflict", "IDENTITY_CONFLICT").when(~known, "VALIDATION_ERROR").when(F.col("arrival") > F.col("_head"), "duplicate").when(F.col("_status").isNull(), "accepted").otherwise("retry")
    )
    return both.select("r.*", decision.alias("decision")).drop("_ok")


def replay(log: DataFrame, handled: DataFrame) -> DataFrame:
    """The log (source, event_id, status, retry_count, ...) after failed and conflicting events were run again. handled: source, event_id,
    status, what became of each; all but processed ones have one more retry, so one that conflicts again stays in conflict. Events that were not open stay as they are."""
    done = handled.groupBy("source", "event_id").agg(F.max_by("status", F.col("status") == "processed").alias("_now"))
    rows = log.join(done, ["source", "event_id"], "left")
    again = F.col("status").isin(*OPEN, "conflict") & F.col("_now").isNotNull()
    return rows.withColumns({"status": F.when(again, F.col("_now")).otherwise(F.col("status")), "retry_count": F.col("retry_count") + F.when(again & (F.col("_now") != "processed"), 1).otherwise(0)}).drop("_now")


def closed_cases(cases: DataFrame, handled: DataFrame) -> DataFrame:
    """Cases (source, event_id, status, resolution): the open ones of events that were ``handled`` again (source, event_id, status) and are processed now
    are resolved by it. Cases of other events stay open, whatever the state of their event."""
    done = handled.where("status = 'processed'").select("source", "event_id").distinct().withColumn("_done", F.lit(True))
    closes = F.col("_done").isNotNull() & ~F.col("status").isin("resolved", "dismissed")
    rows = cases.join(done, ["source", "event_id"], "left")
    return rows.withColumns({"resolution": F.when(closes, "reprocessed").otherwise(F.col("resolution")), "status": F.when(closes, "resolved").otherwise(F.col("status"))}).drop("_done")


def envelope(event_type: Column, event_id: Column, at: Column, identities: Column, data: Column, context: Column | None = None) -> Column:
    """The JSON of an event that a write tool sends (S10). identities: array of structs; data and context: structs."""
    parts = [F.lit("1.0").alias("schema_version"), event_id.alias("event_id"), event_type.alias("event_type"), at.alias("occurred_at"), F.struct(identities.alias("identities")).alias("subject"), data.alias("data")]
    return F.to_json(F.struct(*parts, *([context.alias("context")] if context is not None else [])))


def recorded_observation(event_id: Column, at: Column, identities: Column, key: Column, value: Column, confidence: Column) -> Column:
    data = F.struct(key.alias("key"), value.alias("value"), confidence.alias("confidence"), F.lit("declared").alias("source_kind"))
    return envelope(F.lit("observation.recorded"), event_id, at, identities, data)


def recorded_interaction(event_id: Column, at: Column, identities: Column, kind: Column, channel: Column, direction: Column) -> Column:
    context = F.struct(channel.alias("channel"), direction.alias("direction"))
    return envelope(F.concat(F.lit("interaction."), kind), event_id, at, identities, F.from_json(F.lit("{}"), "struct<none: string>"), context)


def stored_events(decided: DataFrame) -> DataFrame:
    """Rows to append before anything is handled: the original of each new key as pending, or as failed where no handler knows it."""
    new = decided.where(F.col("decision").isin("accepted", "VALIDATION_ERROR")).groupBy("source", "event_id").agg(F.min("arrival").alias("arrival"))
    status = F.when(F.col("decision") == "accepted", "pending").otherwise("failed")
    return decided.join(new, ["source", "event_id", "arrival"], "left_semi").withColumn("status", status).drop("decision")


def cases(decided: DataFrame, open_cases: DataFrame | None = None) -> DataFrame:
    """One open case for each key with a conflict."""
    found = decided.where("decision = 'EVENT_ID_CONFLICT'").groupBy("source", "event_id").agg(F.count(F.lit(1)).alias("seen")).withColumn("case_type", F.lit("event_id_conflict"))
    return found if open_cases is None else found.join(open_cases, ["source", "event_id", "case_type"], "left_anti")


def edges(rows: DataFrame, key: list[str], at: str) -> DataFrame:
    """One edge for each key, nulls equal, with first and last sighting."""
    return rows.groupBy(*key).agg(F.min(at).alias("first_seen_at"), F.max(at).alias("last_seen_at"))
