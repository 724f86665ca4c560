"""Facts out of accepted events: interactions, observations, scores and experience runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselar.functions import keys as K

RUN = ["source", "experience_key", "experience_version", "run_id"]


def _get(path: str) -> Column:
    return F.get_json_object("data", f"$.{path}")


def _action() -> Column:
    """What follows the first dot, else the whole type."""
    t = F.col("event_type")
    return F.when(t.contains("."), F.regexp_extract(t, r"^[^.]*\.(.*)$", 1)).otherwise(t)


def interactions(events: DataFrame) -> DataFrame:
    """events: event_id, event_type, occurred_at, data (JSON), channel, direction and run_id of the context, which wins over data's."""
    rows = events.where(K.family(F.col("event_type")) == "interaction")
    external = F.coalesce(K.blank(_get("external_interaction_id")), F.col("run_id"))
    return rows.select("event_id", _action().alias("interaction_type"), *[F.coalesce(K.blank(F.col(c)), _get(c)).alias(c) for c in ("channel", "direction")], external.alias("external_interaction_id"), "occurred_at")


def observations(events: DataFrame) -> DataFrame:
    """A row for each observation with a key. A null value is stored as {}, but hashed as null."""
    rows = events.where((K.family(F.col("event_type")) == "observation") & K.blank(_get("key")).isNotNull())
    stored = F.to_json(F.expr("variant_get(parse_json(data), '$.value')"))
    value = F.nullif(stored, F.lit("null"))
    return rows.select(
        "event_id", _get("key").alias("key"), F.coalesce(value, F.lit("{}")).alias("value"), F.sha2(F.concat(_get("key"), F.lit(":"), F.coalesce(value, F.lit("null"))), 256).alias("value_hash"),
        _get("confidence").cast("double").alias("confidence"), F.coalesce(K.blank(_get("source_kind")), F.lit("declared")).alias("source_kind"), F.col("occurred_at").alias("observed_at"),
    )


def scores(events: DataFrame) -> DataFrame:
    """A row for each score with key and value."""
    rows = events.where((K.family(F.col("event_type")) == "score") & _get("score_key").isNotNull() & _get("score_value").isNotNull())
    return rows.select("event_id", _get("score_key").alias("score_key"), _get("score_value").cast("double").alias("score_value"), _get("score_band").alias("score_band"), F.col("occurred_at").alias("calculated_at"))


def valid_experience(events: DataFrame, experiences: DataFrame) -> DataFrame:
    """Experience events with action and error: null, VALIDATION_ERROR without key, version, run or an answer's question, or
    EXPERIENCE_NOT_FOUND where ``experiences`` (experience_key, experience_version) doesn't list it."""
    known = experiences.select("experience_key", "experience_version").distinct().withColumn("_known", F.lit(True))
    rows = events.where(K.family(F.col("event_type")) == "experience").withColumn("action", _action()).join(known, ["experience_key", "experience_version"], "left")
    absent = lambda c: K.blank(F.col(c)).isNull()
    asked = (F.col("action") == "answer_recorded") & K.blank(_get("question_key")).isNull()
    error = F.when(absent("experience_key") | absent("experience_version"), "VALIDATION_ERROR").when(F.col("_known").isNull(), "EXPERIENCE_NOT_FOUND").when(absent("run_id") | asked, "VALIDATION_ERROR")
    return rows.withColumn("error", error).drop("_known")


def runs(valid: DataFrame) -> DataFrame:
    """One row for each run. Order is that of ``arrival``: the first event starts a run, the last one is its last activity, the
    first captured person stays. One partial aggregation and one shuffle by run, whatever its number of events."""
    rows, at = valid.where("error IS NULL"), F.col("arrival")
    completed, captured = F.col("action") == "run_completed", (F.col("action") == "identity_captured") & F.col("person_id").isNotNull()
    return rows.groupBy(*RUN).agg(
        F.when(F.max(completed), "completed").otherwise("started").alias("status"), F.min_by("occurred_at", at).alias("started_at"), F.max_by("occurred_at", at).alias("last_activity_at"),
        F.max_by("occurred_at", F.when(completed, at)).alias("completed_at"), F.min_by("person_id", F.when(captured, at)).alias("person_id"), F.count_if(F.col("action") == "answer_recorded").alias("answers"),
        F.max_by(_get("score").cast("double"), F.when(completed & _get("score").isNotNull(), at)).alias("score"),
    )


def answers(valid: DataFrame) -> DataFrame:
    """All answers of valid runs, repeated ones too; a null value is stored as {}."""
    return valid.where("error IS NULL AND action = 'answer_recorded'").select(*RUN, _get("question_key").alias("question_key"), F.coalesce(_get("value"), F.lit("{}")).alias("value"), F.col("occurred_at").alias("answered_at"))
