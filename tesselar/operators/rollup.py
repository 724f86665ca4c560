"""Grouped counts and states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselar.operators.windows import first_and_last, first_of


def span(rows: DataFrame, key: str, at: str) -> DataFrame:
    """Count, first and last time of each key (A1, A2)."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def join_back(parents: DataFrame, rows: DataFrame, key: str, at: str, zero: bool = False) -> DataFrame:
    """Parents with the span of their rows; ``zero`` turns a missing count into 0."""
    out = parents.join(span(rows, key, at), key, "left")
    return out.withColumn("total", F.coalesce("total", F.lit(0))) if zero else out


def status(rows: DataFrame, done: str, by: list[str] | None = None) -> DataFrame:
    """Total, done and pending, for all or by groups; a null group stays (A4, A5)."""
    counts = [F.count(F.lit(1)).alias("total"), F.count(done).alias("done"), (F.count(F.lit(1)) - F.count(done)).alias("pending")]
    return rows.groupBy(*by).agg(*counts) if by else rows.agg(*counts)


def top_elements(rows: DataFrame, array: Column, n: int) -> DataFrame:
    """Most frequent array elements, ties by name."""
    return rows.select(F.explode(array).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag").limit(n)


def source_health(sources: DataFrame, events: DataFrame, key: str, at: str, failed: Column, now: Column, hours: int = 24) -> DataFrame:
    """Last event, counts and failures of the last day, and whether a source feeds: one pass for all sources."""
    recent = F.col(at) >= now - F.make_dt_interval(F.lit(0), F.lit(hours))
    seen = events.groupBy(key).agg(F.max(at).alias("last_at"), F.count_if(recent).alias("recent"), F.count_if(recent & failed).alias("recent_failed"))
    out = sources.join(seen, key, "left")
    return out.select(key, "last_at", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("recent", "recent_failed")], (F.coalesce("recent", F.lit(0)) > 0).alias("feeding"))


def corpus(rows: DataFrame, key: str, order: str, text: str, first: int = 10, last: int = 50) -> DataFrame:
    """Texts of a group's first and last messages, joined by spaces (A16): the oldest ascending, then the newest descending, as ``windows.first_and_last`` gives
    them, so that a group's value is bounded whatever its number of messages. Rows without text don't count; ``order`` must tell rows apart."""
    told = first_and_last(rows.where(F.col(text) != "").select(key, order, text), key, [order], first, last)
    ordered = F.array_sort(F.collect_list(F.struct(F.col("position").alias("o"), F.col(text).alias("t"))))
    return told.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), " ").alias("corpus"))


def recall(wanted: DataFrame, found: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Share of wanted rows that are found."""
    hit = found.select(*keys).distinct().withColumn("_hit", F.lit(1))
    return wanted.join(hit, keys, "left").groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.count("_hit").alias("found"), F.avg(F.coalesce("_hit", F.lit(0))).alias("recall"))


def misses(wanted: DataFrame, found: DataFrame, keys: list[str], by: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` wanted rows of each group that are not found."""
    return first_of(wanted.join(found.select(*keys).distinct(), keys, "left_anti"), [by], order, n)


def differences(rows: DataFrame, others: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Keys that both have with different values of a column: keys, the value and the ``other`` one."""
    both = rows.join(others.select(*keys, F.col(column).alias("other")), keys)
    return both.where(~F.col(column).eqNullSafe(F.col("other"))).select(*keys, column, "other")


def by_status(rows: DataFrame, status: str, kind: str) -> DataFrame:
    """Counts by status and by kind as one table (dimension, value, n), from one pass (A10)."""
    counts = rows.groupBy(status, kind).agg(F.count(F.lit(1)).alias("n"))
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value"), F.col("n").alias("m")) for c in (status, kind)]))
    return counts.select(pairs).groupBy("dimension", "value").agg(F.sum("m").alias("n"))
