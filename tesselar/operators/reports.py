"""Status reports, totals and lookups that several readers share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(rows: DataFrame, key: str, value) -> DataFrame:
    """The rows of one key (S11); the filter reaches the scan."""
    return rows.where(F.col(key) == F.lit(value))


def enrichment_status(contacts: DataFrame, enriched: Column, opportunities: DataFrame, open_: Column, at: str) -> DataFrame:
    """One row: contacts, those enriched and pending, open opportunities, and the newest time."""
    c = contacts.agg(F.count(F.lit(1)).alias("contacts"), F.count_if(enriched).alias("enriched")).withColumn("pending", F.col("contacts") - F.col("enriched"))
    o = opportunities.agg(F.count_if(open_).alias("opportunities"), F.max(at).alias("last_run"))
    # both sides are one row
    return c.crossJoin(F.broadcast(o))


def by_type(rows: DataFrame, kind: Column) -> DataFrame:
    """Rows of each kind, the most frequent first, those without one left out."""
    return rows.select(kind.alias("kind")).where("kind IS NOT NULL").groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kind")


def summary(rows: DataFrame, by: Column, status: Column, states: dict[str, str], at: str) -> DataFrame:
    """Of each kind the total, a count for each named state, and the latest time (A9): one pass."""
    return rows.groupBy(by.alias("kind")).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(status == v).alias(n) for n, v in states.items()], F.max(at).alias("last_at"))


def with_total(rows: DataFrame, page: DataFrame) -> DataFrame:
    """A page with the number of all rows that it is of (A12): an aggregate of its own, combined in tasks, not a window over all rows."""
    return page.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("total"))))


def premerged(rows: DataFrame, key: str, name: str, order: str, at: str) -> DataFrame:
    """One row for each key of a batch: the first name told, the first and last time."""
    return rows.groupBy(key).agg(F.min_by(name, F.when(F.col(name).isNotNull(), F.col(order))).alias("name"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def distinct_types(rows: DataFrame, key: str, kind: Column) -> DataFrame:
    """The sorted kinds of each key, each once (A15). Kinds are a short list, so a key's array is bounded by it."""
    return rows.select(key, kind.alias("kind")).distinct().groupBy(key).agg(F.array_sort(F.collect_list("kind")).alias("kinds"))


def counts(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of each combination of keys."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def dashboard(sources: DataFrame, busy: Column) -> DataFrame:
    """One row: sources that feed, sources with errors, and the percentage of what was taken in without (A19). sources: n, bad."""
    percent = F.when(F.coalesce(F.sum("n"), F.lit(0)) == 0, 0.0).otherwise(F.round(100.0 * F.sum(F.col("n") - F.col("bad")) / F.sum("n"), 1))
    return sources.agg(F.count_if(busy).alias("feeding"), F.count_if(F.col("bad") > 0).alias("with_errors"), percent.alias("percent"))


def held_by(rows: DataFrame, holders: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows that one of ``holders`` names, each once however often it does."""
    return rows.join(holders, [F.col(a) == F.col(b) for a, b in on.items()], "left_semi")


def joined(rows: DataFrame, others: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows with those of ``others`` that belong to them (J8, J9, J10); which side is sent where is left to Spark."""
    return rows.join(others, [F.col(a) == F.col(b) for a, b in on.items()])


def named(rows: DataFrame, dictionary: DataFrame, on: dict[str, str]) -> DataFrame:
    """All rows with their dictionary entry, if there is one (J13). A dictionary has one entry for each key."""
    return rows.join(dictionary, [F.col(a) == F.col(b) for a, b in on.items()], "left")


def union_once(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either, each once."""
    return a.unionByName(b).distinct()
