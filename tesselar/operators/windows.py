"""Latest, first and capped rows of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_of(rows: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group. Spark limits a group before the shuffle where the rank is filtered."""
    return rows.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def latest_per_key(rows: DataFrame, subject: str, key: str, at: str, tie: str, cap: int) -> DataFrame:
    """Latest row of each key of a subject, the newest ``cap`` keys of it, with their rank."""
    newest = first_of(rows, [subject, key], [F.col(at).desc(), F.col(tie).desc()])
    return newest.withColumn("rank", F.row_number().over(W.partitionBy(subject).orderBy(F.col(at).desc(), F.col(tie).desc()))).where(F.col("rank") <= cap)


def first_and_last(rows: DataFrame, key: str, order: list[str], first: int, last: int) -> DataFrame:
    """The oldest rows ascending, then the newest descending without those, with their position (W4). The order must tell rows apart.

    Each side is limited by rank alone, so that Spark limits a hot group in each task before the exchange.
    """
    up = W.partitionBy(key).orderBy(*[F.col(c).asc() for c in order])
    down = W.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    oldest = rows.withColumn("_up", F.row_number().over(up)).where(F.col("_up") <= first).withColumn("_down", F.lit(None).cast("int"))
    newest = rows.withColumn("_down", F.row_number().over(down)).where(F.col("_down") <= last).withColumn("_up", F.lit(None).cast("int"))
    # a row of both sides counts as an old one
    once = W.partitionBy(key, *order).orderBy(F.col("_up").asc_nulls_last())
    kept = oldest.unionByName(newest).withColumn("_n", F.row_number().over(once)).where("_n = 1")
    return kept.withColumn("position", F.row_number().over(W.partitionBy(key).orderBy(F.col("_up").asc_nulls_last(), F.col("_down")))).drop("_up", "_down", "_n")


def capped(rows: DataFrame, key: str, order: list[Column], existing: DataFrame | None, cap: int) -> DataFrame:
    """New rows of a group in order, as many as its stored rows leave of the cap."""
    have = existing.groupBy(key).agg(F.count(F.lit(1)).alias("_have")) if existing is not None else None
    # no more than the cap is of use, so that Spark limits a hot group in each task before the exchange
    ranked = rows.withColumn("_rank", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("_rank") <= cap)
    if have is None:
        return ranked.drop("_rank")
    return ranked.join(have, key, "left").where(F.col("_rank") + F.coalesce("_have", F.lit(0)) <= cap).drop("_rank", "_have")


def sliding_count(rows: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """Rows with the number of their key's rows in the so many seconds up to each (2.11k)."""
    span = W.partitionBy(key).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return rows.withColumn("recent", F.count(F.lit(1)).over(span))


def ranked(rows: DataFrame, keys: list[str], order: list[Column], cap: int) -> DataFrame:
    """The first ``cap`` rows of each group with their rank."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= cap)
