"""Parquet sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pending(rows: DataFrame, done: Column, guards: list[Column], order: list[Column], limit: int) -> DataFrame:
    """Unprocessed rows that pass all guards, oldest first."""
    rows = rows.where(done.isNull())
    for g in guards:
        rows = rows.where(g)
    return rows.orderBy(*order).limit(limit)


def since(rows: DataFrame, at: str, cursor: str, overlap_hours: float, order: list[str], limit: int | None = None) -> DataFrame:
    """Rows loaded after the cursor less an overlap, so that late ones are read again."""
    found = rows.where(F.col(at) > F.lit(cursor).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(int(overlap_hours)), F.lit(int(overlap_hours % 1 * 60))))
    return found.orderBy(*order).limit(limit) if limit else found


def envelopes(rows: DataFrame, source: Column, ids: list[Column], times: list[Column], kind: str, content: Column) -> DataFrame:
    """The shape that extractors read: empty ids fall through like nulls (S3)."""
    return rows.select(
        F.lower(F.coalesce(F.nullif(source, F.lit("")), F.lit("unknown"))).alias("source_key"),
        F.lit(kind).alias("envelope_type"),
        F.coalesce(*[F.nullif(i.cast("string"), F.lit("")) for i in ids]).alias("external_key"),
        content.alias("content"),
        F.coalesce(*times).alias("captured_at"),
    )


def passthrough(body: Column, id_path: str, time_path: str, source: Column, now: Column) -> tuple[Column, Column]:
    """Event id and time dug out of a JSON body; without an id a hash of source and body."""
    found = F.nullif(F.get_json_object(body, id_path), F.lit(""))
    return F.coalesce(found, F.sha2(F.concat_ws(":", source, body), 256)), F.coalesce(F.get_json_object(body, time_path).try_cast("timestamp_ntz"), now)


#: Readers by name: what a source's name stands for.
Reader = Callable[[SparkSession, dict], DataFrame]


class Sources:
    """Readers and adapters by name (S5, S8). A source of an unknown type is passed through."""

    def __init__(self):
        self.readers: dict[str, Reader] = {"parquet": lambda spark, o: table(spark, o["folder"], o["name"])}
        self.adapters: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def reader(self, name: str) -> Callable[[Reader], Reader]:
        def put(f: Reader) -> Reader:
            self.readers[name] = f
            return f

        return put

    def read(self, spark: SparkSession, config: list[dict]) -> DataFrame:
        """Envelopes of all configured sources (type, adapter and the reader's own options); one switched off is left out."""
        parts = []
        for c in config:
            if c.get("enabled", True):
                rows = self.readers[c["type"]](spark, c)
                parts.append(self.adapters.get(c.get("adapter", ""), lambda df: df)(rows))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out


def advanced(cursors: DataFrame, rows: DataFrame, source: str, at: str) -> DataFrame:
    """Cursors (source, cursor) after the rows were read: the latest time of each source, never back (2.11d)."""
    seen = rows.groupBy(F.col(source).alias("_source")).agg(F.max(at).alias("_at"))
    both = cursors.join(seen, F.col("source") == F.col("_source"), "full")
    return both.select(F.coalesce("source", "_source").alias("source"), F.greatest("cursor", "_at").alias("cursor"))


def since_cursors(rows: DataFrame, cursors: DataFrame, source: str, at: str, overlap_hours: int) -> DataFrame:
    """Rows later than their source's cursor less the overlap; all of a source without one. Rows of the overlap come again, which merges by key allow."""
    known = cursors.select(F.col("source").alias("_source"), "cursor")
    late = F.col("cursor").isNull() | (F.col(at) > F.col("cursor") - F.make_dt_interval(F.lit(0), F.lit(overlap_hours)))
    return rows.join(known, F.col(source) == F.col("_source"), "left").where(late).drop("_source", "cursor")
