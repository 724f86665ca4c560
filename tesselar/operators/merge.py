"""Write modes as DataFrame merges: a stored table and incoming rows give the table to write.

Parquet has no MERGE; the caller writes the result to a new place and swaps it in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], rules: dict[str, str], order: list[Column] | None = None) -> DataFrame:
    """Full outer merge by key (K1, K2, K12, K13, K15), null keys equal. Rules of a column: fill (stored unless null or empty),
    keep (stored unless null), set (incoming unless null), max, min. Incoming rows of one key are merged first, by ``order`` where a
    rule takes the first (fill, keep) or the last (set) of them."""
    at = F.struct(*(order or [F.lit(0)]))
    told = {"fill": lambda c: F.coalesce(F.min_by(c, F.when(F.nullif(c, F.lit("")).isNotNull(), at)), F.min_by(c, F.when(c.isNotNull(), at))), "keep": lambda c: F.min_by(c, F.when(c.isNotNull(), at)), "set": lambda c: F.max_by(c, F.when(c.isNotNull(), at)), "max": F.max, "min": F.min}
    values = [c for c in stored.columns if c not in keys]
    incoming = incoming.groupBy(*keys).agg(*[told[rules.get(c, "keep")](F.col(c)).alias(c) for c in values])
    s, i = stored.alias("s"), incoming.alias("i")
    both = s.join(i, [F.col(f"s.{k}").eqNullSafe(F.col(f"i.{k}")) for k in keys], "full")

    def value(c: str) -> Column:
        a, b = F.col(f"s.{c}"), F.col(f"i.{c}")
        rule = rules.get(c, "keep")
        made = {"fill": lambda: F.coalesce(F.nullif(a, F.lit("")), b, a), "keep": lambda: F.coalesce(a, b), "set": lambda: F.coalesce(b, a), "max": lambda: F.greatest(a, b), "min": lambda: F.least(a, b)}
        return made[rule]()

    return both.select(*[F.coalesce(f"s.{k}", f"i.{k}").alias(k) for k in keys], *[value(c).alias(c) for c in values])


def insert_new(stored: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Incoming rows whose key is neither stored nor earlier in the batch (K3, K7, K8, K9, K11, K17). Null keys are equal."""
    once = incoming.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")
    old = stored.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    cond = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return once.join(old, cond, "left_anti")


def transition(rows: DataFrame, changes: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """Status changes by key, those to an unknown status left out."""
    wanted = changes.where(F.col("status").isin(allowed)).select(key, F.col("status").alias("_new"))
    return rows.join(wanted, key, "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")


def mark_processed(rows: DataFrame, done: DataFrame, key: str, at: Column, column: str = "normalized_at") -> DataFrame:
    """Rows with the time at which they were processed, those of ``done`` now (K5). It is written after the data, so a crash between makes them be processed again, which the merges by key allow."""
    mine = done.select(F.col(key).alias("_done")).distinct()
    return rows.join(mine, F.col(key) == F.col("_done"), "left").withColumn(column, F.coalesce(column, F.when(F.col("_done").isNotNull(), at))).drop("_done")


def recommend(cases: DataFrame, recommendations: DataFrame, key: str = "case_id") -> tuple[DataFrame, DataFrame]:
    """(recommendations of known cases to append, cases): an open case gets ready; nothing is merged."""
    known = recommendations.join(cases.select(key), key, "left_semi")
    told = known.select(F.col(key).alias("_told")).distinct()
    ready = F.when(F.col("_told").isNotNull() & (F.col("status") == "open"), "recommendation_ready").otherwise(F.col("status"))
    return known, cases.join(told, F.col(key) == F.col("_told"), "left").withColumn("status", ready).drop("_told")


def sync_state(events: DataFrame, source: str, at: str, ok: Column, message: Column) -> DataFrame:
    """Last seen, success and error of each source; the message is cut at 1000 characters."""
    return events.groupBy(source).agg(
        F.max(at).alias("last_seen_at"), F.max(F.when(ok, F.col(at))).alias("last_success_at"), F.max(F.when(~ok, F.col(at))).alias("last_error_at"),
        F.substring(F.max_by(message, F.when(~ok, F.col(at))), 1, 1000).alias("last_error"),
    )
