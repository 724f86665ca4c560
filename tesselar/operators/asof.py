"""Joins on time: the row in force at a moment, and rows within a time of each other (the absent joins of section 2.4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, since: str, tie: str, prefix: str = "", slice_seconds: int = 86_400) -> DataFrame:
    """``left`` with the columns of the row of ``right`` with equal ``by`` (nulls match nothing) and the latest ``since`` not after ``at``; null where there is none. Of
    rows of one ``since`` the one with the largest ``tie`` counts. Columns of ``right`` but ``by`` get the prefix.

    Both sides are put into one order, and a row takes the last one of ``right`` before it. A key's rows are dealt by slices of time, so that one
    key with a third of all rows is many tasks; what a slice has from earlier ones is the last row of each, a row a slice, which is passed on first.
    """
    told = [c for c in right.columns if c not in by]
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    known = F.struct(*[F.col(c).alias(f"_{c}") for c in told])
    none = F.lit(None).cast(right.select(known.alias("x")).schema["x"].dataType)
    own = F.struct(*left.columns)
    nothing = F.lit(None).cast(left.select(own.alias("x")).schema["x"].dataType)
    l_rows = left.select(*[F.col(c).alias(f"_by_{c}") for c in by], micros(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"), own.alias("_left"), none.alias("_right"))
    # a row without a time is in force at no moment, and at a moment without a time nothing is
    r_rows = right.where(F.col(since).isNotNull()).select(*[F.col(c).alias(f"_by_{c}") for c in by], micros(since).alias("_at"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), nothing.alias("_left"), known.alias("_right"))
    keys = [f"_by_{c}" for c in by]
    rows = l_rows.unionByName(r_rows).withColumn("_slice", F.floor(F.col("_at") / (slice_seconds * 1_000_000)))
    order = [F.col("_at"), F.col("_side"), F.col("_tie").asc_nulls_first()]
    last = F.max_by("_right", F.when(F.col("_side") == 0, F.struct("_at", "_tie")))
    ends = rows.where("_side = 0").groupBy(*keys, "_slice").agg(last.alias("_last"))
    slices = rows.groupBy(*keys, "_slice").agg(F.lit(1).alias("_one")).join(ends, [*keys, "_slice"], "left")
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carried = slices.select(*keys, "_slice", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    inside = W.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = rows.withColumn("_found", F.last("_right", ignorenulls=True).over(inside)).where("_side = 1")
    # rows without a key or a time find nothing, and so keep their place without the join
    f, c = found.alias("f"), carried.alias("c")
    same = [F.col(f"f.{k}") == F.col(f"c.{k}") for k in [*keys, "_slice"]]
    both = f.join(c, same, "left").withColumn("_in_force", F.when(absent_of("f", keys) | F.col("f._at").isNull(), none).otherwise(F.coalesce("f._found", "c._carried")))
    return both.select("f._left.*", *[F.col(f"_in_force._{x}").alias(f"{prefix}{x}") for x in told])


def absent_of(side: str, keys: list[str]) -> Column:
    out = F.lit(False)
    for k in keys:
        out = out | F.col(f"{side}.{k}").isNull()
    return out


def within(left: DataFrame, right: DataFrame, by: list[str], at: str, other_at: str, before: int, after: int) -> DataFrame:
    """Pairs of rows with equal ``by`` where ``other_at`` is from ``before`` seconds before ``at`` to ``after`` seconds after it, both ends included. The sides'
    other columns must differ.

    Time is cut into buckets as wide as the whole span, so that a left row meets the one or two buckets that its span touches, and right rows stay
    single: the join is one on key and bucket, and no bucket of a key is compared with another.
    """
    width = max(1, before + after + 1) * 1_000_000
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    first, last = F.floor((micros(at) - before * 1_000_000) / width), F.floor((micros(at) + after * 1_000_000) / width)
    asked = left.where(F.col(at).isNotNull()).withColumn("_bucket", F.explode(F.sequence(first, last)))
    given = right.withColumn("_bucket", F.floor(micros(other_at) / width)).withColumnsRenamed({c: f"_{c}" for c in by})
    same = [F.col(c) == F.col(f"_{c}") for c in by]
    a, g = asked.alias("a"), given.alias("g")
    near = (micros(other_at) >= micros(at) - before * 1_000_000) & (micros(other_at) <= micros(at) + after * 1_000_000)
    return a.join(g, [F.col("a._bucket") == F.col("g._bucket"), *same, near]).drop("_bucket", *[f"_{c}" for c in by])
