"""Checkpointed rounds: what iterative operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """Checkpointed in the folder of spark.checkpoint.dir, so that rounds don't grow the lineage. Where that is unset a
    folder is made on a single machine only; the executors of a cluster would not see it."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="rounds-"))
    return df.checkpoint()


def groups_of(pairs: DataFrame, item: str, key: str, most_rounds: int = 60) -> DataFrame:
    """(item, block): items that share a key, through any chain of others, are in one block, named by its smallest item.

    Every item points to the smallest of each of its keys. Then alternately all larger neighbours of a node, and
    all smaller ones, are hung on its smallest neighbour, until each block is a star. Every step is a grouping that is
    combined before its exchange, and a join with its result.
    """
    least = pairs.groupBy(key).agg(F.min(item).alias("lo"))
    stars = settled(pairs.join(least, key).select(F.col(item).alias("hi"), "lo").where("hi > lo").distinct())

    def shape(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(20, 0)"))).first())

    now = shape(stars)
    for _ in range(most_rounds):
        both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(stars.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        smallest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(smallest, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        under = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(under, "hi").select(F.inline(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct("hi", F.col("m").alias("lo"))))).where("hi > lo").distinct()
        stars = settled(small)
        before, now = now, shape(stars)
        if before == now:
            return pairs.select(item).distinct().join(stars.select(F.col("hi").alias(item), "lo"), item, "left").select(item, F.coalesce("lo", item).alias("block"))
    raise RuntimeError(f"blocks did not settle in {most_rounds} rounds")
