"""Connected components of a graph given as edges, kept in Spark throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselar.llm.common import parts_for, shared_checkpoint

#: Edges of a checkpointed file.
ROWS = 200_000


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b); a component is named by its smallest node.

    Every round takes the smallest label among a node's neighbours, gives it to all nodes of the same label, and
    then jumps to the label of that label, so that the rounds grow with the logarithm of a component's
    width. Sums by node and by label are combined before the exchange. Each round is checkpointed, in a file for some ROWS edges, so that a small graph
    is not spread over many files and tasks.
    """
    both = shared_checkpoint(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    files = parts_for(both.count(), ROWS)
    kept = lambda df: shared_checkpoint(df.coalesce(files))
    labels = kept(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"))
    for _ in range(most_rounds):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        seen = kept(labels.join(near, labels.node == near.a).select("node", "label", F.least("label", "near").alias("low")))
        roots = seen.groupBy("label").agg(F.min("low").alias("root_low")).where("root_low < label").withColumnRenamed("label", "root")
        hooked = seen.join(roots, seen.label == roots.root, "left").select("node", "label", F.least("low", "root_low").alias("low"))
        target = labels.select(F.col("node").alias("t"), F.col("label").alias("t_label"))
        jumped = hooked.join(target, hooked.low == target.t, "left").select("node", F.least("low", F.coalesce("t_label", "low")).alias("next"), "label")
        done = kept(jumped)
        changed = done.where("next <> label").limit(1).count()
        labels = done.select("node", F.col("next").alias("label"))
        if not changed:
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError("components did not settle")
