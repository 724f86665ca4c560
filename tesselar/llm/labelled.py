"""Bounded labelled samples for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(remainders: int = 5, held: int = 0) -> Column:
    """Rows that no label is learnt from. A null doc_id counts as the empty string."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % remainders == held


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, seed: int) -> tuple[DataFrame, float]:
    """(doc_id, text, label) of at most ``per_class`` rows for each of the labels 0 and 1, and the share of label 1
    among all training labels. Rows are those with the smallest seeded hashes of doc_id, so the sample is the same
    on every run. At most 2 * per_class ids are broadcast."""
    train = labels.where(~held_out() & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    counts = train.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones")).first()
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    picked = train.where("label = 1").orderBy(order, "doc_id").limit(per_class).unionByName(train.where("label = 0").orderBy(order, "doc_id").limit(per_class))
    picked = picked.select(F.col("doc_id").alias("_id"), "label")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    share = ((counts["ones"] or 0) + 0.5) / (counts["n"] + 1.0)
    return texts.join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).drop("_id"), share
