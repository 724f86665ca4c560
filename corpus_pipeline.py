"""A training-data pipeline over ``documents``: each stage works on all rows that the one before it kept.

Toxic documents go; of documents alike in their word shingles one stays; passages that an earlier
document holds are cut out; sources are replicated or thinned towards their target weights; what is
left is packed into sequences.

Defined results of all stages: null and empty texts are clean, near copies of nothing, lose no words, and are packed as the
separator alone; rows that repeat a doc_id and its text count as copies, of which one stays; rows without a doc_id are never copies of
others, lose words that any other document holds, and are drawn as one document; ties between sources, lengths or scores are broken by ids
and hashes, so a run gives the same rows again; columns other than those of ``documents`` are dropped; an empty table gives no
rows. The copies that the mixing makes of a document are equal rows, each packed by itself.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselar.llm.common import shared_checkpoint, shared_folder, table
from tesselar.llm.jaccard_join import one_of_each_group
from tesselar.llm.packing import pack_documents
from tesselar.llm.poisson_mix import poisson_mix
from tesselar.llm.substring_dedup import substring_dedup
from tesselar.llm.toxicity import fit_toxicity, score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC = 0.5


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is below TOXIC. Labels are learnt from the training remainders only."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs.select(COLUMNS), model).where(F.col("score") < TOXIC).select(COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id."""
    return one_of_each_group(docs.select(COLUMNS))


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that a window of an earlier document covers; n_chars follows."""
    return substring_dedup(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as drawn at its source's rate, in shuffled order."""
    return poisson_mix(docs.select(COLUMNS)).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its sequence and offset."""
    return pack_documents(docs.select(COLUMNS))


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", without_near_copies),
    ("substring_dedup", without_repeated_passages),
    ("source_mix", mixed_sources),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage keeps is written to the shared folder and read again. The result is checkpointed, and the folder goes, also
    when a stage fails."""
    docs = table(spark, sf_dir, "documents")
    place = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    try:
        for name, stage in STAGES[:-1]:
            stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
            docs = spark.read.parquet(f"{place}/{name}")
        return shared_checkpoint(STAGES[-1][1](spark, docs, sf_dir))
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(place)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: A trained score decides the first stage and a search the last, which SQL can't express.
ORACLE_SQL = None
