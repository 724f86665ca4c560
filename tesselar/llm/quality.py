"""Quality classifier by compression with dictionaries of good and of bad text.

Method. Two zstandard dictionaries are built from blocks of labelled good and bad texts (a bounded sample
of DICTIONARY_BLOCKS blocks of DICTIONARY_ROWS rows of each label, so of bounded bytes in the driver). A whole text is compressed block by block with each; the
difference of the two sizes over the text's size is its evidence: a text close to the good ones
is smaller under their dictionary. A logistic curve over that evidence and its square, fitted
on other labelled rows (at most CALIBRATION_ROWS of each label, measured in Spark tasks), makes it the
probability of label 1 among all training labels. Blocks keep a text's own repetitions from hiding the difference.

Only text is an input. Defined results: null and empty texts have evidence 0; repeated rows score
alike; without labels, or with one label only, the score is the smoothed share of label 1;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselar.llm.common import slices, table, text_bytes
from tesselar.llm.labelled import held_out, labelled_sample

DICTIONARY_ROWS, CALIBRATION_ROWS = 2_000, 3_000
DICTIONARY_BLOCKS, DICTIONARY_BYTES, BLOCK, LEVEL = 24_000, 110_000, 512, 3
SEED = 11
THRESHOLD = 0.3


def blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


def build_dictionary(parts: list[bytes]) -> bytes:
    """A dictionary trained on blocks; of too little text to train on, the text itself."""
    import zstandard

    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, parts)) // 8)), parts).as_bytes()
    except (zstandard.ZstdError, ValueError, MemoryError):
        return b"\n".join(parts)[-DICTIONARY_BYTES:]


@dataclass
class CompressionClassifier:
    good: bytes
    bad: bytes
    coefficients: tuple[float, float, float]

    def compressors(self) -> tuple:
        import zstandard

        def make(data: bytes):
            if not data:
                return zstandard.ZstdCompressor(level=LEVEL)
            d = zstandard.ZstdCompressionDict(data)
            d.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=d)

        return make(self.good), make(self.bad)

    def evidence(self, text: bytes, pair: tuple) -> float:
        """(size under the bad dictionary - size under the good one) / size."""
        if not text:
            return 0.0
        good, bad = pair
        return sum(len(bad.compress(b)) - len(good.compress(b)) for b in blocks(text)) / len(text)

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        a, b, c = self.coefficients
        # beyond its highest point the curve stays level
        x = np.asarray(evidence, float)
        if c:
            turn = -b / (2 * c)
            x = np.minimum(x, turn) if c < 0 and turn > 0 else np.maximum(x, turn) if c > 0 and turn < 0 else x
        return 1 / (1 + np.exp(-np.clip(a + b * x + c * x * x, -50, 50)))


def calibrate(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float, float]:
    """Logistic curve a + b x + c x^2 by Newton steps with a small ridge, rows weighted to the share of label 1."""
    if len(set(y.tolist())) < 2:
        return float(np.log(share / (1 - share))), 0.0, 0.0
    design = np.stack([np.ones(len(x)), x, x * x], axis=1)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    beta = np.zeros(3)
    ridge = np.diag([1e-6, 1e-4, 1e-4])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (weight * p * (1 - p))[:, None]) + ridge, design.T @ (weight * (y - p)) - ridge @ beta)
        beta += np.clip(step, -20, 20)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, beta))


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of each text with numbers that order them at random, but alike on every run."""
    import xxhash

    for batch in batches:
        for part in slices(batch):
            for name, label, text in zip(part.column("doc_id").to_pylist(), part.column("label").to_pylist(), text_bytes(part.column("text"))):
                cut = blocks(text)
                turn = [xxhash.xxh3_64_intdigest(f"{name}:{i}", SEED) >> 1 for i in range(len(cut))]
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(cut), pa.int32()), pa.array(turn, pa.int64()), pa.array(cut, pa.binary())], ["label", "turn", "block"])


def _measured(model, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        pair = m.compressors()
        for batch in batches:
            for part in slices(batch):
                e = np.array([m.evidence(t, pair) for t in text_bytes(part.column("text"))], float)
                rest = [(n, part.column(i)) for i, n in enumerate(part.schema.names) if n != name]
                yield pa.RecordBatch.from_arrays([c for _, c in rest] + [pa.array(m.probability(e) if name == "score" else e)], [n for n, _ in rest] + [name])

    return run


def _measure(docs: DataFrame, model: CompressionClassifier, name: str) -> DataFrame:
    docs = docs.drop(name).withColumn("text", F.col("text").cast("string"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"{name} double"])
    return docs.mapInArrow(_measured(docs.sparkSession.sparkContext.broadcast(model), name), schema)


def fit_quality(docs: DataFrame, labels: DataFrame, dictionary_rows: int = DICTIONARY_ROWS, calibration_rows: int = CALIBRATION_ROWS, dictionary_blocks: int = DICTIONARY_BLOCKS) -> CompressionClassifier:
    """Dictionaries and curve; the sample's rows are split by a hash, so no row serves for both."""
    sample, share = labelled_sample(docs, labels, "quality", dictionary_rows + calibration_rows, SEED)
    # bounded in rows; read three times
    sample = sample.persist(StorageLevel.DISK_ONLY)
    for_curve = F.pmod(F.xxhash64(F.lit(SEED + 1), F.col("doc_id")), F.lit(dictionary_rows + calibration_rows)) >= dictionary_rows
    cut = sample.where(~for_curve).mapInArrow(_block_rows, "label int, turn long, block binary")
    of = {y: [bytes(r.block) for r in cut.where(F.col("label") == y).orderBy("turn", "block").limit(dictionary_blocks).collect()] for y in (0, 1)}
    model = CompressionClassifier(build_dictionary(of[1]) if of[1] else b"", build_dictionary(of[0]) if of[0] else b"", (0.0, 0.0, 0.0))
    rows = _measure(sample.where(for_curve), model, "evidence").select("doc_id", "label", "evidence").toPandas().sort_values("doc_id", kind="stable")
    sample.unpersist()
    if not of[0] or not of[1]:
        rows = rows.iloc[:0]
    model.coefficients = calibrate(rows["evidence"].to_numpy(), rows["label"].to_numpy().astype(float), share)
    return model


def score_quality(docs: DataFrame, model: CompressionClassifier) -> DataFrame:
    """``docs`` with a column ``score``, the probability of good quality; a column of that name is replaced."""
    return _measure(docs, model, "score")


def op3_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    scored = score_quality(docs, fit_quality(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
