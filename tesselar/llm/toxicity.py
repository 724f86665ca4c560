"""Toxicity: a factorization machine over hashed terms.

Method. A text's features are the distinct hashed terms of its words: the lower-cased word without
punctuation at its ends, and the word's first four and five letters, which catch inflections. A feature's
term is kept when LEAST_DOCS texts of the sample have it, whatever their labels. Its value is FLOOR and the sure part of
its log odds ratio in the sample: chance terms of long texts weigh little, but a term that is neutral by itself
takes part in pairs. The
machine is y = w0 + sum w_i + sum over pairs <v_i, v_j>, so a pair such as an insult with a mentioned
group has its own strength beside the two terms' weights. It is trained in numpy by AdaGrad on
a bounded labelled sample (PER_CLASS rows of each label; only their features reach the driver) with the
intercept moved to the share of label 1 among all training labels. The model holds at most the terms of the sample,
and every whole text is scored by tasks.

Only text is an input. Defined results: null and empty texts have no terms and get the intercept's score;
repeated rows score alike; without labels, or with one label only, the score is the smoothed share
of label 1; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselar.llm.common import chunks, distinct, table, text_bytes
from tesselar.llm.labelled import held_out, labelled_sample

PER_CLASS = 2_500
#: Texts of the sample that have a kept term, and the value of a term that is neutral by itself.
LEAST_DOCS, FLOOR = 2, 0.3
#: Standard errors by which a term's log odds must differ from 0 to count as more.
SURE = 1.5
SPACE_BITS = 24
#: Text that is scored at once.
SCORE_BYTES = 2 << 20
FACTORS, EPOCHS, BATCH, RATE, RIDGE, SEED = 4, 6, 128, 0.1, 1e-4, 7
#: Factors start near 0, where a pair's gradient is small.
FACTOR_RATE = 0.3
EDGES = b".,;:!?*#%&$\"'()[]{}<>|-_"


class Terms(dict):
    """The hashed terms of a word as bytes, kept for words seen again."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        core = word.strip(EDGES).decode("utf-8", "ignore").lower()
        names = {core, "4" + core[:4] if len(core) > 4 else "", "5" + core[:5] if len(core) > 5 else ""} - {""}
        out = self[word] = tuple(sorted(xxhash.xxh3_64_intdigest(n.encode()) >> (64 - SPACE_BITS) for n in names))
        return out


def _term_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms = Terms()
    for batch in batches:
        out = [sorted({t for w in set(x.split()) for t in terms[w]}) for x in text_bytes(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "label", "terms"])


def term_values(ones: np.ndarray, zeros: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Feature value of a term in that many texts of either label: FLOOR and by how much its log odds ratio surely differs from 0."""
    a, b = ones + 0.5, zeros + 0.5
    ratio = np.log(a / (n1 + 1)) - np.log(b / (n0 + 1))
    return FLOOR + np.clip(np.abs(ratio) - SURE * np.sqrt(1 / a + 1 / b), 0, None)


@dataclass
class FactorizationMachine:
    terms: np.ndarray  # sorted hashed terms
    values: np.ndarray  # of their features, and 0 for the last, which every text has
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    @classmethod
    def fit(cls, rows: list[np.ndarray], labels: np.ndarray, share: float) -> FactorizationMachine:
        none = cls(np.empty(0, np.int64), np.zeros(1), float(np.log(share / (1 - share))), np.empty(0), np.empty((0, FACTORS)))
        if len(set(labels.tolist())) < 2:
            return none
        flat = np.concatenate(rows)
        terms, texts = np.unique(flat, return_counts=True)
        toxic = np.zeros(len(terms))
        found, times = np.unique(np.concatenate([r for r, y in zip(rows, labels) if y]), return_counts=True)
        toxic[np.searchsorted(terms, found)] = times
        value = term_values(toxic, texts - toxic, labels.sum(), len(labels) - labels.sum())
        terms, value = terms[texts >= LEAST_DOCS].astype(np.int64), value[texts >= LEAST_DOCS]
        if not len(terms):
            return none
        value = np.append(value, 0.0)
        kept = []
        for r in rows:
            i = np.searchsorted(terms, r)
            i[i == len(terms)] = 0
            # the last place is an always-zero term, so no row is empty
            kept.append(np.append(i[terms[i] == r], len(terms)))
        rng = np.random.default_rng(SEED)
        n, m = len(rows), len(terms) + 1
        w, v, bias = np.zeros(m), rng.normal(0, 0.01, (m, FACTORS)), 0.0
        v[-1] = 0
        gw, gv, gb = np.full(m, 1e-8), np.full((m, FACTORS), 1e-8), 1e-8
        for _ in range(EPOCHS):
            order = rng.permutation(n)
            for a in range(0, n, BATCH):
                pick = order[a : a + BATCH]
                sizes = np.array([len(kept[i]) for i in pick])
                idx = np.concatenate([kept[i] for i in pick])
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                y, sums = cls._forward(bias, w, v, value, idx, starts)
                g = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels[pick]) / len(pick)
                each = np.repeat(g, sizes) * value[idx]
                used, place = np.unique(idx, return_inverse=True)
                dw = np.bincount(place, each) + RIDGE * w[used]
                near = np.repeat(sums, sizes, axis=0) - v[idx] * value[idx, None]
                dv = np.stack([np.bincount(place, each * near[:, f]) for f in range(FACTORS)], axis=1) + RIDGE * v[used]
                gw[used] += dw**2
                gv[used] += dv**2
                w[used] -= RATE * dw / np.sqrt(gw[used])
                v[used] -= FACTOR_RATE * dv / np.sqrt(gv[used])
                gb += g.sum() ** 2
                bias -= RATE * g.sum() / np.sqrt(gb)
        sampled = (labels.sum() + 0.5) / (n + 1.0)
        bias += np.log(share / (1 - share)) - np.log(sampled / (1 - sampled))
        return cls(terms, value, float(bias), w, v)

    @staticmethod
    def _forward(bias: float, w: np.ndarray, v: np.ndarray, value: np.ndarray, idx: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = v[idx] * value[idx, None]
        sums = np.add.reduceat(x, starts, axis=0)
        pairs = 0.5 * (sums**2 - np.add.reduceat(x**2, starts, axis=0)).sum(1)
        return bias + np.add.reduceat(w[idx] * value[idx], starts) + pairs, sums

    def score(self, texts: list[bytes], terms: Terms) -> np.ndarray:
        """Probability of label 1 of each text."""
        if not len(self.terms):
            return np.full(len(texts), 1 / (1 + np.exp(-self.bias)))
        local: dict[bytes, int] = {}
        words = [list(set(t.split())) for t in texts]
        flat = np.fromiter((local.setdefault(w, len(local)) for ws in words for w in ws), np.int64)
        doc = np.repeat(np.arange(len(texts)), [len(ws) for ws in words])
        hashed = [terms[w] for w in local]
        sizes = np.fromiter(map(len, hashed), np.int64, len(hashed))
        all_terms = np.fromiter((t for ts in hashed for t in ts), np.int64, int(sizes.sum()))
        i = np.searchsorted(self.terms, all_terms)
        i[i == len(self.terms)] = 0
        known = self.terms[i] == all_terms
        owner = np.repeat(np.arange(len(local)), sizes)[known]
        i = i[known]
        # terms of each word of the slice, then of each document's words
        first = np.searchsorted(owner, np.arange(len(local) + 1))
        count = np.diff(first)[flat]
        at = np.repeat(first[:-1][flat], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        m = len(self.terms) + 1
        pair = distinct(np.concatenate([np.repeat(doc, count) * m + i[at], np.arange(len(texts)) * m + m - 1]))
        y, _ = self._forward(self.bias, self.weights, self.factors, self.values, pair % m, np.searchsorted(pair, np.arange(len(texts)) * m))
        return 1 / (1 + np.exp(-np.clip(y, -50, 50)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> FactorizationMachine:
    sample, share = labelled_sample(docs, labels, "toxic", per_class, SEED)
    rows = sample.mapInArrow(_term_lists, "doc_id long, label int, terms array<int>").toPandas().sort_values("doc_id", kind="stable")
    return FactorizationMachine.fit([np.asarray(t, np.int32) for t in rows["terms"]], rows["label"].to_numpy().astype(float), share)


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, fm = Terms(), model.value
        for part in chunks(batches, SCORE_BYTES):
            score = fm.score(text_bytes(part["text"].combine_chunks()), terms)
            rest = [n for n in part.column_names if n != "score"]
            yield pa.RecordBatch.from_arrays([part[n].combine_chunks() for n in rest] + [pa.array(score)], rest + ["score"])

    return run


def score_toxicity(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """``docs`` with a column ``score``, the probability of being toxic; a column of that name is replaced."""
    docs = docs.drop("score").withColumn("text", F.col("text").cast("string"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "score double"])
    return docs.mapInArrow(_scored(sent), schema)


def op2_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    scored = score_toxicity(docs, fit_toxicity(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
