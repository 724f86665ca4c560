"""Suffix arrays by linear grouping, and the dedup built on them, against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesselar.llm import suffix_dedup
from tesselar.llm.suffix_array import suffix_array

DATA = "/root/testdata/sf0.01"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array_is_sorted(symbols):
    assert suffix_array(symbols) == sorted(range(len(symbols)), key=lambda i: symbols[i:])


@pytest.mark.parametrize("symbols", [[1] * 400, [1, 2] * 200, list(range(300)), list(range(300))[::-1], [2, 1] * 100 + [3], [5] + [0] * 99 + [5] * 2])
def test_suffix_array_of_runs(symbols):
    assert suffix_array(symbols) == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def brute(texts, window):
    seen = {}
    for t in texts:
        for p in range(len(t) - window + 1):
            seen[t[p : p + window]] = seen.get(t[p : p + window], 0) + 1
    out = []
    for t in texts:
        edge = np.zeros(len(t) + 1, int)
        for p in range(len(t) - window + 1):
            if seen[t[p : p + window]] > 1:
                edge[p] += 1
                edge[p + window] -= 1
        gone = np.cumsum(edge)[:-1] > 0
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((len(t), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def found(docs, **how):
    rows = suffix_dedup.suffix_dedup(docs, **how).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    return sorted((r.doc_id is not None, *r) for r in rows)


def expected(docs, window):
    rows = docs.collect()
    return sorted((r.doc_id is not None, r.doc_id, *b) for r, b in zip(rows, brute([(r.text or "").encode() for r in rows], window)))


def odd_rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeß漢 ") for _ in range(rng.randrange(2, 9)))
    passage = " ".join(word() for _ in range(40))
    rows = [(1, passage), (2, passage), (2, passage), (3, "x" + passage + "y"), (4, None), (5, ""), (6, "short"), (None, "q " + passage[5:]), (None, passage), (7, "a" * 900), (8, "ab" * 300)]
    for i in range(60):
        # passages cut at any byte's character, with own surroundings, so that matches end everywhere
        a = rng.randrange(len(passage) - 30)
        rows.append((100 + i, " ".join(word() for _ in range(rng.randrange(20))) + passage[a : a + rng.randrange(20, 200)] + " ".join(word() for _ in range(rng.randrange(20)))))
    return rows


@pytest.mark.parametrize("how", [{"window": 40, "gram": 8, "span": 8}, {"window": 40, "gram": 8, "span": 8, "group": 2}, {"window": 50, "gram": 16, "span": 64, "group": 3}, {"window": 33, "gram": 33, "span": 1}])
def test_odd_rows(spark, how):
    docs = spark.createDataFrame(odd_rows(), "doc_id long, text string").repartition(5)
    assert found(docs, **how) == expected(docs, how["window"])


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    got = sorted((r.doc_id is not None, *r) for r in suffix_dedup.op11_suffix_array_dedup(spark, DATA).collect())
    assert got == expected(docs, 400)


def test_columns_and_empty_table(spark):
    docs = spark.createDataFrame(odd_rows(), "doc_id long, text string").select("doc_id", "text", *[F.lit(7).alias(c) for c in ("doc", "tag", "packed", "hits", "own_doc", "n_bytes", "at", "core", "units")])
    out = suffix_dedup.suffix_dedup(docs, window=40, gram=8, span=8)
    rows = out.collect()
    assert len(rows) == docs.count() and {r.tag for r in rows} == {7}
    for r in rows:
        assert r.n_removed == sum(e - s for s, e in r.removed) and len(r.kept) == r.n_bytes - r.n_removed and r.n_spans == len(r.removed)
    assert suffix_dedup.suffix_dedup(docs.where("false")).count() == 0


def test_long_texts_come_in_pieces(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 50)
    texts = ["a" * 10, "bcd" * 60, "", "e" * 50, "f" * 51]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5), pa.int64()), pa.array(range(5), pa.int64()), pa.array(texts)], ["doc", "tag", "text"])
    windows = {}
    for text, lengths, docs, _, starts in suffix_dedup._texts([batch], 20):
        ends = np.cumsum(lengths)
        for d, b, n, s in zip(docs, ends - lengths, lengths, starts):
            for p in range(n - 19):
                assert (d, s + p) not in windows
                windows[d, s + p] = text[b + p : b + p + 20].tobytes().decode()
    assert windows == {(d, p): t[p : p + 20] for d, t in enumerate(texts) for p in range(len(t) - 19)}
