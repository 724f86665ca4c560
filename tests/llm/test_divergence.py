"""The divergence audit against its definition."""

import re

import pytest
from pyspark.sql import functions as F

from tesselar.llm import divergence
from tesselar.llm import queries as llm


def test_sql(same):
    same(llm.queries()["op13_source_divergence"], llm.oracle_sql()["op13_source_divergence"])


def by_definition(rows, least_docs, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    out = []
    for lang in {r[1] for r in rows}:
        own = [(terms(t), s) for t, g, s in rows if g == lang]
        kept = sorted(w for w in {w for t, _ in own for w in t} if sum(w in t for t, _ in own) >= least_docs)

        def priced(of):
            counts = [sum(t.count(w) for t, s in own if of is None or s == of) for w in kept]
            return [(c, 1 + 10**9 * (c + 2) // (sum(counts) + 2 * len(kept))) for c in counts]

        groups = {s: priced(s) for s in {s for _, s in own}}
        whole, f = priced(None), lambda p, q: (p - q) ** 2 // (p + q)
        for s, a in groups.items():
            pairs = sorted((-sum(f(p, q) for (_, p), (_, q) in zip(a, b)), o.encode()) for o, b in groups.items() if o != s)
            best = sorted((-f(p, q), w.encode()) for w, (c, p), (_, q) in zip(kept, a, whole) if c > 0 and p > q)[:top]
            for part, items in (("pair", pairs), ("term", best)):
                out += [(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(items, 1)]
    return sorted(out)


ROWS = [
    ("The cat, the DOG; the ÄÖ äö Bird.", "en", "a"), ("the cat the cat the cat 12 x9y", "en", "b"), ("dog dog bird", "en", "c"), (None, "en", "d"), ("", "en", ""), ("cat", "en", None),
    ("der Hund", "de", "a"), ("die Katze", "de", "b"), ("x", None, "a"), ("x x x", None, "b"), ("x", "", "b"), ("漢字 漢字 cat\x00dog_the", "en", "a"), ("the", "en", "a"), ("the", "en", "a"),
]


@pytest.mark.parametrize("least_docs,top", [(1, 3), (2, 10), (3, 2), (50, 5)])
def test_definition(spark, least_docs, top):
    docs = spark.createDataFrame([(*r, 1) for r in ROWS], "text string, lang string, source string, doc_id int")
    docs = docs.select("*", *[F.lit("x").alias(c) for c in ("term", "n", "item", "value", "p0", "v")]).repartition(3)
    got = sorted(tuple(r) for r in divergence.divergence_audit(docs, least_docs, top).collect())
    assert got == by_definition(ROWS, least_docs, top)


def test_empty_table_and_large_counts(spark):
    docs = spark.createDataFrame([("a", "en", "s")], "text string, lang string, source string").where("false")
    assert divergence.divergence_audit(docs).count() == 0
    # products beyond 64 bits stay exact
    row = spark.range(1).select(F.lit(10**13).cast("long").alias("n"), F.lit(3 * 10**13).cast("long").alias("t"), F.lit(7).cast("long").alias("v")).select(divergence.probability("n", "t", "v").alias("p")).first()
    assert row.p == 1 + 10**9 * (10**13 + 2) // (3 * 10**13 + 14)


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 10)
    text = "ab cde fghij klm n opqrstuvwxyzabc de f " * 5
    assert [w for p in divergence._pieces(text.encode()) for w in p.split()] == text.encode().split()
