import collections
import hashlib
import math

import corpus_pipeline
from tests.llm.test_operators import DATA, brute_components


def test_stages_keep_the_columns_and_do_their_work(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {}
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, DATA)
        assert after.columns == docs.columns
        after = after.cache()
        kept[name] = {r.doc_id: r.text for r in after.collect()}
        before = after
    toxic = [k for k, y in labels.items() if y]
    assert sum(k in kept["toxicity"] for k in toxic) < 0.3 * len(toxic)
    assert len(kept["toxicity"]) > 0.85 * docs.count()
    groups = brute_components(sorted(kept["toxicity"].items()))
    assert set(kept["ngram_jaccard_join"]) == {k for k, (_, c) in groups.items() if c == k}
    # windows that an earlier document starts are gone
    seen, want = {}, {}
    for k, t in sorted(kept["ngram_jaccard_join"].items()):
        w = t.encode().split()
        out = [True] * len(w)
        own = [b" ".join(w[i : i + 13]) for i in range(len(w) - 12)]
        for i, x in enumerate(own):
            if x in seen:
                out[i : i + 13] = [False] * 13
        for x in own:
            seen.setdefault(x, k)
        want[k] = t if all(out) else b" ".join(x for x, o in zip(w, out) if o).decode()
    sha = lambda d: {k: hashlib.sha256(t.encode()).hexdigest() for k, t in d.items()}
    assert sha(kept["substring_dedup"]) == sha(want)
    # copies are the Poisson quantile of the hashed id at the source's rate
    rows = docs.join(before.select("doc_id").distinct(), "doc_id", "left_semi").count()
    assert rows == len(kept["source_mix"])
    sources = {r.doc_id: r.source for r in docs.collect() if r.doc_id in kept["substring_dedup"]}
    sizes = collections.Counter(sources.values())
    share = sum(math.sqrt(n) for n in sizes.values())
    drawn = collections.Counter(r.doc_id for r in before.select("doc_id").collect())
    for k, source in sources.items():
        rate = len(sources) * math.sqrt(sizes[source]) / share / sizes[source]
        u, n, term = int(hashlib.md5(f"17:{k}".encode()).hexdigest()[:13], 16) / 2**52, 0, math.exp(-rate)
        total = term
        while total <= u:
            n += 1
            term *= rate / n
            total += term
        assert drawn[k] == n
    # every copy's pieces lie gapless in sequences
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, DATA).collect()
    assert collections.Counter(r.doc_id for r in pieces if r.piece == 0) == drawn
    by_sequence = collections.defaultdict(list)
    for r in pieces:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_sequence) <= 1.01 * sum(r.length for r in pieces) / 2048 + 1


def test_stages_take_nulls_repeats_and_further_columns(spark):
    text, other = (" ".join(f"{c}{i}" for i in range(40)) for c in ("word", "other"))
    rows = [(1, text), (2, text), (2, text), (None, text), (None, None), (3, ""), (4, None), (5, text + " " + other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang", "CAST(NULL AS string) AS source", "length(text) AS n_chars", "1 AS score", "2 AS copies")
    docs = corpus_pipeline.without_toxic(spark, docs, DATA)
    assert docs.count() == len(rows) and docs.columns == corpus_pipeline.COLUMNS
    docs = corpus_pipeline.without_near_copies(spark, docs, DATA)
    assert sorted(r.doc_id or 0 for r in docs.collect()) == [0, 0, 1, 3, 4, 5]
    docs = corpus_pipeline.without_repeated_passages(spark, docs, DATA)
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in docs.collect()) == [(0, 0), (0, 0), (1, len(text)), (3, 0), (4, 0), (5, len(other))]
    assert corpus_pipeline.packed(spark, corpus_pipeline.mixed_sources(spark, docs, DATA), DATA).count() > 0


def test_run(spark):
    rows = corpus_pipeline.run(spark, DATA)
    assert rows.count() > 500 and {"doc_id", "piece", "sequence_id", "offset"} <= set(rows.columns)


def test_no_stage_fails_on_no_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0
