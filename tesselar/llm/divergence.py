"""Source divergence audit: how far the sources of a language are from each other in their words, and by which terms.

A language keeps the terms that at least ``least_docs`` of its documents hold. A source (and the language) gives each
kept term the whole-number probability p(count) = 1 + floor(SCALE * (count + 2) / (N + 2 * V)); two probabilities
differ by f(p, q) = floor((p - q)^2 / (p + q)); the divergence of two sources is the sum of f over all kept terms.

Method: inclusion and exclusion over supports, so that no source ever gets a row for a term that it lacks. With A and B the terms that
two sources hold, and f00 the value of a term that neither holds,

    sum = V * f00 + sum over A of (f(p, q0) - f00) + sum over B of (f(p0, q) - f00) + sum over A and B of (f(p, q) - f(p, q0) - f(p0, q) + f00)

The first part is a constant of the pair. The one-sided sums depend on counts only, so they are taken from a
histogram (terms of a source with a count). The last sum joins the sparse postings of a term, each pair of sources once,
and its rows are added up before they are exchanged.

Scale. Texts are counted in tasks, a term of a source once for so many tokens (``FLUSH``), so a very common term costs an entry a task
and source; the entries are exchanged once, by language and term, and all that follows on postings keeps that partitioning. A term has at
most a posting a source. Groups' totals are broadcast up to BROADCAST_BYTES, and joined by Spark beyond. The ten best terms of a group
are cut in each task before they are exchanged. Pairs of sources are the result itself, so the work on them is its size.

Defined results: null text, lang and source count as empty; every row is a document, also one that repeats another or its doc_id; a text
without terms makes its group occur; a language without kept terms gives 0 to each pair and no terms; ties
go by the item's UTF-8 bytes; an empty table gives no rows; other columns are not read. Whole numbers are exact: products
beyond 64 bits are decimals.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselar.llm.common import give_back, shared_checkpoint, table

LEAST_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
#: Entries after which a task sends what it has counted; bounds its memory.
FLUSH = 300_000
#: Bytes of a long text that are split into terms at a time.
PIECE = 1 << 20
#: Size up to which the totals of all groups are broadcast.
BROADCAST_BYTES = 32 << 20

#: Letters A-Z lower-cased, all other ASCII but a-z to a space; bytes from 0x80 on belong to terms.
TERM_BYTES = bytes(c if c >= 0x80 or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))


def _pieces(text: bytes) -> Iterator[bytes]:
    """A translated text in pieces of about PIECE bytes, cut at spaces."""
    start = 0
    while len(text) - start > PIECE:
        end = text.find(b" ", start + PIECE)
        if end < 0:
            break
        yield text[start:end]
        start = end
    yield text[start:]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a task's rows."""
    times: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), n in times.items():
            terms = pa.array(list(n), pa.binary()).cast(pa.string())
            held = docs[lang, source]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), terms, pa.array(n.values(), pa.int64()), pa.array((held[t] for t in n), pa.int64(), size=len(n))], ["lang", "source", "term", "n", "docs"]
            )
        times.clear()
        docs.clear()

    entries = 0
    for batch in batches:
        for text, lang, source in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            key = lang, source
            if key not in times:
                times[key], docs[key] = Counter(), Counter()
            n, before = times[key], len(times[key])
            seen: set[bytes] = set()
            for piece in _pieces((text.as_py() or b"").translate(TERM_BYTES)):
                terms = piece.split()
                n.update(terms)
                seen.update(terms)
            docs[key].update(seen)
            entries += len(n) - before
            if entries >= FLUSH:
                yield from sent()
                entries = 0
    yield from sent()
    give_back()


def probability(count: str, total: str, kept: str) -> Column:
    """p of a count in a group of ``total`` kept tokens in a language of ``kept`` terms; its product may pass 64 bits."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10,0)) * cast({count} + 2 as decimal(19,0))) div cast({total} + 2 * {kept} as decimal(20,0))")


def difference(p: str, q: str) -> str:
    """f of two probabilities, each at most SCALE + 1, so that the square fits 64 bits."""
    return f"(({p} - {q}) * ({p} - {q}) div ({p} + {q}))"


def postings(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, source, n, lang_n) of the kept terms: occurrences in the source, and in the language."""
    texts = docs.select(F.col("text").cast("string").alias("text"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")])
    counted = texts.mapInArrow(_counts, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    own = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    return own.withColumn("lang_n", F.sum("n").over(term)).withColumn("held", F.sum("docs").over(term)).where(F.col("held") >= least_docs).drop("held", "docs")


def _small(df: DataFrame) -> DataFrame:
    """Checkpointed, and marked for broadcast if all its strings and numbers take few bytes."""
    df = shared_checkpoint(df)
    size = df.agg(F.sum(F.octet_length("lang") + F.octet_length("source") + 80)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def divergence_audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): of each group its divergence from each other source of its language (part ``pair``), and
    the terms that it uses most above its language (part ``term``, ranks to ``top_terms``)."""
    kept = shared_checkpoint(postings(docs, least_docs))
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    of_lang = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("lang_total"))
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    totals = groups.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(0, ["total", "v", "lang_total"])
    stats = _small(totals.withColumn("p0", F.when(F.col("v") > 0, probability("0", "total", "v")).otherwise(1)))
    # pairs of sources, each once
    a, b = stats.select("lang", F.col("source").alias("a"), "v", F.col("p0").alias("a0")), stats.select("lang", F.col("source").alias("b"), F.col("p0").alias("b0"))
    constants = a.join(b, "lang").where("a < b").select("lang", "a", "b", F.expr(f"v * {difference('a0', 'b0')}").alias("part_value"))
    priced = kept.join(stats.select("lang", "source", "total", "v", "lang_total", "p0"), ["lang", "source"]).withColumn("p", probability("n", "total", "v"))
    histogram = priced.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("terms"))
    one = histogram.join(stats.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0")), "lang").where("source <> other")
    one = one.select("lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"), F.expr(f"terms * ({difference('p', 'q0')} - {difference('p0', 'q0')})").alias("part_value"))
    left, right = priced.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("p0").alias("a0")), priced.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("p0").alias("b0"))
    both = left.join(right, (left.lang == right.lang) & (left.term == right.term) & (left.a < right.b)).select(
        left.lang, "a", "b", F.expr(f"{difference('pa', 'pb')} - {difference('pa', 'b0')} - {difference('a0', 'pb')} + {difference('a0', 'b0')}").alias("part_value")
    )
    parts = [x.groupBy("lang", "a", "b").agg(F.sum("part_value").alias("part_value")) for x in (one, both)]
    sums = constants.unionByName(parts[0]).unionByName(parts[1]).groupBy("lang", "a", "b").agg(F.sum("part_value").alias("value"))
    mirrored = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    order = [F.col("value").desc(), F.col("item")]
    pairs = sums.select("lang", mirrored.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))
    above = priced.withColumn("q", probability("lang_n", "lang_total", "v")).where("n > 0 and p > q")
    terms = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(difference("p", "q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).where(F.col("rank") <= top_terms)
    return pairs.unionByName(terms).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit(table(spark, sf_dir, "documents"))


#: By the definition: every kept term for every group, counts of 0 included.
SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), occurring AS (
  SELECT id, lang, source, unnest(terms) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS lang_n FROM occurring GROUP BY lang, term HAVING count(DISTINCT id) >= 10
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM occurring GROUP BY ALL
), grid AS (
  SELECT g.lang, g.source, k.term, k.lang_n, coalesce(c.n, 0) AS n,
    sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total, count(*) OVER (PARTITION BY g.lang, g.source) AS v
  FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), langs AS (
  SELECT lang, sum(lang_n) AS lang_total FROM kept GROUP BY lang
), priced AS (
  SELECT grid.lang, source, term, n, (1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v))::HUGEINT AS p,
    (1 + (1000000000::HUGEINT * (lang_n + 2)) // (lang_total + 2 * v))::HUGEINT AS q
  FROM grid JOIN langs ON grid.lang = langs.lang
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), all_pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM priced WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM all_pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
