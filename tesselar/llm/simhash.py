"""Document fingerprints: SimHash over words, with permuted block tables for near fingerprints.

Method. Every word of a text votes with its weight, the square of its length (at most 16), for the
set bits of its 64-bit hash and against the others; so the frequent short words weigh little.
The signs are the fingerprint. A long holds two 32-bit counters, so 32 sums
count all 64 bits. ``near_fingerprints`` cuts fingerprints into blocks; two that differ in at
most ``radius`` bits agree in all but ``radius`` blocks, hence share the key of one of the
tables, each of which puts another choice of blocks in front. Everything is DataFrame functions.

The query also fingerprints an edited text, whose end is the start of the next document in descending
doc_id. Rows are dealt by ranges of doc_id about equal in bytes; the row at a range's edge goes
to the neighbouring range too. So texts cross the network once and no task holds more than its range.

Defined results: null and empty texts and those without words have the fingerprint 0...0; a null
doc_id comes after all others (and is no query of the search); rows that repeat a doc_id follow each other in the order of their
texts; of one document the next is itself; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesselar.llm.common import corpus_size, parts_for, shared_checkpoint, table

SPACE = r"[ \t\n\x0B\f\r]+"
RANGE_BYTES = 2 << 20
#: Differing bits of near fingerprints; rows whose doc_id is divisible by QUERY_EVERY are searched for.
RADIUS, QUERY_EVERY = 3, 50
#: Two counters of 32 bits in a long.
LANES = 0x100000001
LOWEST = -(2**63)


def _votes() -> list[Column]:
    weight = F.least(F.length("word"), F.lit(16)).cast("long")
    weight = weight * weight
    h = F.xxhash64("word")
    counts = [F.sum(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(LANES)) * weight).alias(f"c{j}") for j in range(32)]
    return [*counts, F.sum(weight).alias("all")]


def _signs() -> Column:
    """Fingerprint of the sums of ``_votes`` as 16 hex digits."""
    half = 0x7FFFFFFF * 2 + 1
    bits = F.lit(0).cast("long")
    for j in range(32):
        low, high = F.col(f"c{j}").bitwiseAND(F.lit(half)), F.shiftrightunsigned(f"c{j}", 32)
        bits = bits.bitwiseOR(F.when(low * 2 > F.col("all"), F.lit(1 << j).cast("long")).otherwise(F.lit(0).cast("long")))
        bits = bits.bitwiseOR(F.when(high * 2 > F.col("all"), F.lit((1 << (j + 32)) - (1 << 64 if j == 31 else 0)).cast("long")).otherwise(F.lit(0).cast("long")))
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def _long_of(fingerprint: Column) -> Column:
    high, low = (F.conv(F.substring(fingerprint, a, 8), 16, 10).cast("long") for a in (1, 9))
    return F.shiftleft(high, 32).bitwiseOR(low)


def likeness(a: Column, b: Column) -> Column:
    """1 less the share of differing bits of two fingerprints."""
    return 1 - F.bit_count(_long_of(a).bitwiseXOR(_long_of(b))) / F.lit(64.0)


def simhash(texts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` with the fingerprint of ``text``; one row for each combination of keys."""
    words = texts.select(*keys, F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), SPACE)).alias("word"))
    return words.groupBy(*keys).agg(*_votes()).select(*keys, _signs().alias("fingerprint"))


def near_fingerprints(prints: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """(query, fingerprint): fingerprints of ``prints`` within ``radius`` differing bits of one of ``queries``, each pair once.

    Both hold distinct values in a column ``fingerprint``. With b blocks there are C(b, radius) tables,
    each keyed by b - radius whole blocks: more blocks make longer keys and shorter runs. Of the tables in which
    a pair meets only the first one gives it.
    """
    blocks = blocks or radius + 3
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in kept) for kept in combinations(range(blocks), blocks - radius)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]

    def keyed(df: DataFrame, name: str) -> DataFrame:
        v = _long_of(F.col("fingerprint"))
        tables = F.array(*[F.struct(F.lit(t).alias("t"), v.bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)])
        return df.select(v.alias(name), F.inline(tables))

    a, b = keyed(queries.select("fingerprint").distinct(), "query_bits"), keyed(prints.select("fingerprint").distinct(), "print_bits")
    differ = F.col("query_bits").bitwiseXOR(F.col("print_bits"))
    found = a.join(b, [a.t == b.t, a.key == b.key, F.bit_count(differ) <= radius]).select(a.t, "query_bits", "print_bits")
    earlier = F.exists(F.slice(F.array(*map(F.lit, masks)), F.lit(1), F.col("t")), lambda m: differ.bitwiseAND(m) == 0)
    hexed = [F.lower(F.lpad(F.hex(c), 16, "0")).alias(n) for c, n in (("query_bits", "query"), ("print_bits", "fingerprint"))]
    return found.where(~earlier).select(*hexed)


def with_near_counts(prints: DataFrame, every: int = QUERY_EVERY, radius: int = RADIUS) -> DataFrame:
    """``prints`` (doc_id, fingerprint, ...) with ``near_count``: of rows whose doc_id is divisible by ``every``, the number of distinct
    fingerprints within the radius, its own included; else null."""
    asked = F.col("doc_id") % every == 0
    counts = near_fingerprints(prints, prints.where(asked), radius).groupBy("query").agg(F.count(F.lit(1)).alias("near_count"))
    queries = prints.where(asked).join(counts, F.col("fingerprint") == F.col("query"), "left").drop("query")
    rest = prints.where(F.coalesce(~asked, F.lit(True))).withColumn("near_count", F.lit(None).cast("long"))
    return queries.unionByName(rest)


def with_next_text(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(pid, rn, guest, doc_id, text, next_text): rows of ``docs`` and, as guests, neighbours' first rows."""
    rows, size = corpus_size(docs)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST + 1))
    parts = min(parts_for(size, range_bytes), max(1, rows // 2), 9_000)
    ids = docs.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)] or [1.0], 10_000).alias("cuts"), F.max(key).alias("top")).first()
    cuts = sorted(set(ids["cuts"] or [])) if parts > 1 else []
    cuts = [c for c in cuts if c != ids["top"]]
    # two levels: an id is compared with about twice the root of the number of ranges
    group = 64
    coarse = F.array(*[F.lit(c).cast("long") for c in cuts[group - 1 :: group]]) if cuts[group - 1 :: group] else F.array().cast("array<long>")
    fine = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    at = F.size(F.filter(coarse, lambda c: c < F.col("key"))) * group
    pid = at + F.size(F.filter(F.slice(fine, at + 1, group), lambda c: c < F.col("key")))
    named = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), key.alias("key")).withColumn("pid", pid)
    last = len(cuts)
    own = F.struct(F.col("pid"), F.col("key"), F.lit(False).alias("guest"))
    up = F.when(F.array_contains(F.slice(fine, F.least(F.col("pid") + 1, F.lit(max(1, last))), 1), F.col("key")) & (F.col("pid") < last), F.struct((F.col("pid") + 1).alias("pid"), "key", F.lit(True).alias("guest")))
    around = F.when(F.col("key") == F.lit(ids["top"]), F.struct(F.lit(0).alias("pid"), F.lit(LOWEST).alias("key"), F.lit(True).alias("guest")))
    placed = named.select("doc_id", "text", F.inline(F.array_compact(F.array(own, up, around))))
    order = W.partitionBy("pid").orderBy(F.col("key").desc(), "text")
    return placed.select("pid", "guest", "doc_id", "text", F.row_number().over(order).alias("rn"), F.lead("text").over(order).alias("next_text"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    rows = with_next_text(docs)
    n = F.length("text")
    half = F.floor(n / 2)
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - half).cast("int")), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half.cast("int")))
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.when(~F.col("guest"), edited))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    texts = F.array_compact(F.array(F.struct(F.lit(0).alias("part"), "text"), F.when(~F.col("guest"), F.struct(F.lit(1).alias("part"), F.col("edited").alias("text")))))
    keys = ["pid", "rn", "guest", "doc_id", "n_chars", "edited_sha256"]
    prints = simhash(rows.select(*keys, F.inline(texts)), [*keys, "part"])
    # a row's two fingerprints lie side by side; all stays dealt by pid
    both = prints.groupBy(*keys).agg(F.max(F.when(F.col("part") == 0, F.col("fingerprint"))).alias("fingerprint"), F.max(F.when(F.col("part") == 1, F.col("fingerprint"))).alias("edited_fingerprint"))
    nxt = F.lead("fingerprint").over(W.partitionBy("pid").orderBy("rn"))
    out = both.withColumn("next_fingerprint", nxt).where("NOT guest")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))


def op5_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the prints are read twice; texts only once
    return with_near_counts(shared_checkpoint(fingerprint_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))))
