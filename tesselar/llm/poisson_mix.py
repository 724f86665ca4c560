"""Mixing sources to target weights by Poisson replication.

Method. A source of n documents and target share w of a total of T documents has the rate
T * w / n. A document's number of copies is the Poisson quantile, at its source's rate, of a uniform
number made from the seed and its doc_id; it is exploded into so many rows, and these are dealt by a
hash of document and copy and sorted by it in each partition, which is a global shuffle without
a sort's sampling pass. Everything is DataFrame functions; a source that holds a third of all rows
is only counted (combined before the exchange) and joined to its rate.

The tables of all sources are broadcast up to BROADCAST_BYTES, counted first, else joined by a shuffle.

Defined results: a null source is a source of its own; a null doc_id draws as the empty string; rows
that repeat a doc_id draw alike and are all replicated; empty texts are documents as any; an empty
table gives no rows; a source without a given weight gets weight 0 and vanishes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselar.llm.common import fresh, repeated, shared_checkpoint, table

SEED = 17
BROADCAST_BYTES = 16 << 20
#: Rate of one draw, so that a source's table has some 800 sums at most.
MOST_RATE = 500.0


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from 52 bits of MD5."""
    text = F.concat_ws(":", *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_table(rate: Column) -> Column:
    """P(X <= k) from k = 0 up to where nothing is left that 52 bits can show."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct((-rate).alias("logp"), F.array(F.exp(-rate)).alias("sums"))

    def step(s: Column, k: Column) -> Column:
        logp = s["logp"] + F.ln(rate / k)
        return F.struct(logp.alias("logp"), F.concat(s["sums"], F.array(F.element_at(s["sums"], -1) + F.exp(logp))).alias("sums"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step)["sums"]).otherwise(F.array().cast("array<double>"))


def poisson_quantile(sums: Column, u: Column) -> Column:
    """Numbers k with P(X <= k) <= u."""
    return F.size(F.filter(sums, lambda total: total <= u))


def parts_of(rate: Column) -> Column:
    return F.greatest(F.ceil(rate / MOST_RATE), F.lit(1)).cast("int")


def copies_of(rate: Column, sums: Column, seed: int) -> Column:
    """A document's Poisson number; sums are those of a part of the rate. Up to MOST_RATE it is one draw, beyond it the sum of draws at equal parts of the rate, which is Poisson too."""
    parts = parts_of(rate)
    many = F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda n, j: n + poisson_quantile(sums, uniform(F.lit(seed), "doc_id", j)))
    return F.when(parts == 1, poisson_quantile(sums, uniform(F.lit(seed), "doc_id"))).otherwise(many)


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, total: int | None = None) -> DataFrame:
    """(source, rate). Without weights a source's weight is the square root of its size."""
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("size"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.sqrt("size"))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "name string, weight double")
        weighed = sizes.join(F.broadcast(given), sizes.source.eqNullSafe(given.name), "left").select("source", "size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    sums = weighed.agg(F.sum("size").alias("all"), F.sum("weight").alias("weights"))
    rate = F.lit(float(total)) if total is not None else F.col("all")
    # sums is one row
    return weighed.crossJoin(F.broadcast(sums)).select("source", F.when(F.col("weights") > 0, rate * F.col("weight") / F.col("weights") / F.col("size")).otherwise(F.lit(0.0)).alias("rate"))


def poisson_mix(docs: DataFrame, weights: dict[str | None, float] | None = None, total: int | None = None, seed: int = SEED) -> DataFrame:
    """Columns of ``docs`` (doc_id, text and source at least) with rate, copies and copy (from 1), in shuffled order. Columns of those names are replaced."""
    docs = docs.drop("rate", "copies", "copy")
    own, at, sums = fresh([*docs.columns, "rate", "copies", "copy"], "source_of_rate", "at", "sums")
    # a row for each source, with a table of its rate's sums: counted in bytes before it is broadcast
    rates = shared_checkpoint(source_rates(docs, weights, total).withColumnRenamed("source", own).withColumn(sums, poisson_table(F.col("rate") / parts_of(F.col("rate")))))
    held = rates.agg(F.coalesce(F.sum(8 * F.size(sums) + F.coalesce(F.octet_length(own), F.lit(0)) + 64), F.lit(0))).first()[0]
    if held <= BROADCAST_BYTES:
        rates = F.broadcast(rates)
    drawn = docs.join(rates, F.col("source").eqNullSafe(F.col(own))).drop(own).withColumn("copies", copies_of(F.col("rate"), F.col(sums), seed)).drop(sums)
    many = repeated(drawn, "copies", "copy")
    many = many.withColumn(at, F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("copy"), F.xxhash64("text")))
    return many.repartition(at).sortWithinPartitions(at).drop(at)


def op9_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson_mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "text", F.round("rate", 9).alias("rate"), "copies", "copy")


SQL = r"""
WITH RECURSIVE sizes AS (
  SELECT source, count(*) AS size FROM documents GROUP BY source
), rates AS (
  SELECT source, rate, greatest(ceil(rate / 500), 1)::INTEGER AS parts FROM (
    SELECT source, (SELECT sum(size) FROM sizes) * sqrt(size) / (SELECT sum(sqrt(size)) FROM sizes) / size AS rate FROM sizes)
), steps(source, rate, parts, r, k, logp, cdf) AS (
  SELECT source, rate, parts, rate / parts, 0, -rate / parts, exp(-rate / parts) FROM rates
  UNION ALL
  SELECT source, rate, parts, r, k + 1, logp + ln(r / (k + 1)), cdf + exp(logp + ln(r / (k + 1))) FROM steps WHERE k < ceil(r + 12 * sqrt(r) + 30)
), cdfs AS (
  SELECT source, any_value(rate) AS rate, any_value(parts) AS parts, list(cdf ORDER BY k) AS cdf FROM steps GROUP BY source
), seeds AS (
  SELECT doc_id, documents.source, text, rate, cdf, '17:' || coalesce(doc_id::VARCHAR, '') AS name, parts FROM documents JOIN cdfs ON documents.source IS NOT DISTINCT FROM cdfs.source
), draws AS (
  SELECT *, CASE WHEN parts = 1 THEN [name] ELSE list_transform(range(1, parts + 1), lambda j: name || ':' || j) END AS names FROM seeds
), drawn AS (
  SELECT doc_id, source, text, round(rate, 9) AS rate,
    list_sum(list_transform(names, lambda x: len(list_filter(cdf, lambda c: c <= ('0x' || substr(md5(x), 1, 13))::BIGINT / 4503599627370496.0))))::INTEGER AS copies FROM draws
)
SELECT doc_id, source, text, rate, copies, unnest(range(1, copies + 1))::INTEGER AS copy FROM drawn
"""
