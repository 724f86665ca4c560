"""URL filters: host-suffix and path-prefix rules found by hash prefix.

Method. A rule is a host and a path written one after the other. A URL is expanded into the
host suffixes and path prefixes that some rule could equal: only label counts and path lengths that
occur among the rules are expanded, so a long host or path costs no more. Expressions and
rules meet in an equi-join on the first 8 hex digits of SHA-256; the full digest then confirms, and
the longest confirmed rule wins. Everything is DataFrame functions.

The rules are broadcast only up to BROADCAST_RULES rows, counted first; more of them are joined by
a shuffle on the hash prefix. A URL's expressions fold back in one aggregation that is
combined before its exchange, so equal URLs or hosts meet in no task.

Defined results: null URLs and those without "://" have an empty host and path and get the
default verdict; equal rules of different verdicts count as block; repeated rows are
judged alike; an empty table gives no rows; without rules every URL gets the default. ``keys`` may not be named host, path, rule or
verdict; other columns of ``pages`` play no part.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselar.llm.common import fresh, table

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
DEFAULT = "allow"
BROADCAST_RULES = 100_000
SHORT = 8


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(host, path, verdict) as an inline table."""
    rows = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules])
    return spark.range(1).select(F.inline(rows))


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def url_parts(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.coalesce(_ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def judge_urls(pages: DataFrame, rules: DataFrame, keys: tuple[str, ...] = ("page_id",), default: str = DEFAULT) -> DataFrame:
    """``keys`` of each row of ``pages`` with host, path, rule and verdict. ``rules``: host, path, verdict."""
    rules = rules.select(_ascii_lower(F.col("host")).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), "verdict").where("r_host IS NOT NULL")
    rules = rules.groupBy("r_host", "r_path").agg(F.max("verdict").alias("r_verdict"))
    rules = rules.withColumn("rule", F.concat("r_host", "r_path")).withColumn("r_digest", F.sha2("rule", 256)).withColumn("short", F.substring("r_digest", 1, SHORT))
    # both sets are bounded: a host has at most 127 labels that a rule can name, and rule paths few lengths
    shape = rules.agg(F.collect_set(F.size(F.split("r_host", r"\."))).alias("labels"), F.collect_set(F.length("r_path")).alias("lengths"), F.count(F.lit(1)).alias("n")).first()
    host, path = url_parts(F.col("url"))
    urls = pages.select(*keys, host.alias("host"), path.alias("path"))
    row, suffix, prefix, digest, short, r_short, r_digest, r_host, r_verdict, best = fresh([*keys, "host", "path", "rule", "verdict", "r_path"], "row", "suffix", "prefix", "digest", "short_of", "short", "r_digest", "r_host", "r_verdict", "best")
    rules = rules.select("rule", F.col("short").alias(r_short), F.col("r_digest").alias(r_digest), F.col("r_host").alias(r_host), F.col("r_verdict").alias(r_verdict))
    urls = urls.withColumn(row, F.monotonically_increasing_id())
    labels = F.split("host", r"\.")
    count = F.size(labels)
    suffixes = F.array_distinct(F.array(*[F.when(count >= n, F.array_join(F.slice(labels, F.greatest(count - n + 1, F.lit(1)), F.lit(n)), ".")) for n in sorted(shape["labels"])]) if shape["n"] else F.array(F.lit(None).cast("string")))
    prefixes = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n) if n else F.lit("")) for n in sorted(shape["lengths"])]) if shape["n"] else F.array(F.lit(None).cast("string"))
    made = urls.withColumn(suffix, F.explode(suffixes)).withColumn(prefix, F.explode(prefixes))
    made = made.withColumn(digest, F.sha2(F.concat(suffix, prefix), 256)).drop(suffix, prefix).withColumn(short, F.substring(digest, 1, SHORT))
    side = F.broadcast(rules) if shape["n"] <= BROADCAST_RULES else rules
    met = made.join(side, F.col(short) == F.col(r_short), "left")
    found = F.when(F.col(digest) == F.col(r_digest), F.struct(F.length("rule").alias("n"), F.length(r_host).alias("h"), "rule", F.col(r_verdict).alias("verdict")))
    # grouped by the row and what it holds: no join back
    judged = met.groupBy(row, *keys, "host", "path").agg(F.max(found).alias(best))
    return judged.select(*keys, "host", "path", F.col(f"{best}.rule").alias("rule"), F.coalesce(f"{best}.verdict", F.lit(default)).alias("verdict"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rule_table(spark))


SQL = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), rules(rhost, rpath, verdict) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM (
  SELECT page_id, host, path, (
    SELECT max({'n': length(rhost || rpath), 'rule': rhost || rpath, 'verdict': rules.verdict}) FROM rules
    WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS best
  FROM parts)
"""
