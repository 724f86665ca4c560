"""Roll-ups over several sets of columns in one pass, and daily sketches that are merged instead of scanning again (the absent aggregates of section 2.5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Standard error of an HLL estimate with 2**HLL_BITS registers is 1.04 / sqrt(2**HLL_BITS): 1.6 % at 12.
HLL_BITS = 12
#: A KLL sketch's rank error for a single quantile is some 1.33 % at this size.
KLL_K = 200


def by_sets(rows: DataFrame, sets: list[list[str]], measures: dict[str, Column]) -> DataFrame:
    """Measures for each of the sets of columns, in one pass over the rows (A4-A10): a row names its set, and has null in the columns that the set
    leaves out; a null of the data keeps a group of its own."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    names = F.lit("")
    for s in sets:
        left_out = sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in s)
        names = F.when(F.grouping_id() == left_out, ",".join(s) or "all").otherwise(names)
    told = rows.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(*[m.alias(n) for n, m in measures.items()], names.alias("dimensions"))
    return told.select("dimensions", *columns, *measures)


def daily_sketches(rows: DataFrame, keys: list[str], at: str, distinct: str, measure: str) -> DataFrame:
    """(keys, day, n, who, how_much): of each day and key the number of rows, an HLL sketch of the values of ``distinct``, and a KLL sketch of ``measure``. A
    day is made once; a sketch has a bounded size."""
    day = F.to_date(F.col(at)).alias("day")
    return rows.groupBy(*keys, day).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(distinct, HLL_BITS).alias("who"), F.kll_sketch_agg_double(F.col(measure).cast("double"), KLL_K).alias("how_much"))


def merged_sketches(daily: DataFrame, keys: list[str], quantiles: list[float]) -> DataFrame:
    """(keys, n, distinct_estimate, quantile_estimates) of any days' sketches together."""
    both = daily.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("who").alias("who"), F.kll_merge_agg_double("how_much").alias("how_much"))
    estimates = F.kll_sketch_get_quantile_double("how_much", F.array(*map(F.lit, quantiles)))
    return both.select(*keys, "n", F.hll_sketch_estimate("who").alias("distinct_estimate"), estimates.alias("quantile_estimates"))
