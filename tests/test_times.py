"""Joins on time against plain loops, with nulls, ties and slices; sketches within their errors."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tesselar.operators import asof, summaries

DAY = datetime(2024, 1, 1)
at = lambda s: None if s is None else DAY + timedelta(seconds=s)


def sides(spark, seed, n=150):
    r = random.Random(seed)
    moment = lambda: None if r.random() < 0.05 else r.randrange(4000)
    key = lambda: r.choice("aaaaabc") if r.random() < 0.95 else None
    left, right = [(i, key(), moment()) for i in range(n)], [(i, key(), moment()) for i in range(n // 2)]
    a = spark.createDataFrame([(i, k, at(s)) for i, k, s in left], "i long, k string, at timestamp_ntz").repartition(3)
    b = spark.createDataFrame([(i, k, at(s), f"v{i}") for i, k, s in right], "j long, k string, since timestamp_ntz, v string").repartition(4)
    return left, right, a, b


@pytest.mark.parametrize("slice_seconds", [100, 86_400])
def test_as_of(spark, slice_seconds):
    left, right, a, b = sides(spark, slice_seconds)
    got = asof.as_of(a, b, ["k"], "at", "since", "j", "of_", slice_seconds).collect()
    want = {}
    for i, k, s in left:
        found = [(t, j) for j, q, t in right if k is not None and q == k and s is not None and t is not None and t <= s]
        want[i] = max(found)[1] if found else None
    assert {r.i: r.of_j for r in got} == want and len(got) == len(left) and len(set(want.values())) > 20
    assert all(r.of_v == (None if r.of_j is None else f"v{r.of_j}") and (r.of_since is None) == (r.of_j is None) for r in got)


@pytest.mark.parametrize("before,after", [(0, 0), (30, 90), (500, 0)])
def test_within(spark, before, after):
    left, right, a, b = sides(spark, before + after, 200)
    got = sorted((r.i, r.j) for r in asof.within(a, b, ["k"], "at", "since", before, after).collect())
    assert got == sorted((i, j) for i, k, s in left for j, q, t in right if k is not None and k == q and s is not None and t is not None and s - before <= t <= s + after)


def test_sketches_stay_within_their_errors(spark):
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("k"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("id") % 240).cast("int"))).alias("at"), (F.xxhash64("id") % 5_000).alias("who"), F.col("id").cast("double").alias("value"))
    daily = summaries.daily_sketches(rows, ["k"], "at", "who", "value")
    assert daily.count() == 20
    exact = {r.k: r for r in rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("who").alias("d"), F.collect_list("value").alias("values")).collect()}
    for r in summaries.merged_sketches(daily, ["k"], [0.1, 0.5, 0.9]).collect():
        e = exact[r.k]
        # three standard errors of either sketch
        assert r.n == e.n and abs(r.distinct_estimate / e.d - 1) < 3 * 1.04 / 2 ** (summaries.HLL_BITS / 2)
        values = sorted(e["values"])
        for q, x in zip([0.1, 0.5, 0.9], r.quantile_estimates):
            assert abs(sum(v <= x for v in values) / len(values) - q) < 3 * 0.0133


def test_grouping_sets_keep_nulls_of_the_data(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), (None, "x")], "p string, q string")
    got = sorted((tuple(r) for r in summaries.by_sets(df, [["p"], ["q"], []], {"n": F.count(F.lit(1))}).collect()), key=str)
    assert got == sorted([("p", "a", None, 2), ("p", None, None, 1), ("q", None, "x", 2), ("q", None, None, 1), ("all", None, None, 3)], key=str)
