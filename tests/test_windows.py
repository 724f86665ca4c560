"""Caps reach the plan, and texts of a group stay bounded."""

import contextlib
import io

from pyspark.sql import functions as F

from tesselar.operators import enrich, rollup, windows


def explained(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_cap_is_in_the_plan(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    have = spark.createDataFrame([(0, 4)], "k long, id long").withColumn("n", F.explode(F.sequence(F.lit(1), F.col("id")))).select("k", F.col("n").cast("long").alias("id"))
    got = windows.capped(rows, "k", [F.col("id")], have, 10)
    assert "WindowGroupLimit" in explained(got)
    assert {r.k: r["count"] for r in got.groupBy("k").count().collect()} == {0: 6, 1: 10, 2: 10}


def test_corpus_takes_first_and_last(spark):
    rows = spark.range(100).select(F.lit("c").alias("k"), "id", F.concat(F.lit("t"), "id").alias("t"))
    (r,) = rollup.corpus(rows, "k", "id", "t").collect()
    assert r.corpus.split() == [f"t{i}" for i in [*range(10), *range(99, 49, -1)]]
    assert "WindowGroupLimit" in explained(rollup.corpus(rows, "k", "id", "t"))


def test_conversations_count_all_messages(spark):
    rows = spark.range(200).select(F.lit("c").alias("conversation_id"), F.lit("5").alias("contact_id"), F.col("id").alias("position"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("t"), "id")).alias("text"))
    (r,) = enrich.conversation_signals(rows).collect()
    assert r.messages == 200 and len(r.corpus.split()) == 60
    (none,) = enrich.conversation_signals(rows.where("id = 1")).collect()
    assert none.messages == 1 and none.corpus == ""
