"""Commits of several tables, and merges that rewrite the buckets that a batch touches."""

from pathlib import Path

from pyspark.sql import functions as F

from tesselar.operators import merge
from tesselar.sources.store import Store, bucket_of

SCHEMA = "k long, name string, n long"


def rows(store, table="t"):
    return sorted((tuple(r) for r in store.read(table, SCHEMA).collect()), key=str)


def folders(store, table="t"):
    return dict(store.manifest()["tables"][table])


def files(tmp_path):
    return {str(p) for p in Path(tmp_path).rglob("*.parquet") if not p.is_dir()}


def test_merge_rewrites_only_touched_buckets(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=50)
    first = spark.range(2000).select(F.col("id").alias("k"), F.lit("a").alias("name"), F.col("id").alias("n"))
    b = store.batch(0)
    b.merge("t", SCHEMA, first, ["k"])
    b.commit()
    before, old_files = folders(store), files(tmp_path)
    assert len(before) == 50
    few = spark.createDataFrame([(5, "b", 99), (7, None, 1), (5000, "new", 3)], SCHEMA)
    want = {str(r[0]) for r in few.select(bucket_of(["k"], 50)).collect()}
    b = store.batch(1)
    touched = b.merge("t", SCHEMA, few, ["k"], lambda old, new: merge.upsert(old, new, ["k"], {"name": "set", "n": "max"}))
    assert set(touched) == want
    b.commit()
    after = folders(store)
    assert {k for k in after if after[k] != before.get(k)} == want
    assert len(files(tmp_path) - old_files) <= len(want)
    assert rows(store) == sorted([(k, "b" if k == 5 else "a", 99 if k == 5 else k) for k in range(2000)] + [(5000, "new", 3)], key=str)


def test_crash_before_the_commit_leaves_the_old_tables(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    one, two = spark.createDataFrame([(1, "a", 1), (None, "z", 0)], SCHEMA), spark.createDataFrame([(1, "b", 2), (None, "y", 5), (3, "c", 3)], SCHEMA)
    b = store.batch(0)
    b.merge("t", SCHEMA, one, ["k"])
    b.append("facts", one)
    b.commit()
    state = rows(store), rows(store, "facts")
    b = store.batch(1)
    b.merge("t", SCHEMA, two, ["k"])
    b.append("facts", two)
    # no commit: nothing shows; the batch is run again and shows all
    assert (rows(store), rows(store, "facts")) == state
    b = store.batch(1)
    b.merge("t", SCHEMA, two, ["k"])
    b.append("facts", two)
    b.commit()
    assert rows(store) == sorted([(1, "b", 2), (None, "y", 5), (3, "c", 3)], key=str)
    assert store.read("facts", SCHEMA).count() == 5
    assert store.batch(1) is None and store.batch(0) is None


def test_empty_store_and_empty_batch(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    assert store.manifest() == {"batch": None, "tables": {}} and store.read("t", SCHEMA).count() == 0
    b = store.batch(3)
    assert b.merge("t", SCHEMA, spark.createDataFrame([], SCHEMA), ["k"]) == []
    b.commit()
    assert store.read("t", SCHEMA).count() == 0 and store.batch(2) is None


def test_files_follow_the_batch(spark, tmp_path):
    store, sizes = Store(spark, str(tmp_path / "s"), buckets=64), []
    for n in range(6):
        new = spark.range(n * 1000, n * 1000 + (1000 if n == 0 else 4)).select(F.col("id").alias("k"), F.lit("a").alias("name"), F.col("id").alias("n"))
        before = files(tmp_path)
        b = store.batch(n)
        b.merge("t", SCHEMA, new, ["k"])
        b.append("facts", new.coalesce(1))
        b.commit()
        sizes.append(len(files(tmp_path) - before))
    assert sizes[0] > 60 and max(sizes[1:]) <= 5
    assert store.read("t", SCHEMA).count() == store.read("facts", SCHEMA).count() == 1020
    kept = {f for t in store.manifest()["tables"].values() for f in t.values()}
    assert store.drop_old() > 0
    assert store.read("t", SCHEMA).count() == 1020 and all((tmp_path / "s" / f).exists() for f in kept)
