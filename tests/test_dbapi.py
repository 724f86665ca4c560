"""The database source: ranges, pushed filters, a stream that goes on from its cursor, failing sources."""

import contextlib
import io
import sqlite3

import pytest
from pyspark.sql import functions as F

from tesselar.sources import dbapi

SCHEMA = "id long, kind string, loaded_at string, note string"


@pytest.fixture(scope="module")
def source(spark):
    dbapi.register(spark)
    return spark


def filled(path, rows):
    c = sqlite3.connect(path)
    c.execute('CREATE TABLE IF NOT EXISTS "mes sages" (id INTEGER, kind TEXT, loaded_at TEXT, note TEXT, wide TEXT)')
    c.executemany('INSERT INTO "mes sages" VALUES (?, ?, ?, ?, ?)', rows)
    c.commit()
    c.close()


def some(a, b):
    return [(i, "ab"[i % 2], f"2024-01-01T{i // 60:02d}:{i % 60:02d}", None if i % 5 == 0 else f"n{i}", "x" * 100) for i in range(a, b)]


def load(spark, path, **more):
    return spark.read.format("dbapi").schema(SCHEMA).options(module="sqlite3", connect=f'["{path}"]', table="mes sages", cursor="loaded_at", **more).load()


def explained(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_ranges_and_filters(source, tmp_path):
    path = str(tmp_path / "x.db")
    filled(path, some(0, 200) + [(900, "a", None, "no cursor", "")])
    for ranges in (1, 4, 50):
        df = load(source, path, ranges=ranges)
        assert sorted(r.id for r in df.collect()) == [*range(200), 900]
    assert load(source, path, ranges=4).rdd.getNumPartitions() == 5
    few = load(source, path, ranges=4).where("kind = 'a' AND id >= 100 AND note IS NOT NULL AND length(note) = 4").select("id")
    assert sorted(r.id for r in few.collect()) == [i for i in range(100, 200, 2) if i % 5]
    # what the database can do isn't done again by Spark
    plan = explained(few)
    assert "length(note" in plan and "kind" not in plan.split("Filter")[-1].split("Condition")[-1].split("\n")[0]


def test_filters_as_sql():
    assert dbapi.told(dbapi.EqualTo(("a",), "x")) == ('"a" = ?', ["x"])
    assert dbapi.told(dbapi.In(('a"b',), (1, 2))) == ('"a""b" IN (?, ?)', [1, 2])
    assert dbapi.told(dbapi.EqualTo(("a", "b"), 1)) is None and dbapi.told(dbapi.EqualTo(("a",), True)) is None


def test_stream_goes_on_from_its_cursor(source, tmp_path):
    path, seen = str(tmp_path / "x.db"), []

    def run():
        stream = source.readStream.format("dbapi").schema(SCHEMA).options(module="sqlite3", connect=f'["{path}"]', table="mes sages", cursor="loaded_at").load()
        q = stream.writeStream.foreachBatch(lambda df, n: seen.append(sorted(r.id for r in df.collect()))).option("checkpointLocation", str(tmp_path / "state")).start()
        q.processAllAvailable()
        q.stop()

    filled(path, some(0, 50))
    run()
    filled(path, some(50, 55))
    run()
    run()
    assert [s for s in seen if s] == [list(range(50)), list(range(50, 55))]


def test_a_failed_source_leaves_the_others(source, tmp_path):
    path = str(tmp_path / "x.db")
    filled(path, some(0, 10))
    got = {}
    sources = {"first": lambda s: load(s, path).where("id < 3"), "gone": lambda s: load(s, str(tmp_path / "none" / "x.db")), "last": lambda s: load(s, path).select(F.max("id").alias("id"))}
    failed = dbapi.read_all(source, sources, lambda name, df: got.update({name: [r.id for r in df.collect()]}))
    assert got == {"first": [0, 1, 2], "last": [9]} and list(failed) == ["gone"] and 0 < len(failed["gone"]) <= 1000
