"""Stateful streams against the batch operators, over any cut into batches, with restarts from the checkpoint."""

import json
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from tesselar.operators import admission, facts
from tesselar.streaming import state

EVENT = "source string, experience_key string, experience_version string, run_id string, arrival long, occurred_at timestamp_ntz, action string, person_id long, data string"


def cut_into(folder, rows, sizes):
    """Files of rows, as one batch each; gives a function that writes the next file."""
    folder.mkdir()
    at, parts = 0, []
    for n in sizes:
        parts.append(rows[at : at + n])
        at += n
    assert at >= len(rows)
    return [lambda i=i, p=p: (folder / f"{i:03d}.json").write_text("\n".join(json.dumps(r) for r in p)) for i, p in enumerate(parts)]


def drained(stream, mode, checkpoint, on_batch):
    q = stream.writeStream.outputMode(mode).foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def run_events(n, seed):
    r = random.Random(seed)
    kinds = ["run_started", "answer_recorded", "answer_recorded", "identity_captured", "run_completed", "other"]
    out = []
    for i in range(n):
        data = {"question_key": f"q{r.randrange(3)}"} | ({"score": r.randrange(100)} if r.random() < 0.5 else {})
        out.append({"source": "s", "experience_key": "form", "experience_version": "1", "run_id": f"r{r.randrange(40)}", "arrival": i, "occurred_at": f"2024-01-01T00:{i // 60:02d}:{r.randrange(60):02d}", "action": r.choice(kinds), "person_id": r.choice([None, i]), "data": json.dumps(data)})
    return out


@pytest.mark.parametrize("sizes", [[200], [1, 60, 3, 100, 36]])
def test_runs_equal_the_batch(spark, tmp_path, sizes):
    state.with_rocks(spark)
    rows = run_events(200, 2)
    folder, got = tmp_path / "in", {}
    for write in cut_into(folder, rows, sizes):
        # each batch is a new query that starts from the checkpoint
        write()
        stream = spark.readStream.schema(EVENT).json(str(folder))
        drained(state.runs(stream), "update", str(tmp_path / "state"), lambda df, _: got.update({r.run_id: r for r in df.collect()}))
    batch = spark.read.schema(EVENT).json(str(folder)).withColumn("error", F.lit(None).cast("string"))
    want = facts.runs(batch).select(*[c.split()[0] for c in state.RUN_OUT.split(", ")]).collect()
    assert sorted(map(tuple, got.values())) == sorted(map(tuple, want)) and {r.status for r in want} == {"started", "completed"}


def test_idle_runs_end(spark, tmp_path):
    state.with_rocks(spark)
    event = lambda i, run, minute, action, data="{}": {"source": "s", "experience_key": "form", "experience_version": "1", "run_id": run, "arrival": i, "occurred_at": f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:00", "action": action, "person_id": None, "data": data}
    q = '{"question_key":"q"}'
    parts = [[event(0, "a", 0, "run_started"), event(1, "a", 1, "answer_recorded", q), event(2, "a", 2, "answer_recorded", q), event(3, "b", 50, "run_started")], [event(4, "b", 100, "answer_recorded", q)], [event(5, "c", 300, "run_started")]]
    folder, told = tmp_path / "in", []
    for write in cut_into(folder, [e for p in parts for e in p], [4, 1, 1]):
        write()
        stream = spark.readStream.schema(EVENT).json(str(folder)).withColumn("event_time", F.col("occurred_at").cast("timestamp")).withWatermark("event_time", "0 seconds")
        drained(state.runs(stream, idle=3600), "update", str(tmp_path / "state"), lambda df, _: told.extend((r.run_id, r.status, r.answers) for r in df.collect()))
    # a ends an hour after its last event, once; b goes on at minute 100 and ends after minute 160
    assert [t for t in told if t[1] == "abandoned"] == [("a", "abandoned", 1), ("b", "abandoned", 1)]
    assert ("c", "started", 0) in told


def by_hand(calls, limit, span):
    """The rule as a list of admitted times that is filtered for every call."""
    windows, out = {}, {}
    for key, call, at in sorted(calls, key=lambda c: (c[2], c[1])):
        window = windows[key] = [t for t in windows.get(key, []) if t > at - span]
        out[key, call] = limit <= 0 or len(window) < limit
        if out[key, call] and limit > 0:
            window.append(at)
    return out


@pytest.mark.parametrize("limit", [0, 1, 4])
def test_admission(spark, limit):
    r = random.Random(limit)
    calls = [(r.choice("aaaaaab"), f"{i:04d}", i // 3) for i in range(600)]
    df = spark.createDataFrame(calls, "key string, call string, second long").withColumn("at", F.timestamp_seconds("second")).repartition(5)
    got = admission.admitted(df, ["key"], "at", [F.col("call")], limit, 10).collect()
    assert {(x.key, x.call): x.admitted for x in got} == by_hand(calls, limit, 10) and len(got) == 600
    # what is held of a key is bounded by the limit
    times = deque()
    assert max(len(times) for i in range(500) if admission.decide(times, i, 1000, 4) or True) <= 4


def test_admission_stream(spark, tmp_path):
    state.with_rocks(spark)
    r = random.Random(1)
    calls = [(r.choice("aab"), f"{i:04d}", i // 4) for i in range(300)]
    rows = [{"key": k, "call": c, "at": f"2024-01-01T00:{s // 60:02d}:{s % 60:02d}"} for k, c, s in calls]
    got = {}
    for write in cut_into(tmp_path / "in", rows, [80, 4, 100, 116]):
        write()
        stream = spark.readStream.schema("key string, call string, at timestamp_ntz").json(str(tmp_path / "in"))
        drained(state.admitted(stream, 3, 20), "append", str(tmp_path / "state"), lambda df, _: got.update({(x.key, x.call): x.admitted for x in df.collect()}))
    assert got == by_hand(calls, 3, 20) and set(got.values()) == {True, False}


def test_late_rows_come_once_and_state_goes(spark, tmp_path):
    """Rows of the overlap come again and are dropped; a late one that is new within the overlap comes; state follows the overlap, not the history."""
    state.with_rocks(spark)
    row = lambda k, hour: {"k": k, "loaded_at": f"2024-01-{1 + hour // 24:02d}T{hour % 24:02d}:00:00"}
    batches, seen = [], []
    for n in range(12):
        # each read goes back by three hours and finds one late row
        batches.append([row(f"k{h}", h) for h in range(max(0, 4 * n - 3), 4 * n + 4)] + ([row(f"late{n}", 4 * n - 2)] if n else []))
    totals = []
    for write in cut_into(tmp_path / "in", [r for b in batches for r in b], [len(b) for b in batches]):
        write()
        stream = spark.readStream.schema("k string, loaded_at timestamp").json(str(tmp_path / "in"))
        q = drained(state.first_arrivals(stream, ["k"], "loaded_at", 3), "append", str(tmp_path / "state"), lambda df, _: seen.extend(r.k for r in df.collect()))
        totals.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert sorted(seen) == sorted({r["k"] for b in batches for r in b})
    assert max(totals) <= 20 and totals[-1] < len(seen) / 2


def test_windows_of_a_stream_equal_the_batch(spark, tmp_path):
    r = random.Random(3)
    rows = [{"source": r.choice("ab"), "status": r.choice(["processed", "processed", "failed", "conflict"]), "at": f"2024-01-{1 + i // 40:02d}T{i % 40 // 2:02d}:{r.randrange(60):02d}:00"} for i in range(200)]
    rows.append({"source": "z", "status": "processed", "at": "2024-03-01T00:00:00"})
    folder, got, ended = tmp_path / "in", [], []
    for write in cut_into(folder, rows, [50, 50, 101]):
        write()
        stream = spark.readStream.schema("source string, status string, at timestamp").json(str(folder))
        drained(state.source_health(stream, "at", "24 hours", "6 hours"), "append", str(tmp_path / "state"), lambda df, _: got.extend(map(tuple, df.collect())))
        drained(state.sessions(stream, "source", "at", "5 hours"), "append", str(tmp_path / "sessions"), lambda df, _: ended.extend(map(tuple, df.collect())))
    batch = spark.read.schema("source string, status string, at timestamp").json(str(folder))
    done = lambda df: sorted(tuple(x) for x in df.collect() if x.source != "z")
    assert sorted(got) == done(state.source_health(batch, "at", "24 hours", "6 hours"))
    assert sorted(ended) == done(state.sessions(batch, "source", "at", "5 hours"))


def test_events_with_outcomes(spark, tmp_path):
    r = random.Random(4)
    at = lambda s: f"2024-01-01T{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}"
    events = [{"event_id": i, "at": at(20 * i)} for i in range(150)]
    outcomes = [{"event_id": i, "told_at": at(20 * i + r.randrange(200)), "status": "ok"} for i in range(150) if i % 7]
    left, right, got = tmp_path / "e", tmp_path / "o", []
    for a, b in zip(cut_into(left, events, [50, 50, 50]), cut_into(right, outcomes, [50, 50, 50])):
        a(), b()
        e, o = spark.readStream.schema("event_id long, at timestamp").json(str(left)), spark.readStream.schema("event_id long, told_at timestamp, status string").json(str(right))
        drained(state.with_outcomes(e, o, 120, "10 minutes"), "append", str(tmp_path / "state"), lambda df, _: got.extend(map(tuple, df.collect())))
    batch = state.with_outcomes(spark.read.schema("event_id long, at timestamp").json(str(left)), spark.read.schema("event_id long, told_at timestamp, status string").json(str(right)), 120)
    want = sorted(map(tuple, batch.collect()))
    assert sorted(got) == want and 0 < len(want) < len(outcomes)
