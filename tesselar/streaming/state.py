"""Operators that keep state between micro-batches, one value or list for each key, in the RocksDB state store."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tesselar.operators import admission, facts

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocks(spark: SparkSession) -> SparkSession:
    """The store that state with several variables needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return spark


#: Times are microseconds; each value stands beside the arrival that told it, so that batches may come in any order.
RUN_STATE = "started_at long, started_in long, last_at long, last_in long, completed_at long, completed_in long, person long, person_in long, score double, score_in long, answers long"
RUN_OUT = "source string, experience_key string, experience_version string, run_id string, status string, started_at timestamp_ntz, last_activity_at timestamp_ntz, completed_at timestamp_ntz, person_id long, answers long, score double"
_FIELDS = [f.split()[0] for f in RUN_STATE.split(", ")]


class Run(StatefulProcessor):
    """An experience run (2.11j, R20): its value grows with every event. With ``idle`` seconds it is also given
    up, and its state dropped, when event time has passed its last activity by so much."""

    def __init__(self, idle: int | None = None):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", RUN_STATE)
        self.asked = handle.getListState("asked", "question_key string")

    def _told(self, s: dict, name: str, value: object, arrival: int, first: bool) -> None:
        known = s[f"{name}_in"]
        if known is None or (arrival < known if first else arrival > known):
            s[f"{name}_at" if name in ("started", "last", "completed") else name], s[f"{name}_in"] = value, arrival

    def _out(self, key: tuple, s: dict, status: str) -> pd.DataFrame:
        at = lambda c: pd.NaT if s[c] is None else pd.Timestamp(s[c], unit="us")
        times = {c: pd.Series([at(k)], dtype="datetime64[us]") for c, k in (("started_at", "started_at"), ("last_activity_at", "last_at"), ("completed_at", "completed_at"))}
        numbers = {"person_id": pd.array([s["person"]], dtype="Int64"), "answers": [s["answers"]], "score": [s["score"]]}
        return pd.DataFrame({**dict(zip(facts.RUN, [[k] for k in key])), "status": [status], **times, **numbers})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = dict(zip(_FIELDS, self.run.get())) if self.run.exists() else dict.fromkeys(_FIELDS)
        s["answers"] = s["answers"] or 0
        for part in rows:
            for arrival, at, action, person, question, score in zip(*[part[c].tolist() for c in ("arrival", "at", "action", "person_id", "question_key", "score")]):
                self._told(s, "started", at, arrival, True)
                self._told(s, "last", at, arrival, False)
                if action == "answer_recorded":
                    s["answers"] += 1
                    self.asked.appendValue((question,))
                if action == "identity_captured" and not pd.isna(person):
                    self._told(s, "person", int(person), arrival, True)
                if action == "run_completed":
                    self._told(s, "completed", at, arrival, False)
                    if not pd.isna(score):
                        self._told(s, "score", float(score), arrival, False)
        self.run.update(tuple(s[f] for f in _FIELDS))
        if self.idle is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
            self.handle.registerTimer(s["last_at"] // 1000 + self.idle * 1000)
        yield self._out(key, s, "started" if s["completed_in"] is None else "completed")

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = dict(zip(_FIELDS, self.run.get()))
        questions = {q for (q,) in self.asked.get()}
        # an abandoned run tells how many questions it got to, each once
        s["answers"] = len(questions)
        self.run.clear()
        self.asked.clear()
        yield self._out(key, s, "abandoned" if s["completed_in"] is None else "completed")

    def close(self) -> None:
        pass


def runs(valid: DataFrame, idle: int | None = None) -> DataFrame:
    """A stream of the runs that a batch touched, as they are after it: the last row of a run is what ``facts.runs`` gives for all its events. valid:
    a stream of experience events (columns of RUN, arrival, occurred_at, action, person_id as long, data). With ``idle``, event time is that of the stream's watermark on
    a column ``event_time``, and a row with status ``abandoned`` (or ``completed``) ends a run."""
    get = lambda path: F.get_json_object("data", f"$.{path}")
    rows = valid.select(
        *facts.RUN, "arrival", F.unix_micros(F.col("occurred_at").cast("timestamp")).alias("at"), "action", F.col("person_id").cast("long").alias("person_id"), get("question_key").alias("question_key"),
        get("score").try_cast("double").alias("score"), *(["event_time"] if idle is not None else []),
    )
    return rows.groupBy(*facts.RUN).transformWithStateInPandas(Run(idle), RUN_OUT, "Update", "None" if idle is None else "EventTime")


class Limiter(StatefulProcessor):
    """Admission by a sliding limit: the times of the calls admitted within the window, at most ``limit`` of them."""

    def __init__(self, limit: int, seconds: int):
        self.limit, self.span = limit, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("times", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = deque(t for (t,) in self.times.get()) if self.times.exists() else deque()
        calls = sorted((at, call) for part in rows for at, call in zip(part["at"].tolist(), part["call"].tolist()))
        told = [admission.decide(times, at, self.span, self.limit) for at, _ in calls]
        self.times.put([(t,) for t in times])
        yield pd.DataFrame({"key": [key[0]] * len(calls), "call": [c for _, c in calls], "admitted": told})

    def close(self) -> None:
        pass


def admitted(calls: DataFrame, limit: int, seconds: int) -> DataFrame:
    """A stream of (key, call, admitted) for calls (key, call as string, at): as ``admission.admitted`` decides, if batches come in order of time."""
    rows = calls.select("key", "call", F.unix_micros(F.col("at").cast("timestamp")).alias("at"))
    return rows.groupBy("key").transformWithStateInPandas(Limiter(limit, seconds), "key string, call string, admitted boolean", "Append", "None")


def first_arrivals(stream: DataFrame, keys: list[str], loaded_at: str, overlap_hours: float) -> DataFrame:
    """A stream without rows whose key came before, within the overlap (2.11e, S2, W6). A source is read again from its cursor less the overlap, so
    rows come again, late by as much; older ones are dropped, and the state of a key goes when it is out of the overlap."""
    late = f"{int(overlap_hours * 3600)} seconds"
    return stream.withWatermark(loaded_at, late).dropDuplicatesWithinWatermark(keys)


def source_health(events: DataFrame, at: str, window: str = "24 hours", slide: str = "1 hour", lateness: str = "3 hours") -> DataFrame:
    """Events and failures of each source in sliding windows (A11, 2.11): a window's row comes once, when event time has passed its end by the lateness. Works
    on a stream in append mode and on a batch."""
    rows = events.withWatermark(at, lateness) if events.isStreaming else events
    counts = rows.groupBy("source", F.window(at, window, slide).alias("w")).agg(F.count(F.lit(1)).alias("received"), F.count_if(F.col("status").isin("failed", "conflict")).alias("failed"), F.max(at).alias("last_at"))
    return counts.select("source", F.col("w.start").alias("from_at"), F.col("w.end").alias("to_at"), "received", "failed", "last_at")


def sessions(events: DataFrame, key: str, at: str, gap: str, lateness: str = "3 hours") -> DataFrame:
    """Sessions of a key: events with less than ``gap`` from one to the next."""
    rows = events.withWatermark(at, lateness) if events.isStreaming else events
    counts = rows.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return counts.select(key, F.col("w.start").alias("from_at"), F.col("w.end").alias("to_at"), "events")


def with_outcomes(events: DataFrame, outcomes: DataFrame, seconds: int, lateness: str = "3 hours") -> DataFrame:
    """Events (event_id, at, ...) with the outcomes (event_id, told_at, ...) that came within so many seconds of them; both may be streams, whose state goes when
    neither side can match any more."""
    e, o = events, outcomes.withColumnRenamed("event_id", "of_event")
    if e.isStreaming:
        e, o = e.withWatermark("at", lateness), o.withWatermark("told_at", lateness)
    near = (F.col("event_id") == F.col("of_event")) & (F.col("told_at") >= F.col("at")) & (F.col("told_at") <= F.col("at") + F.make_dt_interval(secs=F.lit(seconds)))
    return e.join(o, near).drop("of_event")
