"""Admission by a sliding limit: a call counts only if it was admitted (2.11k).

Whether a call is admitted rests on the calls admitted before it, so a key's calls are decided in order; what is held of a key are the times of
the calls admitted within the window, at most ``limit`` of them. Keys are spread over tasks, and a key's rows stream past its times.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decide(times: deque, at: int, span: int, limit: int) -> bool:
    """Whether a call at ``at`` is admitted; ``times`` are those of earlier ones, and are brought up to date."""
    if limit <= 0:
        return True
    while times and times[0] <= at - span:
        times.popleft()
    if len(times) >= limit:
        return False
    times.append(at)
    return True


def _decided(key: list[str], span: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, times = None, deque()
        for batch in batches:
            out = []
            for *k, at in zip(*[batch.column(c).to_pylist() for c in (*key, "_at")]):
                if k != now:
                    now, times = k, deque()
                out.append(at is not None and decide(times, at, span, limit))
            rest = [c for c in batch.schema.names if c != "_at"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(out, pa.bool_())], [*rest, "admitted"])

    return run


def admitted(calls: DataFrame, key: list[str], at: str, order: list[Column], limit: int, seconds: int) -> DataFrame:
    """``calls`` with ``admitted``: at most ``limit`` admitted calls of a key in any ``seconds`` up to each, those denied left out of the count. A
    call without a time is denied; a limit of 0 or less admits all others. ``order`` tells calls of one time apart."""
    rows = calls.withColumn("_at", F.unix_micros(F.col(at).cast("timestamp")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in calls.schema) + ", admitted boolean"
    return rows.repartition(*key).sortWithinPartitions(*key, "_at", *order).mapInArrow(_decided(key, seconds * 1_000_000, limit), schema)
