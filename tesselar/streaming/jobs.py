"""Micro-batch drivers: the batch operators over a file stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tesselar.operators import gateway

from tesselar.sources.store import Batch, Store


def events_of(spark: SparkSession, folder: str, schema: StructType | str, files: int = 100) -> DataFrame:
    """A stream of JSON event files, so many to a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder)


def ingest(stream: DataFrame, store: Store, experiences: DataFrame, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Handle a stream of events (those of ``gateway.handle``) until it has no more (trigger availableNow).

    A batch reads the buckets of its keys, writes all tables that it changes to folders of its own number, and commits them by one
    manifest. A batch that is run again after a failure starts from the same state, and gives the same; one that is committed does nothing. ``on_batch`` gets the answers
    to a batch before it is committed.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        apply(store, rows, experiences, number, on_batch)
        rows.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def apply(store: Store, rows: DataFrame, experiences: DataFrame, number: int, on_batch: Callable[[DataFrame, int], None] | None = None, more: dict[str, DataFrame] | None = None) -> bool:
    """One batch of events over the store; False if it is committed already. ``more`` are rows for further tables, to be committed with it."""
    todo = store.batch(number)
    if todo is None:
        return False
    added = gateway.handle(rows, looking(todo), experiences)
    write(todo, added)
    for table, extra in (more or {}).items():
        todo.append(table, extra)
    if on_batch:
        on_batch(added["answers_to_events"], number)
    todo.commit()
    return True


def replay(store: Store, experiences: DataFrame, number: int, first_arrival: int, chosen: DataFrame | None = None) -> bool:
    """Run failed and conflicting events again, as a batch of its own (2.11i)."""
    todo = store.batch(number)
    if todo is None:
        return False
    write(todo, gateway.replayed(store.read("log", gateway.SCHEMAS["log"]), looking(todo), experiences, first_arrival, chosen))
    todo.commit()
    return True


def looking(todo: Batch) -> gateway.Look:
    """Looks into the buckets of a table that the keys touch."""
    return lambda table, keys, names: todo.stored(table, gateway.SCHEMAS[table], keys, names)


#: What keyed tables are dealt into buckets by: what ``handle`` looks them up by.
BUCKETED = {**gateway.KEYED, "cases": ["source", "event_id"], "edges": ["person"], "company_keys": ["key"]}


def write(todo: Batch, added: dict[str, DataFrame]) -> dict[str, list[str]]:
    """All tables of a batch; the buckets that it rewrote."""
    touched = {}
    for t, keys in gateway.KEYED.items():
        touched[t] = todo.merge(t, gateway.SCHEMAS[t], added[t], BUCKETED[t], lambda old, new, k=keys: gateway.merged(old, new, k))
    for t in gateway.APPENDED:
        todo.append(t, added[t])
    return touched
