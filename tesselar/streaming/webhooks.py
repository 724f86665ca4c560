"""Webhook bodies as a stream: an adapter for each source type within one plan, and what can't be read is kept aside.

A file holds a JSON line for each request: source_key, body (the text that came) and received_at. A line that is no such object, and a body for an endpoint that
is unknown or not active, is poison: it goes to the table ``quarantine`` with its reason, in the same commit as the events of its batch, and the stream goes on.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tesselar.functions import keys as K
from tesselar.operators.settle import settled
from tesselar.sources.store import Store
from tesselar.streaming import jobs

REQUEST = "source_key string, body string, received_at timestamp_ntz, _corrupt string"
QUARANTINE = "source_key string, body string, received_at timestamp_ntz, reason string"
#: What an adapter gives: struct(event_id, event_type, occurred_at, payload).
Adapter = Callable[[], Column]


def dug(parsed: Column, path: Column) -> Column:
    """A value at a dotted path of an endpoint's own, as a string; null where there is none."""
    return F.when(K.blank(path).isNotNull(), F.call_function("get_json_object", parsed, F.concat(F.lit("$."), path)))


def passthrough() -> Column:
    """The universal adapter over the columns body, source_key, received_at, event_type, event_id_path and occurred_at_path: a body that is no JSON is wrapped as
    ``_raw``, one that is no object as ``value``; without an id it is a hash of source and body, without a time that of its arrival (S9)."""
    body = F.coalesce("body", F.lit(""))
    parsed = F.when(body == "", F.lit("{}")).otherwise(F.to_json(F.try_parse_json(body)))
    readable = F.coalesce(parsed, F.to_json(F.struct(body.alias("_raw"))))
    data = F.when(readable.startswith("{"), readable).otherwise(F.concat(F.lit('{"value":'), readable, F.lit("}")))
    found = dug(readable, F.col("event_id_path"))
    event_id = F.coalesce(K.blank(found), F.sha2(F.concat_ws(":", "source_key", body), 256))
    at = F.coalesce(dug(readable, F.col("occurred_at_path")).try_cast("timestamp").cast("timestamp_ntz"), F.col("received_at"))
    payload = F.concat(F.lit('{"data":'), data, F.lit("}"))
    return F.struct(event_id.alias("event_id"), F.coalesce(K.blank(F.col("event_type")), F.lit("webhook.received")).alias("event_type"), at.alias("occurred_at"), payload.alias("payload"))


def adapted(requests: DataFrame, endpoints: DataFrame, adapters: dict[str, Adapter] | None = None) -> tuple[DataFrame, DataFrame]:
    """(events without arrival, quarantined rows) of requests. endpoints: source_key, source_type, status, event_type, event_id_path, occurred_at_path. Each row is read by
    the adapter of its endpoint's type, all in one plan; types without one are passed through."""
    known = endpoints.withColumn("_known", F.lit(True)).withColumnRenamed("source_key", "_key")
    rows = requests.join(known, F.col("source_key") == F.col("_key"), "left").drop("_key")
    poison = F.when(F.col("_corrupt").isNotNull() | F.col("source_key").isNull(), "unreadable").when(F.col("_known").isNull(), "unknown endpoint").when(~F.col("status").eqNullSafe("active"), "endpoint disabled")
    rows = rows.withColumn("reason", poison)
    event = reduce(lambda out, a: F.when(F.col("source_type") == a[0], a[1]()).otherwise(out), (adapters or {}).items(), passthrough())
    good = rows.where("reason IS NULL").withColumn("_e", event)
    # an adapter that makes nothing of a body leaves it aside, too
    events = good.where("_e.event_id IS NOT NULL AND _e.event_type IS NOT NULL AND _e.payload IS NOT NULL").select(F.col("source_key").alias("source"), "_e.event_id", "_e.event_type", F.lit("1.0").alias("schema_version"), "_e.occurred_at", "_e.payload", "received_at", "body")
    failed = good.where("_e.event_id IS NULL OR _e.event_type IS NULL OR _e.payload IS NULL").withColumn("reason", F.lit("adapter found no event"))
    aside = rows.where("reason IS NOT NULL").unionByName(failed.drop("_e"))
    return events, aside.select("source_key", F.coalesce("body", "_corrupt").alias("body"), "received_at", "reason")


def numbered(events: DataFrame, number: int) -> DataFrame:
    """Events with arrivals: the batch's number, then their order by time of arrival. Ranges of time are numbered apart and put behind
    one another, so that no task holds the whole batch."""
    order = ["received_at", "source", "event_id", "body"]
    placed = events.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    # the upper bits of that id are the range's place, the lower ones the row's within it
    return placed.withColumn("arrival", F.lit(number).cast("long") * F.lit(1 << 44) + F.shiftright("_at", 33) * F.lit(1 << 28) + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "received_at", "body")


def webhooks(spark: SparkSession, folder: str, store: Store, endpoints: DataFrame, experiences: DataFrame, checkpoint: str, adapters: dict[str, Adapter] | None = None, files: int = 100) -> StreamingQuery:
    """Handle the request files of a folder until there are no more: events go to the gateway, poison to quarantine, by one commit for a batch."""
    stream = spark.readStream.schema(REQUEST).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("maxFilesPerTrigger", files).json(folder)

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        events, aside = adapted(rows, endpoints, adapters)
        # arrivals are part of the result, so they are kept before they are read several times
        jobs.apply(store, settled(numbered(events, number)), experiences, number, more={"quarantine": aside})
        rows.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
