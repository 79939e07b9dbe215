"""Structured Streaming over event files: windowed counts, sessions, deduplication, drains and breakers."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.metrics import circuit_breaker
from tidewell.session import shared_dir
from tidewell.streaming.delivery import batches_written, put_batch

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """Event files as a stream. A bound on the files of a trigger is the back-pressure; nothing is dropped."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, event_type, n, total) of tumbling windows; rows later than the watermark are left out."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )


def idle_sessions(events: DataFrame, gap: str = "300 seconds", late: str = "1 day") -> DataFrame:
    """(user_id, start, end, n) of sessions that an idle gap ends."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(events: DataFrame) -> DataFrame:
    """Every event id once, however late or far apart its rows come. The ids that were seen are kept as state."""
    return events.dropDuplicates(["event_id"])


class Ordered(NamedTuple):
    """A stream of rows whose result depends on the order of all of them: ``fold`` makes it from the
    drained table, as neither files nor triggers come in that order."""

    rows: DataFrame
    fold: Callable[[DataFrame], DataFrame]


def breaker_states(events: DataFrame, most: int = 5, reset: int = 60) -> Ordered:
    """(user_id, event_id, state): a circuit breaker for each user over a stream (event_type 'error' is a
    failure), in the order of (ts, event_id) whatever the order of arrival. A user's rows are sorted by
    Spark and folded with four values of state."""
    rows = events.select("user_id", "event_id", "ts", (F.col("event_type") == "error").alias("failed"))
    return Ordered(rows, lambda table: circuit_breaker(table, "user_id", "failed", "ts", ["ts", "event_id"], most, reset))


def drain(stream: DataFrame | Ordered, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Run a stream over all that is there now, and read back what it wrote to the shared folder. In
    complete mode the last result counts. ``each`` gets every batch besides, as a fan-out. What depends
    on the order of all rows is folded after the last batch."""
    if isinstance(stream, Ordered):
        return stream.fold(drain(stream.rows, mode, each))
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"

    keep = put_batch(f"{base}/out")

    def put(batch: DataFrame, number: int) -> None:
        if each is not None:
            each(batch, number)
        keep(batch, number)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return batches_written(spark, f"{base}/out", stream.schema, mode == "complete")
