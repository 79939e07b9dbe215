"""Sinks of a stream that hold every batch once, and readers that mark before they handle.

A batch has a number, and after a failure it comes again with the same number and the same rows. So a
batch is written to a folder of its number, which a repeat overwrites; a fan-out keeps, for every sink,
which batches it has taken; an inbox notes a batch as read before its rows are handled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Sink = Callable[[DataFrame, int], None]


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def marked(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def mark(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.create(where, True).close()


def put_batch(out: str) -> Sink:
    """A sink that writes each batch to the folder of its number."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return put


def batches_written(spark: SparkSession, out: str, schema: StructType, last_only: bool = False) -> DataFrame:
    """The rows of all batches, or of the last one alone."""
    if not marked(spark, out):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("basePath", out).parquet(out)
    if last_only:
        rows = rows.filter(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    return rows.select(*schema.fieldNames())


def fan_out(sinks: dict[str, Sink], progress: str, must: set[str] | frozenset[str] = frozenset(), dropped: dict[str, int] | None = None) -> Sink:
    """One sink of several. Each has its own progress under ``progress``: a batch that comes again goes
    only to those that have not taken it. A failing sink of ``must`` fails the batch, which Spark then
    repeats; a batch that any other sink fails to take is lost to it and counted in ``dropped``."""

    def put(batch: DataFrame, number: int) -> None:
        spark, failed = batch.sparkSession, None
        for name, sink in sinks.items():
            place = f"{progress}/{name}/{number}"
            if marked(spark, place):
                continue
            try:
                sink(batch, number)
            except Exception as e:
                if name in must:
                    failed = failed or e
                    continue
                if dropped is not None:
                    dropped[name] = dropped.get(name, 0) + 1
            mark(spark, place)
        if failed is not None:
            raise failed

    return put


def inbox(handle: Sink, read: str) -> Sink:
    """A sink that notes a batch's rows (event_id, ...) as read under ``read`` before it hands them on: a
    handler that fails does not see them again, so each row is handled once at most."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if marked(spark, f"{read}/batch={number}/_SUCCESS"):
            return
        batch.select("event_id").withColumn("read_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{read}/batch={number}")
        handle(batch, number)

    return put
