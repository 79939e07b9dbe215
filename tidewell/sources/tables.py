"""Sets of tables that change as one: segments are written first, a manifest that lists them last.

A store is a folder with ``data/<table>/segment=<name>`` and ``manifest/<number>.json``. A writer stages its
segments, claims the next number and puts the manifest in place by renaming it; readers take the largest
manifest and the segments it lists, so they see all of a change or nothing of it, whatever a writer that
died has left behind. Of two writers that start from one manifest the second to claim fails.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Manifest(NamedTuple):
    """number (0 before the first commit), tables {name: segment folders} and a few values besides."""

    number: int
    tables: dict[str, list[str]]
    values: dict


class Conflict(RuntimeError):
    """Another writer has committed since."""


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _numbers(spark: SparkSession, path: str, ending: str) -> list[int]:
    fs, where = _fs(spark, f"{path}/manifest")
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return [int(n.split(".")[0]) for n in names if n.endswith(ending)]


def current(spark: SparkSession, path: str) -> Manifest:
    """What a reader sees now."""
    number = max(_numbers(spark, path, ".json"), default=0)
    if not number:
        return Manifest(0, {}, {})
    said = json.loads(spark.read.text(f"{path}/manifest/{number:08d}.json", wholetext=True).first()[0])
    return Manifest(number, said["tables"], said["values"])


def stage(df: DataFrame, path: str, table: str, partition: str | None = None) -> str:
    """Write a segment that no manifest lists yet; its folder."""
    segment = f"{path}/data/{table}/segment={uuid.uuid4().hex}"
    writer = df.write if partition is None else df.write.partitionBy(partition)
    writer.parquet(segment)
    return segment


def scratch(df: DataFrame, path: str) -> tuple[DataFrame, str]:
    """df as a table of its own that no manifest will list, and its folder, which is removed when the application ends."""
    segment = stage(df, path, "scratch")
    fs, where = _fs(df.sparkSession, segment)
    fs.deleteOnExit(where)
    return df.sparkSession.read.schema(df.schema).parquet(segment), segment


def discard(spark: SparkSession, segment: str) -> None:
    """Remove a scratch table that no later plan reads."""
    fs, where = _fs(spark, segment)
    fs.delete(where, True)


def commit(spark: SparkSession, path: str, base: Manifest, tables: dict[str, list[str]], values: dict | None = None) -> Manifest:
    """Put ``tables`` in place of what ``base`` lists. Raises Conflict if base is not the last any more."""
    number = base.number + 1
    fs, claim = _fs(spark, f"{path}/manifest/{number:08d}.claim")
    if number in _numbers(spark, path, ".json") or max(_numbers(spark, path, ".json"), default=0) != base.number:
        raise Conflict(f"{path} has moved on from manifest {base.number}")
    fs.create(claim, True).close()
    made = Manifest(number, tables, values or {})
    _, staged = _fs(spark, f"{path}/manifest/{number:08d}.{uuid.uuid4().hex}")
    out = fs.create(staged, False)
    out.write(json.dumps({"tables": made.tables, "values": made.values}).encode("utf-8"))
    out.close()
    _, final = _fs(spark, f"{path}/manifest/{number:08d}.json")
    if fs.exists(final) or not fs.rename(staged, final):
        raise Conflict(f"manifest {number} of {path} is taken")
    return made


def read(spark: SparkSession, manifest: Manifest, table: str, schema: str) -> DataFrame:
    """A table of a manifest; without segments no rows."""
    segments = manifest.tables.get(table, [])
    if not segments:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", segments[0].rsplit("/", 1)[0]).parquet(*segments).drop("segment")


def publish(df: DataFrame, path: str, table: str = "rows") -> Manifest:
    """Replace the store's table by df, as one step."""
    spark = df.sparkSession
    base = current(spark, path)
    return commit(spark, path, base, base.tables | {table: [stage(df, path, table)]}, base.values)
