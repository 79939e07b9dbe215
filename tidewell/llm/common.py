"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors see. Without one nothing is
    written: a folder of one machine would break on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def _new_place(spark: SparkSession) -> str:
    """A path in the shared folder that is removed when the application ends."""
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def settle(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage is cut, a lost executor
    costs nothing that was written, and the table is removed when the application ends. ``codec``
    compresses its pages, by default the session's."""
    spark = df.sparkSession
    path = _new_place(spark)
    df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    _places[id(out)] = (out, path)
    return out


_places: dict[int, tuple[DataFrame, str]] = {}


def release(*tables: DataFrame) -> None:
    """Remove settled tables that no later plan reads: what was made of them is written."""
    for table in tables:
        _, path = _places.pop(id(table))
        spark = table.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def settle_buckets(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """As settle, dealt into buckets by ``key``: joins on it move the other side alone."""
    spark = df.sparkSession
    name = f"tidewell_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", _new_place(spark)).saveAsTable(name)
    return spark.table(name)


def set_aside(docs: DataFrame, *reads: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with every column that is not read under a name that no operator uses, and a function that gives
    the names back: whatever the input calls its other columns, they clash with none of an operator's own."""
    low = {r.lower() for r in reads} - {c.lower() for c in docs.columns if c in reads}
    named = {f"_aside{i}": c for i, c in enumerate(docs.columns) if c not in reads and c.lower() not in low}
    inner = {c: n for n, c in named.items()}
    return docs.toDF(*[inner.get(c, c) for c in docs.columns]), lambda out: out.toDF(*[named.get(c, c) for c in out.columns])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column) -> Column:
    """True for the rows no model learns from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")
