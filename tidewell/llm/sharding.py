"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points on a ring of RING cells; a row's key hashes to a cell and belongs
to the first point clockwise. No shard holds more rows than its capacity: keys that meet a full shard
continue clockwise to the next one with room. With ``slack`` 0 the capacities add up to the number of
rows, so counts differ by one at most; a positive slack trades balance for less movement.

The rows never meet in one place. They are counted by cell (RING counters whatever the input), the
walk clockwise is played on those counters, and each row finds its shard from its rank in its cell.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import set_aside, utf8_bytes

RING = 1 << 16


def ring_points(n_shards: int, vnodes: int, seed: str) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, in ring order. Adding a shard leaves the others' points."""
    return sorted(
        (int.from_bytes(hashlib.blake2b(f"{seed}/{s}/{v}".encode(), digest_size=8).digest(), "big") % RING, s)
        for s in range(n_shards)
        for v in range(vnodes)
    )


def capacities(total: int, n_shards: int, slack: float) -> list[int]:
    """Rows a shard may hold. Without slack they sum to the total: the first shards take the remainder."""
    if slack > 0:
        return [math.ceil((1 + slack) * total / n_shards)] * n_shards
    return [total // n_shards + (s < total % n_shards) for s in range(n_shards)]


def walk(counts: dict[int, int], points: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Place the counted cells in ring order; pieces (cell, from rank, to rank, shard, first slot)."""
    at = [c for c, _ in points]
    used, pieces = [0] * len(room), []
    for cell in sorted(counts):
        left, done, i = counts[cell], 0, bisect_left(at, cell)
        for step in range(len(points)):
            shard = points[(i + step) % len(points)][1]
            take = min(left, room[shard] - used[shard])
            if take > 0:
                pieces.append((cell, done, done + take, shard, used[shard]))
                used[shard] += take
                done, left = done + take, left - take
            if not left:
                break
    return pieces


def shard_rows(docs: DataFrame, key: str, n_shards: int, vnodes: int = 128, slack: float = 0.0, seed: str = "ring") -> DataFrame:
    """docs with shard int and slot long (gapless from 0 in each shard).

    Null keys hash like any other value. Rows that repeat a key share a cell and get slots of their
    own; which of two identical rows gets which slot is arbitrary. An empty input gives no rows.
    Columns ``shard`` and ``slot`` of the input are replaced, others come along whatever their names.
    """
    spark = docs.sparkSession
    docs, back = set_aside(docs.drop("shard", "slot"), key)
    h = F.xxhash64(F.lit(seed), F.col(key))
    placed = docs.withColumns({"_h": h, "_cell": F.pmod(h, F.lit(RING)).cast("int")})
    counts = {r["_cell"]: r["n"] for r in placed.groupBy("_cell").agg(F.count("*").alias("n")).collect()}
    pieces = walk(counts, ring_points(n_shards, vnodes, seed), capacities(sum(counts.values()), n_shards, slack))
    plan = spark.createDataFrame(pieces, "_piece_cell int, _from long, _to long, shard int, _slot long")
    rank = F.row_number().over(Window.partitionBy("_cell").orderBy("_h", key)) - F.lit(1)
    # at most RING pieces plus one for each shard boundary: a bound that does not depend on the input
    out = (
        placed.withColumn("_rank", rank)
        .join(F.broadcast(plan), (F.col("_cell") == F.col("_piece_cell")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
        .withColumn("slot", F.col("_slot") + F.col("_rank") - F.col("_from"))
        .drop("_h", "_cell", "_piece_cell", "_from", "_to", "_slot", "_rank")
    )
    return back(out)


def op3_consistent_hash_shards(spark, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 15 under the law ``rows``: counts at most one apart."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    raw = utf8_bytes(F.col("text"))
    slim = docs.select(
        "doc_id",
        (F.octet_length(raw) + F.lit(1)).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
    )
    return shard_rows(slim, "doc_id", 16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
