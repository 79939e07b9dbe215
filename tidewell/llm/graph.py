"""Connected components of a link table, without gathering links on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import settle

MOST_ROUNDS = 60


def _lead(pairs: DataFrame) -> DataFrame:
    """(u, m): the smallest neighbour of each node, itself included."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b): the smallest node reachable.

    Alternating large-star and small-star rounds until nothing changes; each round is written to the
    shared folder. Loops and repeated edges do no harm; no edges, no rows; nulls link nothing.
    """
    def stars(e: DataFrame) -> DataFrame:
        return e.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()

    now, seen = settle(stars(edges)), None
    for _ in range(MOST_ROUNDS):
        check = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (check.n, check.h) == seen:
            break
        seen = (check.n, check.h)
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_lead(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(_lead(large), "u").select("u", "v", "m")
        linked = small.select(F.col("v").alias("a"), F.col("m").alias("b")).union(small.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = settle(stars(linked))
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
