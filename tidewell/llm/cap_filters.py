"""Near-duplicate vectors by spherical-cap filters.

Filter directions are the words of random product codes, one code a table: the space, rotated anew for
each table, is cut into blocks, each with its own small random codebook, and a direction joins one
codeword of every block. A vector is
list-decoded to all directions whose inner product with it exceeds a threshold, without walking the
whole code: block scores are sorted, and a partial sum goes on only while the best rest can still
reach the threshold. Vectors meet under their directions and are compared in double precision there;
a linked pair counts only under the first direction that both share.

Threshold and code grow with the number of vectors so that a direction holds a bounded number of
unrelated ones; the number of tables is what finds RECALL of the pairs at just the cosine at this size.
Longer lists (many near vectors) are dealt into chunks, and pairs of chunks compared.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import count
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import settle
from tidewell.llm.graph import components

COSINE = 0.9
#: Unrelated vectors a direction is meant to hold, and directions of one table a vector is meant to exceed.
LOAD, LISTS = 64, 2
#: Share of the random pairs at just the cosine that the tables together must find, pairs tried, tables at most.
RECALL, TRIED, MOST_TABLES = 0.99, 2000, 32
#: The widest caps, in shares of the sphere. Few vectors, or few dimensions, have these and the tables they need.
WIDEST = 0.1
#: Postings of a task's group; lists beyond CHUNK are dealt into chunks.
GROUP, CHUNK = 4096, 1024
MOST_CODEWORDS, SEED = 1024, 7


class Design(NamedTuple):
    """Thresholds and codes of all tables; without tables all vectors stand under one direction."""

    threshold: float
    blocks: int
    size: int
    tables: int


def cap(share: float, dim: int) -> float:
    """The cosine that this share of all directions exceeds with a given one."""
    angle = np.linspace(0, np.pi, 200_001)
    density = np.sin(angle) ** max(0, dim - 2)
    below = np.cumsum(density)
    return float(np.cos(np.interp(share, below / below[-1], angle)))


def design(n: int, dim: int, cosine: float = COSINE) -> Design:
    """Tables for n vectors: as many as find RECALL of random pairs at just this cosine, which are tried
    here with the codes that the vectors will meet. A random rotation makes any pair a random one, so
    the share holds for all data. Where caps are too narrow for the angle (few dimensions), wider ones; the
    widest have as many tables as it takes. Vectors of one number have no angles but 0 and 180 degrees: they
    are one list, whose pairs of one sign are links all."""
    if dim == 1:
        return Design(0.0, 1, 1, 0)
    rng = np.random.default_rng([11, dim])
    x, z = rng.standard_normal((2, TRIED, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (x * z).sum(1, keepdims=True) * x
    y = cosine * x + np.sqrt(1 - cosine * cosine) * z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300)
    share = min(WIDEST, LOAD / n)
    while True:
        words, blocks = LISTS / share, min(2, dim)
        while words ** (1 / blocks) > MOST_CODEWORDS and blocks < dim:
            blocks += 1
        size, threshold = max(2, round(words ** (1 / blocks))), float(cap(share, dim) * np.sqrt(dim))
        found = np.zeros(TRIED, dtype=bool)
        for table in count() if share >= WIDEST else range(MOST_TABLES):
            rotation, books = codebooks(dim, blocks, size, SEED + table)
            keys = []
            for v in (x, y):
                rows, code = decode(v @ rotation, books, threshold)
                keys.append(rows * size**blocks + code)
            found[np.intersect1d(*keys) // size**blocks] = True
            if found.mean() >= RECALL:
                return Design(threshold, blocks, size, table + 1)
        share = min(WIDEST, share * 4)


@lru_cache(maxsize=64)
def codebooks(dim: int, blocks: int, size: int, seed: int = SEED) -> tuple[np.ndarray, list[np.ndarray]]:
    """A random rotation and the codebook of each block."""
    rng = np.random.default_rng([seed, dim, blocks, size])
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    books = []
    for part in np.array_split(np.arange(dim), min(blocks, dim)):
        c = rng.standard_normal((size, len(part)))
        books.append(c / np.linalg.norm(c, axis=1, keepdims=True) * np.sqrt(len(part)))
    return rotation, books


def decode(x: np.ndarray, books: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, direction) of every direction that a row of x exceeds, rows ascending."""
    edges = np.cumsum([0] + [b.shape[1] for b in books])
    scores = [x[:, lo:hi] @ b.T for lo, hi, b in zip(edges, edges[1:], books, strict=False)]
    rest = np.zeros((len(books) + 1, len(x)))
    for j in range(len(books) - 1, -1, -1):
        rest[j] = rest[j + 1] + scores[j].max(1)
    rows, code, total = np.arange(len(x)), np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
    for j, s in enumerate(scores):
        # in each row's descending scores, the codewords that can still reach the threshold stand first
        order = np.argsort(-s, axis=1, kind="stable")
        sorted_ = np.take_along_axis(s, order, 1)
        need = threshold - total - rest[j + 1][rows]
        width = s.shape[1]
        wide = np.zeros(len(rows), dtype=np.int64)
        for lo in range(0, len(rows), 1 << 15):
            r = slice(lo, lo + (1 << 15))
            wide[r] = (sorted_[rows[r]] >= need[r, None]).sum(1)
        at = np.repeat(np.arange(len(rows)), wide)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(wide) - wide, wide)
        who = rows[at]
        code, total, rows = code[at] * width + order[who, nth], total[at] + sorted_[who, nth], who
    return rows, code


def _decode_batches(batches: Iterable[pa.RecordBatch], designs: dict[int, Design], code_type: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists: list = [None] * batch.num_rows
        raw = [np.array(v, dtype=np.float64) for v in batch.column(1).to_pylist()]
        for dim in {len(v) for v in raw}:
            plan = designs[dim]
            own = [i for i, v in enumerate(raw) if len(v) == dim]
            x = np.stack([raw[i] for i in own])
            # scaled first by the largest component: squares of very large or small ones stay finite
            x /= np.abs(x).max(1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            rows, code = [np.arange(len(own) if not plan.tables else 0)], [np.zeros(len(own) if not plan.tables else 0, dtype=np.int64)]
            for table in range(plan.tables):
                rotation, books = codebooks(dim, plan.blocks, plan.size, SEED + table)
                r, c = decode(x @ rotation, books, plan.threshold)
                rows.append(r)
                code.append(c + table * plan.size**plan.blocks)
            rows, code = np.concatenate(rows), np.concatenate(code)
            order = np.lexsort((code, rows))
            rows, code = rows[order], code[order]
            cuts = np.searchsorted(rows, np.arange(len(own) + 1))
            for k, i in enumerate(own):
                lists[i] = code[cuts[k] : cuts[k + 1]]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), batch.column(1), pa.array(lists, pa.list_(pa.int32() if code_type == "int" else pa.int64()))], ["rep", "weight", "embedding", "directions"]
        )


def _links(x: np.ndarray, names: np.ndarray, lists: list[np.ndarray], direction: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): places of the linked pairs, both ways, whose first shared direction is this one."""
    a, b = np.nonzero(x @ x.T >= cosine)
    keep = names[a] != names[b]
    a, b = a[keep], b[keep]
    some = np.unique(a)
    if not len(some):
        return a, b
    earlier = [lists[i][: np.searchsorted(lists[i], direction)] for i in some]
    words = np.unique(np.concatenate(earlier))
    if len(words):
        held = np.zeros((len(some), len(words)), dtype=np.float32)
        for k, e in enumerate(earlier):
            held[k, np.searchsorted(words, e)] = 1
        shared = held @ held.T
        fresh = shared[np.searchsorted(some, a), np.searchsorted(some, b)] == 0
        a, b = a[fresh], b[fresh]
    return a, b


def _roots(n: int, a: np.ndarray, b: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The smallest name reachable by the links from each of n places."""
    root = names.copy()
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        if (low == root).all():
            return root
        root = low


def _compare(rows: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Per vector of a group: the weight of its links found here, and a root to connect it with."""
    out = []
    for (direction, dim), g in rows.groupby(["direction", "dim"], sort=False):
        if len(g) < 2:
            continue
        names, weight, side = g["rep"].to_numpy(), g["weight"].to_numpy(), g["side"].to_numpy()
        x = np.stack(g["embedding"].to_list()).astype(np.float64)
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        a, b = _links(x, names, g["directions"].to_list(), direction, cosine)
        # of two different chunks only the pairs across are new
        across = (side[a] != side[b]) | (side[a] == 2)
        a, b = a[across], b[across]
        if len(a):
            n = np.zeros(len(g), dtype=np.int64)
            np.add.at(n, a, weight[b])
            some = np.unique(a)
            out.append(pd.DataFrame({"rep": names[some], "n": n[some], "root": _roots(len(g), a, b, names)[some]}))
    return pd.concat(out) if out else pd.DataFrame({"rep": [], "n": [], "root": []}).astype("int64")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, exact: bool = False) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding, ...).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing and are
    their own component; so do vectors with different numbers of components with each other. Equal
    vectors link with each other and go on as one. Rows with a null id are counted as links of others
    through their equals and get their component. No rows in, no rows out; other columns are not read.
    ``exact`` compares all pairs in chunks, for any number of vectors: no link is left to chance.
    """
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.coalesce(F.forall("embedding", fine) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    plus = F.transform("embedding", lambda x: x + F.lit(0.0))  # -0.0 becomes 0.0
    rows = rows.withColumn("good", good).withColumn("embedding", F.when(F.col("good"), plus))
    usable = rows.filter("good")
    classes = usable.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")).filter("rep is not null")
    classes = settle(classes)
    # a row for each number of components
    designs = {r["dim"]: Design(0.0, 1, 1, 0) if exact else design(r["count"], r["dim"], cosine) for r in classes.groupBy(F.size("embedding").alias("dim")).count().collect()}
    # float components and short codes are moved as such: the same numbers in half the bytes
    code = "int" if all(d.tables * d.size**d.blocks < 1 << 31 for d in designs.values()) else "long"
    listed = settle(
        classes.select("rep", F.col("embedding").cast(kind).alias("embedding"), "weight").mapInArrow(
            lambda b: _decode_batches(b, designs, code), f"rep long, weight long, embedding {kind}, directions array<{code}>"
        )
    )
    posts = listed.select("rep", F.size("embedding").alias("dim"), F.explode("directions").alias("direction"))
    counts = posts.groupBy("dim", "direction").agg(F.count("*").alias("held")).filter("held > 1")
    total = counts.agg(F.sum("held")).first()[0] or 0
    groups = max(1, -(-total // GROUP))
    counts = counts.withColumn("chunks", F.ceil(F.col("held") / CHUNK).cast("int"))
    # a long list is a group for each pair of its chunks; short ones share groups
    cell = F.when(F.col("chunks") > 1, -1 - F.pmod(F.xxhash64("dim", "direction"), F.lit(1 << 60))).otherwise(F.pmod(F.xxhash64("dim", "direction"), F.lit(groups)))
    dealt = posts.join(counts, ["dim", "direction"]).withColumns({"cell": cell, "own": F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")})
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    dealt = dealt.select("cell", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "dim", "direction", side.alias("side"), "rep")
    met = dealt.join(listed, "rep").groupBy("cell", "lo", "hi").applyInPandas(lambda pdf: _compare(pdf, cosine), "rep long, n long, root long")
    met = settle(met)
    links = met.groupBy("rep").agg(F.sum("n").alias("n"))
    group = components(met.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = classes.join(links, "rep", "left").join(group, F.col("rep") == F.col("node"), "left")
    named = named.select("embedding", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = usable.join(named, "embedding", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    alone = rows.filter("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op9_spherical_caps(spark, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.9 or more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
