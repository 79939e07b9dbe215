"""A stored index of words for Okapi BM25: postings in blocks with maxima, kept up by upserts and deletes.

Postings lie in folders by a hash of their term and are sorted by how much they can score, so that a query
reads the folders of its own terms alone, and of these only the blocks whose best row could still be among
the k best:

1. a term's documents are counted from its blocks' sizes, less the postings of replaced documents;
2. the blocks of highest bound are scored; their kth best sum is a threshold that no better row is below;
3. a block is read if its bound and the other terms' best bounds reach the threshold together. A document
   in a block that is left out cannot reach it, so the k best are exact.

A document's own terms are kept beside (by id), so a replacement knows which postings it takes away.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import text as tx
from tidewell.sources import tables

BUCKETS = 64
BLOCK_ROWS = 128
K1, B = 1.2, 0.75

ENTRY = pa.struct([("id", pa.int64()), ("tf", pa.int64()), ("len", pa.int64())])
POSTINGS = "term string, n long, max_tf long, min_len long, entries array<struct<id:long,tf:long,len:long>>, version int, bucket int"
FORWARD = "id long, version int, len long, terms array<struct<term:string,tf:long>>"
DEAD = "term string, id long, version int, bucket int"
GONE = "id long, before int"


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _forward(docs: DataFrame, version: int) -> DataFrame:
    """id, version, len, terms of documents (id, text); of rows that repeat an id the greatest text."""
    one = docs.filter("id is not null").groupBy(F.col("id").cast("long").alias("id")).agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    words = one.select("id", F.explode_outer(tx.lexical_tokens(F.col("text"))).alias("term"))
    counted = words.groupBy("id", "term").agg(F.count("term").alias("tf"))
    terms = F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "tf")))
    return counted.groupBy("id").agg(F.sum("tf").alias("len"), terms.alias("terms")).select("id", F.lit(version).alias("version"), "len", "terms")


def _blocks(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, term, id, tf, len) in order to blocks of one term, a batch of rows at a time; the last
    block of a batch goes on in the next one."""
    names = ["bucket", "term", "id", "tf", "len"]

    def made(rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        tf, size = (rows.column(c).to_numpy(zero_copy_only=False) for c in (3, 4))
        ends = np.append(starts, rows.num_rows)
        entries = pa.StructArray.from_arrays([c.cast(pa.int64()) for c in rows.columns[2:]], fields=list(ENTRY))
        first = pa.array(starts)
        sums = [pa.array(np.diff(ends)), pa.array(np.maximum.reduceat(tf, starts)), pa.array(np.minimum.reduceat(size, starts))]
        return pa.RecordBatch.from_arrays([rows.column(0).take(first), rows.column(1).take(first), *sums, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)], ["bucket", "term", "n", "max_tf", "min_len", "entries"])

    def starts_of(rows: pa.RecordBatch) -> np.ndarray:
        n = rows.num_rows
        other = [pc.not_equal(rows.column(c).slice(1), rows.column(c).slice(0, n - 1)).to_numpy(zero_copy_only=False) for c in (0, 1)]
        new = np.append(True, other[0] | other[1])
        at = np.arange(n)
        since = at - np.maximum.accumulate(np.where(new, at, 0))
        return np.flatnonzero(since % most == 0)

    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = pa.RecordBatch.from_arrays(batch.columns, names)
        rows = batch if held is None else pa.concat_batches([held, batch])
        starts = starts_of(rows)
        if len(starts) > 1:
            yield made(rows.slice(0, int(starts[-1])), starts[:-1])
        held = rows.slice(int(starts[-1]))
    if held is not None:
        yield made(held, np.array([0]))


def _stage_postings(forward: DataFrame, path: str, version: int) -> str:
    spark = forward.sparkSession
    rows = forward.select("id", "len", F.explode("terms").alias("x")).select(_bucket(F.col("x.term")).alias("bucket"), "x.term", "id", "x.tf", "len")
    # ranges: a term of very many documents is written by several tasks, its best rows first
    order = ["bucket", "term", F.desc("tf"), "len", "id"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    most = BLOCK_ROWS
    blocks = dealt.mapInArrow(lambda b: _blocks(b, most), "bucket int, term string, n long, max_tf long, min_len long, entries array<struct<id:long,tf:long,len:long>>")
    return tables.stage(blocks.withColumn("version", F.lit(version)), path, "postings", "bucket")


def _live(spark: SparkSession, manifest: tables.Manifest) -> DataFrame:
    gone = tables.read(spark, manifest, "gone", GONE).groupBy("id").agg(F.max("before").alias("before"))
    return tables.read(spark, manifest, "forward", FORWARD).join(gone, "id", "left").filter("before is null or version >= before").drop("before")


def _change(spark: SparkSession, path: str, names: DataFrame, docs: DataFrame | None) -> tables.Manifest:
    base = tables.current(spark, path)
    version = base.number + 1
    held = {t: list(base.tables.get(t, [])) for t in ("forward", "postings", "dead", "gone")}
    docs_n, docs_len = base.values.get("docs", 0), base.values.get("len", 0)
    if base.number:
        names = names.select(F.col("id").cast("long").alias("id")).filter("id is not null").distinct()
        old = _live(spark, base).join(names, "id", "left_semi")
        lost = old.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("len")).first()
        docs_n, docs_len = docs_n - lost["n"], docs_len - lost["len"]
        dead = old.select("id", "version", F.explode("terms.term").alias("term")).withColumn("bucket", _bucket(F.col("term")))
        held["dead"].append(tables.stage(dead.repartition("bucket"), path, "dead", "bucket"))
        held["gone"].append(tables.stage(names.withColumn("before", F.lit(version)), path, "gone"))
    if docs is not None:
        segment = tables.stage(_forward(docs, version), path, "forward")
        new = spark.read.schema(FORWARD).parquet(segment)
        more = new.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("len")).first()
        docs_n, docs_len = docs_n + more["n"], docs_len + more["len"]
        held["forward"].append(segment)
        held["postings"].append(_stage_postings(new, path, version))
    return tables.commit(spark, path, base, held, {"docs": docs_n, "len": docs_len})


def upsert(docs: DataFrame, path: str) -> tables.Manifest:
    """Put documents (id, text) into the index under ``path``, in place of those of the same id; the first
    upsert makes it. Null texts have no terms but count as documents; rows without an id are left out."""
    return _change(docs.sparkSession, path, docs, docs)


def delete(names: DataFrame, path: str) -> tables.Manifest:
    """Take the documents of names (id) out; unknown ids do no harm."""
    return _change(names.sparkSession, path, names, None)


def compact(spark: SparkSession, path: str) -> tables.Manifest:
    """Write the live documents as one segment: replaced postings are dropped for good."""
    base = tables.current(spark, path)
    segment = tables.stage(_live(spark, base).withColumn("version", F.lit(base.number + 1)), path, "forward")
    postings = _stage_postings(spark.read.schema(FORWARD).parquet(segment), path, base.number + 1)
    return tables.commit(spark, path, base, {"forward": [segment], "postings": [postings], "dead": [], "gone": []}, base.values)


class Query:
    """A query against an index as it stands: terms, their documents, and their blocks with bounds."""

    def __init__(self, spark: SparkSession, path: str, query: str):
        self.manifest = tables.current(spark, path)
        self.times: dict[str, int] = {}
        for t in spark.range(1).select(tx.lexical_tokens(F.lit(query)).alias("t")).first()["t"]:
            self.times[t] = self.times.get(t, 0) + 1
        terms = spark.createDataFrame([(t,) for t in self.times], "term string").select(_bucket(F.col("term")).alias("b"))
        buckets = sorted({r["b"] for r in terms.collect()})
        mine = F.col("bucket").isin(buckets) & F.col("term").isin(list(self.times))
        self.blocks = tables.read(spark, self.manifest, "postings", POSTINGS).filter(mine)
        self.dead = tables.read(spark, self.manifest, "dead", DEAD).filter(mine).select("term", "id", "version")
        counts = self.blocks.select("term", "n").union(self.dead.select("term", F.lit(-1).cast("long"))).groupBy("term").agg(F.sum("n").alias("df"))
        #: term: documents; one row a term of the query.
        self.df = {r["term"]: r["df"] for r in counts.collect() if r["df"] > 0}
        self.docs = self.manifest.values.get("docs", 0)
        self.mean = self.manifest.values.get("len", 0) / self.docs if self.docs else 0.0

    def score(self, tf: Column, size: Column) -> Column:
        """What a posting adds to its document's score."""
        weight = F.lit(0.0)
        for t, n in self.df.items():
            weight = F.when(F.col("term") == t, F.lit(float(self.times[t])) * F.log(F.lit((self.docs - n + 0.5) / (n + 0.5) + 1))).otherwise(weight)
        return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / (self.mean or 1.0)))

    def postings(self, blocks: DataFrame) -> DataFrame:
        """id, part: scores of the live postings of blocks."""
        rows = blocks.select("term", "version", F.explode("entries").alias("x")).select("term", "version", "x.*")
        live = rows.join(self.dead, ["term", "id", "version"], "left_anti")
        return live.select("id", self.score(F.col("tf"), F.col("len")).alias("part"))

    def needed(self, k: int) -> DataFrame:
        """The blocks that may hold one of the k best documents."""
        bounded = self.blocks.withColumn("bound", self.score(F.col("max_tf"), F.col("min_len")))
        best = {r["term"]: r["most"] for r in bounded.groupBy("term").agg(F.max("bound").alias("most")).collect()}
        # enough of the best blocks for k documents, whatever the number of terms
        first = bounded.orderBy(F.desc("bound"), "term", "min_len").limit(max(4, -(-4 * k // BLOCK_ROWS)) * max(1, len(best)))
        top = self.postings(first).groupBy("id").agg(F.sum("part").alias("s")).orderBy(F.desc("s")).limit(k).agg(F.count("*").alias("n"), F.min("s").alias("least")).first()
        if top["n"] < k:
            return bounded
        others = reduce(lambda a, t: F.when(F.col("term") == t, F.lit(sum(v for u, v in best.items() if u != t))).otherwise(a), best, F.lit(0.0))
        # sums in another order differ in their last digits
        return bounded.filter(F.col("bound") + others >= top["least"] * (1 - 1e-9))


def scores(spark: SparkSession, path: str, query: str) -> DataFrame:
    """(id, score) of all documents with a positive score."""
    asked = Query(spark, path, query)
    return asked.postings(asked.blocks).groupBy("id").agg(F.sum("part").alias("score")).filter("score > 0")


def search(spark: SparkSession, path: str, query: str, k: int = 10) -> DataFrame:
    """(id, score) of the k best documents, ties by id; read from the blocks that can hold them."""
    asked = Query(spark, path, query)
    found = asked.postings(asked.needed(k)).groupBy("id").agg(F.sum("part").alias("score")).filter("score > 0")
    return found.orderBy(F.desc("score"), "id").limit(k)


def rank_all(spark: SparkSession, path: str, queries: dict[int, str], k: int = 10) -> DataFrame:
    """(qid, id, score, rank) of the k best documents of several queries."""
    parts = [search(spark, path, q, k).withColumn("qid", F.lit(i)) for i, q in queries.items()]
    both = reduce(DataFrame.unionByName, parts)
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))).select("qid", "id", "score", "rank")
