"""N-gram Jaccard self-join by T-occurrence search.

A document is the set of its word shingles, as 64-bit hashes. Two sets of similarity t overlap in at
least T = ceil(t * size) shingles of either, so

* equal word sequences form one class and go on as one representative;
* a representative posts only its rarest ``size - T + 1`` shingles: the short lists. Every linked pair
  meets in one. Common shingles, counted over all documents, are posted last or not at all;
* of two linked sets the shortest-hashed shingles of their union are a random sample, at least q of
  which both hold; so they meet in ``least_hits`` short lists or more, except with a chance of e^-30.
  Representatives with fewer occurrences are dropped. With ``exact`` one meeting is enough, and no
  pair is left to chance;
* each representative is first compared with its home, the leader it meets in most short lists;
  most links are found here, one comparison for each document, and give first components;
* a pair inside one component needs no link of its own. Lists that still hold several components
  send their members to their leader's block, and in these blocks (dealt into chunks of bounded size)
  DivideSkip finds every link between components: short lists of a query are heap-merged, candidates
  that reach T - L occurrences are probed in the L long lists by binary search, and those with the
  required overlap are kept.

The order of the shingles decides how much work there is, never the result.

The texts are moved once, compressed, into buckets by document; after that only ids, counts and tokens
are shuffled, and the texts that are compared. The plan is the same at every size.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import release, settle, settle_buckets, shuffle_partitions
from tidewell.llm.graph import components

WORDS = 5
PERCENT = 75
#: A shingle is common if it occurs LOCAL times in a block of BLOCK shingles and COMMON times in all.
#: The MOST_COMMON most frequent are sent to every task; they only order the shingles.
BLOCK, LOCAL, COMMON, MOST_COMMON = 1_000_000, 4, 16, 1 << 17
#: Shingles a chunk of a block holds.
CHUNK = 100_000
#: Bytes of text a bucket holds; postings that a task brings together before it hands them on.
BUCKET_BYTES, POSTINGS = 128 << 20, 1 << 20
#: Parts in which a key that many rows may share is joined.
SALTS = 16
#: Kinds of posting rows: alone in its task, head of a list in its task, member of such a list, size of a set.
ALONE, HEAD, MEMBER, SIZE = range(4)
#: DivideSkip's weight of the merge against the probes.
MU = 0.0085

_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; with fewer words, of the whole sequence."""
    found = (text or "").encode("utf-8").lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), 1)], dtype=np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, found), dtype=np.uint64, count=len(found))
    h = np.zeros(len(w) - words + 1, dtype=np.uint64)
    for i in range(words):
        h = (h ^ w[i : len(w) - words + 1 + i]) * _MIX
        h ^= h >> np.uint64(29)
    return np.unique(h)


def _count_common(batches: Iterable[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def out() -> pa.RecordBatch:
        token, n = np.unique(np.concatenate(held), return_counts=True)
        keep = n >= LOCAL
        return pa.RecordBatch.from_arrays([pa.array(token[keep].view(np.int64)), pa.array(n[keep])], ["token", "n"])

    for batch in batches:
        for text in batch.column(0):
            held.append(shingle_set(text.as_py(), words))
            size += len(held[-1])
            if size >= BLOCK:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def common_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, counts) of the most frequent shingles of all documents."""
    counts = docs.select("text").mapInArrow(lambda b: _count_common(b, words), "token long, n long")
    top = counts.groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON).orderBy(F.desc("n"), "token").limit(MOST_COMMON).toPandas()
    token, n = top["token"].to_numpy(dtype=np.int64).view(np.uint64), top["n"].to_numpy(dtype=np.int64)
    order = np.argsort(token)
    return token[order], n[order]


def least_hits(n: int, rare: int, short: int) -> int:
    """Short lists in which a set of n shingles, ``rare`` of them not common, meets any linked set.

    A linked set may be a quarter smaller, so the first three quarters of the ``short`` posted shingles
    count: m draws without replacement from the rare shingles of the union, of which at most n / 4 for
    every ``rare`` are not shared. Chernoff's bound gives the number that is met except with a chance
    of e^-30. At least one is always met: the prefix bound.
    """
    if rare < short:
        return 1
    m, q = int(0.75 * (short - 1)), 1 - n / (4 * rare)
    least = 1
    while least < m * q:
        x = least / m
        far = x * math.log(x / q) + ((1 - x) * math.log((1 - x) / (1 - q)) if x < 1 else 0)
        if m * far < 30:
            break
        least += 1
    return least


def pack_text(text: str | None) -> bytes | None:
    return zstandard.ZstdCompressor(level=1).compress(text.encode("utf-8")) if text else None


def unpack_text(packed: bytes | None) -> str:
    return zstandard.ZstdDecompressor().decompress(packed).decode("utf-8") if packed else ""


def _named(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with a name of its word sequence (null without words) and its text, compressed."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            some = batch.slice(lo, 512)
            names, packed = [], []
            for text in some.column(1).to_pylist():
                found = (text or "").encode("utf-8").lower().split()
                names.append(xxhash.xxh3_128_digest(b" ".join(found)) if found else None)
                packed.append(pack_text(text) if found else None)
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(names, pa.binary()), pa.array(packed, pa.binary())], ["doc_id", "class", "packed"])


def short_lists(s: np.ndarray, token: np.ndarray, count: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The shingles of a set that are posted, and the number of lists in which any linked set is met."""
    short = len(s) - -(-percent * len(s) // 100) + 1
    at = np.searchsorted(token, s)
    known = token[np.minimum(at, len(token) - 1)] == s if len(token) else np.zeros(len(s), dtype=bool)
    first, last = s[~known][:short], s[known]
    last = last[np.lexsort((last, count[at[known]]))][: short - len(first)] if short > len(first) else last[:0]
    return np.concatenate([first, last]), least_hits(len(s), int((~known).sum()), short)


def _posts(batches: Iterable[pa.RecordBatch], words: int, percent: int, exact: bool, common) -> Iterator[pa.RecordBatch]:
    """Posting rows (token, rep, kind, n, least). What occurs often in the task is brought together: a
    list of two members or more sends its head to the other tasks' and keeps its members apart, so as
    many rows as there are tasks meet under a token, however frequent it is."""
    token, count = common.value
    held: list[tuple[int, np.ndarray]] = []
    size = 0
    names = ["token", "rep", "kind", "n", "least"]

    def out() -> pa.RecordBatch:
        t = np.concatenate([h[1] for h in held])
        r = np.repeat(np.array([h[0] for h in held], dtype=np.int64), [len(h[1]) for h in held])
        order = np.lexsort((r, t))
        t, r = t[order], r[order]
        fresh = np.append(True, t[1:] != t[:-1])
        # rows that share an id may post a token twice
        keep = fresh | np.append(True, r[1:] != r[:-1])
        t, r, fresh = t[keep], r[keep], fresh[keep]
        group = np.cumsum(fresh) - 1
        many = np.bincount(group)[group] > 1
        heads = fresh & many
        t2, r2 = np.concatenate([t, t[heads]]), np.concatenate([r, r[heads]])
        kind = np.concatenate([np.where(many, MEMBER, ALONE), np.full(int(heads.sum()), HEAD)]).astype(np.int8)
        none = pa.nulls(len(t2), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(t2.view(np.int64)), pa.array(r2), pa.array(kind), none, none], names)

    for batch in batches:
        sizes: list[tuple[int, int, int]] = []
        for rep, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            s = shingle_set(unpack_text(packed), words)
            posted, least = short_lists(s, token, count, percent)
            held.append((rep, posted))
            size += len(posted)
            sizes.append((rep, len(s), 1 if exact else least))
            if size >= POSTINGS:
                yield out()
                held, size = [], 0
        rep, n, least = (np.array(c, dtype=np.int64) for c in zip(*sizes, strict=True)) if sizes else (np.zeros(0, np.int64),) * 3
        # a set's size goes where its number sends it
        yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(rep), pa.array(np.full(len(rep), SIZE, np.int8)), pa.array(n.astype(np.int32)), pa.array(least.astype(np.int32))], names)
    if held:
        yield out()


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _compare(batches: Iterable[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Of rows (a, packed, b, b_packed): the pairs whose texts are similar."""
    for batch in batches:
        keep, last, other = [], None, np.zeros(0, dtype=np.uint64)
        for i in range(batch.num_rows):
            if (name := batch.column(2)[i].as_py()) != last:
                last, other = name, shingle_set(unpack_text(batch.column(3)[i].as_py()), words)
            if similar(shingle_set(unpack_text(batch.column(1)[i].as_py()), words), other, percent):
                keep.append(i)
        some = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([some.column(0), some.column(2)], ["a", "b"])


class Lists:
    """Inverted lists of a chunk, searched by DivideSkip."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.lists: dict[int, list[int]] = {}
        for i, s in enumerate(sets):
            for token in s.tolist():
                self.lists.setdefault(token, []).append(i)

    def search(self, query: np.ndarray, percent: int) -> Iterator[int]:
        """Places of the sets that are similar to the query."""
        need = max(1, -(-percent * len(query) // 100))
        lists = sorted((x for t in query.tolist() if (x := self.lists.get(t))), key=len)
        if len(lists) < need:
            return
        n_long = min(need - 1, int(need / (MU * math.log2(len(lists[-1]) + 1) + 1)))
        short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        for i, hits in groupby(heapq.merge(*short)):
            n = sum(1 for _ in hits)
            if n < need - n_long:
                continue
            size = len(query) + len(self.sets[i])
            least = -(-percent * size // (100 + percent))
            for done, x in enumerate(long):
                if n + n_long - done < least:
                    break
                at = bisect_left(x, i)
                n += at < len(x) and x[at] == i
            if 100 * n >= percent * (size - n):
                yield i


def _block_links(rows: pd.DataFrame, words: int, percent: int) -> pd.DataFrame:
    """Links of one chunk pair: from its queries to indexed documents of other components, one for each."""
    index = rows[~rows["query"]]
    lists = Lists([shingle_set(unpack_text(t), words) for t in index["packed"]])
    names, groups = index["rep"].tolist(), index["component"].tolist()
    out = []
    for rep, group, text in rows.loc[rows["query"], ["rep", "component", "packed"]].itertuples(index=False):
        met = {group}
        for i in lists.search(shingle_set(unpack_text(text), words), percent):
            if groups[i] not in met:
                met.add(groups[i])
                out.append((rep, names[i]))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _salted(big: DataFrame, small: DataFrame, key: str, salt: str, how: str = "inner") -> DataFrame:
    """big joined with small, of which each key is one row, in SALTS parts of every key."""
    parts = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).join(parts, [key, "_salt"], how).drop("_salt")


def _met(posts: DataFrame) -> DataFrame:
    """Posting rows without those that stand alone under their token: (token, rep, kind, n, least)."""
    # members meet nobody here, so each has a place of its own; one row of each task meets the others
    posts = posts.withColumn("slot", F.when(F.col("kind") >= MEMBER, F.col("rep")).otherwise(F.lit(0).cast("long")))
    by = Window.partitionBy("token", "slot")
    seen = posts.withColumns({"first": F.min("rep").over(by), "last": F.max("rep").over(by), "most": F.max("kind").over(by)})
    return seen.filter(f"kind <> {HEAD} and (most > {ALONE} or first <> last)").select("token", "rep", "kind", "n", "least")


def link_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included).

    Null and wordless texts have empty sets, link with nothing and are their own component. Rows that
    share an id are one document to the links. Rows with a null id get the component of their equals,
    or null. No rows in, no rows out; other columns are not read. ``exact`` finds candidates by one
    shared short list in place of ``least_hits``: no pair is left to chance, for more comparisons.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # with fewer buckets than shuffle partitions, Spark would deal the texts anew for each join
    buckets = max(shuffle_partitions(spark), -(-total // BUCKET_BYTES))
    common = spark.sparkContext.broadcast(common_shingles(docs, words))
    kinds = "doc_id long, class binary, packed binary"
    texts = settle_buckets(docs.filter("doc_id is not null").mapInArrow(_named, kinds), "doc_id", buckets)
    texts_of = texts.filter("class is not null").select("doc_id", "packed")
    classes = settle(texts.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("rep")))
    whole = texts_of.join(classes.select("rep").distinct().hint("shuffle_hash"), F.col("doc_id") == F.col("rep"), "left_semi")
    posted = whole.mapInArrow(lambda b: _posts(b, words, percent, exact, common), "token long, rep long, kind byte, n int, least int")
    # joins ask for a merge, so that small inputs show the plan of large ones
    every = settle(_met(posted))
    sizes = settle(every.filter(f"kind = {SIZE}").groupBy("rep").agg(F.max("n").alias("n"), F.min("least").alias("least")))
    met = every.filter(f"kind <> {SIZE}").select("token", "rep").repartition("rep")
    hits = met.groupBy("rep").agg(F.count("*").alias("hits"))
    enough = hits.join(sizes.hint("merge"), "rep").filter("hits >= least").select("rep", "n", "least")
    alive = settle(met.join(enough.hint("merge"), "rep"))
    release(every)
    shared = alive.groupBy("token").agg(F.min(F.struct("rep", "n")).alias("lead"), F.max("rep").alias("last")).filter("lead.rep <> last")
    shared = settle(shared.select("token", F.col("lead.rep").alias("lead"), F.col("lead.n").alias("lead_n")))
    columns = ["token", "rep", "n", "least"]
    lists = settle(alive.join(shared.hint("merge"), "token").select(*columns, "lead", "lead_n"))
    release(alive, shared)
    fits = (100 * F.least("n", "lead_n") >= percent * F.greatest("n", "lead_n")) | (F.col("rep") == F.col("lead"))
    votes = lists.filter(fits).groupBy("rep", "lead").agg(F.count("*").alias("votes"), F.max("least").alias("least"))
    votes = votes.filter((F.col("votes") >= F.col("least")) | (F.col("rep") == F.col("lead")))
    homes = votes.groupBy("rep").agg(F.max_by("lead", F.struct("votes", -F.col("lead"))).alias("home"))
    pairs = settle(homes.filter("rep <> home"))
    mine = texts_of.join(pairs.hint("shuffle_hash"), F.col("rep") == F.col("doc_id")).select(F.col("rep").alias("a"), "packed", F.col("home").alias("b"))
    led = pairs.select(F.col("home").alias("b")).distinct()
    theirs = texts_of.join(led.hint("shuffle_hash"), F.col("doc_id") == F.col("b"), "left_semi").select(F.col("doc_id").alias("b"), F.col("packed").alias("b_packed"))
    first = settle(mine.join(theirs.hint("merge"), "b").select("a", "packed", "b", "b_packed").mapInArrow(lambda b: _compare(b, words, percent), "a long, b long"))
    group = settle(components(first))
    # lists that hold several components
    placed = lists.select("token", "rep", "lead").join(group.hint("merge"), F.col("rep") == F.col("node"), "left")
    placed = settle(placed.select("token", "rep", "lead", F.coalesce("component", "rep").alias("component")))
    release(lists)
    mixed = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("token")
    mixed = settle(mixed)
    open_ = settle(placed.join(mixed.hint("merge"), "token").select("rep", "lead", "component"))
    release(placed, mixed)
    asked = open_.groupBy("rep").agg(F.count("*").alias("hits")).join(sizes.hint("merge"), "rep").filter("hits >= least").select("rep", "n")
    visits = open_.groupBy(F.col("lead").alias("block"), "rep").agg(F.max("component").alias("component"))
    visits = settle(visits.join(asked.hint("merge"), "rep"))
    release(open_)
    owner = visits.select("block").distinct().join(group, F.col("node") == F.col("block")).select("block", F.col("component").alias("major"))
    owned = settle(_salted(visits, owner, "block", "rep", "left").withColumn("minor", F.col("component") != F.coalesce("major", "block")).drop("major"))
    parts = lambda c: F.ceil(F.sum(c) / CHUNK).cast("int")
    shape = owned.groupBy("block").agg(parts("n").alias("chunks"), parts(F.when(F.col("minor"), F.col("n"))).alias("query_chunks")).filter("query_chunks > 0")
    dealt = _salted(owned, shape, "block", "rep").withColumns({"j": F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"), "i": F.pmod(F.xxhash64("rep"), F.col("query_chunks")).cast("int")})
    indexed = dealt.select("block", "rep", "component", F.explode(F.sequence(F.lit(0), F.col("query_chunks") - 1)).alias("i"), "j", F.lit(False).alias("query"))
    asked = dealt.filter("minor").select("block", "rep", "component", "i", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("j"), F.lit(True).alias("query"))
    chunks = texts_of.join(indexed.union(asked).hint("shuffle_hash"), F.col("rep") == F.col("doc_id")).drop("doc_id")
    second = chunks.groupBy("block", "i", "j").applyInPandas(lambda pdf: _block_links(pdf, words, percent), "a long, b long")
    final = components(first.union(second))
    named = classes.join(sizes, "rep").join(final, F.col("rep") == F.col("node"), "left")
    named = settle(named.select("class", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id")))
    loose = docs.filter("doc_id is null").mapInArrow(_named, kinds).select("doc_id", "class")
    if (alone := settle(loose)).isEmpty():
        slim = texts.select("doc_id", "class")
    else:
        slim = texts.select("doc_id", "class").union(alone)
        fresh = docs.filter("doc_id is null and text is not null").mapInArrow(_named, kinds).join(classes, "class", "left_anti")
        sets = fresh.mapInArrow(lambda b: _set_sizes(b, words), "class binary, n_shingles long").distinct()
        named = named.union(sets.select("class", "n_shingles", F.lit(None).cast("long").alias("component_id")))
    linked = slim.filter("class is not null").join(named, "class").select("doc_id", "n_shingles", "component_id")
    return linked.union(slim.filter("class is null").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _set_sizes(batches: Iterable[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [len(shingle_set(unpack_text(p), words)) for p in batch.column("packed").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array(n, pa.int64())], ["class", "n_shingles"])


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each group: the one with the smallest id, once. Rows with a null id stay."""
    groups = link_components(docs, words, percent).filter("doc_id = component_id").select("doc_id").distinct()
    named = docs.filter("doc_id is not null").join(groups, "doc_id", "left_semi")
    once = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    return named.withColumn("_nth", F.row_number().over(once)).filter("_nth = 1").select(*docs.columns).union(docs.filter("doc_id is null"))


def op6_t_occurrence_join(spark, sf_dir: str) -> DataFrame:
    """Components of all documents under five-word shingles and a similarity of 0.75 or more."""
    return link_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
