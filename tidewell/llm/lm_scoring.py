"""Language-model scores by masked pseudo-likelihood.

A network sees the WINDOW words on both sides of a masked word and predicts the word itself: a hidden
layer over the neighbours' embeddings gives the weights of PARTS distributions over the vocabulary, and
the probability of a word is their mixture, ``p(w | around) = sum_k gate_k(around) * part_k(w)``. The parts
sum to one over all words, so no class stands for a word and nothing is sampled. Gates are trained by
gradient descent, parts by expectation maximisation on the same batches.

The vocabulary grows with the corpus. Words beyond it are one entry of every part, and each has its share
of that entry by its count in the corpus: these counts stay in a Spark table that is joined to the
documents' words. As neighbours such words stand for their first and last letters. The sum of the
conditional log-probabilities of all words of a document is its pseudo-log-likelihood.

The network is trained in numpy by as many trainers at once as the corpus has words for (TRAINER_WORDS each),
however it is cut into partitions, and their weights are averaged by Spark in proportion to the words that
they saw; this is repeated ROUNDS times. Each round takes its
share of the words of every document, and all rounds together each word once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import repeat
from math import isqrt, log

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import settle, shuffle_partitions

#: The vocabulary has the root of the number of all words, within these bounds; rows for rarer neighbours.
LEAST_VOCABULARY, MOST_VOCABULARY, SHAPES = 8192, 64_000, 1024
WINDOW, EMBED, HIDDEN, PARTS = 2, 12, 24, 48
ROUNDS, BATCH, RATE, SEED = 2, 4096, 6.0, 3
#: Words that a trainer has at least, so that averaged weights have all seen enough: partitions with fewer
#: are read by one trainer one after another.
TRAINER_WORDS = 3_000_000
#: Smaller corpora are learnt in smaller steps: so many of them in all, in batches of LEAST_BATCH words or more.
STEPS, LEAST_BATCH, LEAST_RATE = 1000, 128, 0.5
#: Words of the parts' start that the words seen in a round are added to: a share of all, at most so many;
#: smoothing of the parts at its end.
START_SHARE, MOST_START, SMOOTH = 200, 50_000, 1e-3
#: Bytes of words a task holds before it counts them and hands the counts on; bytes of text that are split at
#: once (one longer text is split whole); numbers in a row of weights.
HELD_BYTES, PIECE, ROW = 48 << 20, 1 << 22, 1 << 14
#: The key of a word in the table of counts: Spark's xxhash64 of its bytes.
KEY_SEED = 42


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one text after another, and how many each text has. Words are parted by ASCII
    white space, and only A-Z are lower-cased."""
    bare = pc.ascii_trim_whitespace(pc.ascii_lower(texts))
    lists = pc.ascii_split_whitespace(pc.if_else(pc.equal(bare, ""), None, bare))
    return lists.flatten().cast(pa.binary()), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def split_words(text: str | None) -> list[bytes]:
    return split(pa.array([text], pa.string()))[0].to_pylist()


def pieces(batches: Iterable[pa.RecordBatch], column: int = 0) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray]]:
    """(some rows, their words, how many words each has), about PIECE bytes of text at once."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PIECE, side="right")))
            some = batch.slice(lo, hi - lo)
            yield some, *split(some.column(column))
            lo = hi


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Array] = []
    size = 0

    def out() -> pa.RecordBatch:
        found = pc.value_counts(pa.chunked_array(held, pa.binary()))
        return pa.RecordBatch.from_arrays(found.flatten(), ["word", "n"])

    for _, words, _ in pieces(batches):
        if len(words):
            held.append(words)
            size += words.nbytes
        if size >= HELD_BYTES:
            yield out()
            held.clear()
            size = 0
    if held:
        yield out()


class Words:
    """The vocabulary: places of the known words, ``size`` for the others; as neighbours the others have
    places beyond that by their letters, and the last place is the edge of a text."""

    def __init__(self, words: list[bytes], counts: np.ndarray, rare: float):
        self.size, self.edge = len(words), len(words) + 1 + SHAPES
        self.known = pa.array(words, pa.binary())
        all_ = np.append(counts, rare).astype(float)
        self.share = (all_ / max(1.0, all_.sum())).astype(np.float32)
        self.rare = max(1.0, float(rare))
        self.trainers = max(1, int(all_.sum()) // TRAINER_WORDS)
        self.batch = int(min(BATCH, max(LEAST_BATCH, all_.sum() // STEPS)))
        self.start = float(min(MOST_START, max(500, all_.sum() // START_SHARE)))
        self.rate = max(LEAST_RATE, RATE * self.batch / BATCH)

    @cached_property
    def place(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.known.to_pylist())}

    def ids(self, words: pa.Array | list[bytes]) -> np.ndarray:
        words = pa.array(words, pa.binary()) if isinstance(words, list) else words
        out = pc.index_in(words, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        rare = out < 0
        if rare.any():
            out[rare] = self.size + 1 + shapes(words.filter(pa.array(rare)))
        return out


def shapes(words: pa.Array) -> np.ndarray:
    """A number below SHAPES for the first two and the last three bytes of each word."""
    _, places, data = words.buffers()
    bounds = np.frombuffer(places, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw, first, ends = np.frombuffer(data, np.uint8), bounds[:-1], bounds[1:]
    out = raw[first].astype(np.int64) * 131 + raw[np.minimum(first + 1, ends - 1)]
    for back in (1, 2, 3):
        out = (out * 131 + raw[np.maximum(ends - back, first)]) & 0xFFFFFF
    return (out * 2654435761 >> 16) % SHAPES


def initial(book: Words) -> dict[str, np.ndarray]:
    """Embeddings of all places, a hidden layer, gates; parts near the words' shares, moved at random."""
    rng = np.random.default_rng(SEED)
    p = {
        "embed": rng.normal(0, 0.1, (book.edge + 1, EMBED)),
        "mix": rng.normal(0, 0.2, (2 * WINDOW * EMBED, HIDDEN)),
        "tilt": np.zeros(HIDDEN),
        "gate": rng.normal(0, 0.1, (HIDDEN, PARTS)),
        "bias": np.zeros(PARTS),
        "part": book.share[:, None] * np.exp(rng.normal(0, 0.5, (book.size + 1, PARTS))),
    }
    p["part"] /= np.maximum(p["part"].sum(0), 1e-30)
    return {k: v.astype(np.float32) for k, v in p.items()}


def contexts(ids: np.ndarray, edge: int, sizes: np.ndarray | None = None, at: np.ndarray | slice = slice(None)) -> np.ndarray:
    """(n, 2 * WINDOW): the neighbours of the words ``at`` of one text, or of texts of these sizes, one after
    another; ``edge`` beyond the ends of each text."""
    sizes = np.array([len(ids)]) if sizes is None else sizes
    padded = np.full(len(ids) + WINDOW * (len(sizes) + 1), edge, dtype=np.int64)
    place = np.arange(len(ids)) + WINDOW * np.repeat(np.arange(1, len(sizes) + 1), sizes)
    padded[place] = ids
    around = [d for d in range(-WINDOW, WINDOW + 1) if d]
    return padded[place[at][:, None] + np.array(around)]


def softmax(z: np.ndarray) -> np.ndarray:
    """Softmax of each row, in place. Rows are moved to their largest number only where exp might overflow or
    vanish, and are added up by a product with ones."""
    if z.size and (z.max() > 60 or z.min() < -60):
        z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z /= row_sums(z)
    return z


def row_sums(z: np.ndarray) -> np.ndarray:
    return z @ np.ones((z.shape[1], 1), dtype=z.dtype)


def gates(p: dict[str, np.ndarray], around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of the parts for each context, the hidden layer and its input."""
    x = np.take(p["embed"], around.ravel(), axis=0).reshape(len(around), -1)
    hidden = x @ p["mix"]
    hidden += p["tilt"]
    np.tanh(hidden, out=hidden)
    z = hidden @ p["gate"]
    z += p["bias"]
    return softmax(z), hidden, x


def _sums(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, sums of their rows, how many). Rows have an even number of columns, which are added up in
    pairs, as complex numbers: reduceat's time is by columns and keys."""
    order = np.argsort(keys.astype(np.uint16) if keys.max() < 1 << 16 else keys, kind="stable")
    in_order = keys[order]
    first = np.flatnonzero(np.append(True, in_order[1:] != in_order[:-1]))
    pairs = np.take(rows, order, axis=0).view(np.result_type(rows.dtype, np.complex64))
    return in_order[first], np.add.reduceat(pairs, first).view(rows.dtype), np.diff(np.append(first, len(keys)))


def column_sums(z: np.ndarray) -> np.ndarray:
    return np.ones(len(z), dtype=z.dtype) @ z


def learn(p: dict[str, np.ndarray], counts: np.ndarray, around: np.ndarray, word: np.ndarray, rate: float = RATE) -> None:
    """One step on a batch, in place: down the gradient of the gates, and the parts' share in every word
    added to ``counts``."""
    g, hidden, x = gates(p, around)
    r = g * np.take(p["part"], word, axis=0)
    r /= np.maximum(row_sums(r), 1e-30)
    g -= r
    g /= len(word)
    dh = g @ p["gate"].T
    dh *= 1 - hidden * hidden
    dx = (dh @ p["mix"].T).reshape(-1, EMBED)
    p["gate"] -= rate * (hidden.T @ g)
    p["bias"] -= rate * column_sums(g)
    p["mix"] -= rate * (x.T @ dh)
    p["tilt"] -= rate * column_sums(dh)
    # rare words stand in few rows: their steps are longer by the usual square root
    names, grads, n = _sums(around.ravel(), dx)
    p["embed"][names] -= rate * np.sqrt(around.size / n)[:, None].astype(np.float32) * grads
    names, shares, _ = _sums(word, r)
    counts[names] += shares


def mixed(counts: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Parts from counts: smoothed by the words' shares, each summing to one."""
    part = share[:, None] * np.float32(SMOOTH * max(1e-6, counts.sum()) / PARTS) + counts
    part /= np.maximum(part.sum(0), 1e-30)
    return part.astype(np.float32, copy=False)


def _train(batches: Iterable[pa.RecordBatch], words, start, turn: int = 0, turns: int = 1) -> Iterator[pa.RecordBatch]:
    """Weights after the words of this turn: every turns-th one of each text, from a start that moves on."""
    book, p = words.value, {k: v.copy() for k, v in start.value.items()}
    before = p["part"] * np.float32(book.start / PARTS)
    counts = np.zeros_like(before)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rest = (np.zeros((0, 2 * WINDOW), dtype=np.int64), np.zeros(0, dtype=np.int64))
    size = seen = 0

    def flush(least: int) -> None:
        nonlocal held, rest, size, seen
        ids, sizes = (np.concatenate([h[i] for h in held] or [np.zeros(0, dtype=np.int64)]) for i in (0, 1))
        nth = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.flatnonzero((nth - np.repeat(sizes, sizes) - turn) % turns == 0)
        around = np.concatenate([rest[0], contexts(ids, book.edge, sizes, at)])
        word = np.concatenate([rest[1], np.minimum(ids[at], book.size)])
        step = book.batch
        done = len(word) // step * step if least == step else len(word)
        for lo in range(0, done, step):
            learn(p, counts, around[lo : min(done, lo + step)], word[lo : min(done, lo + step)], book.rate * min(1.0, (done - lo) / step))
        p["part"] = mixed(before + counts, book.share)
        seen += done
        held, rest = [], (around[done:], word[done:])
        size = len(rest[1])

    for _, some, sizes in pieces(batches):
        ids, ends = book.ids(some), np.append(0, np.cumsum(sizes))
        # words of this turn up to each text
        targets = np.append(0, np.cumsum(np.maximum(0, sizes - (sizes + turn) % turns + turns - 1) // turns))
        lo = 0
        while lo < len(sizes):
            full = int(np.searchsorted(targets, targets[lo] + 8 * book.batch - size))
            hi = min(full, len(sizes))
            held.append((ids[ends[lo] : ends[hi]], sizes[lo:hi]))
            size += int(targets[hi] - targets[lo])
            if hi == full:
                flush(book.batch)
            lo = hi
    if size:
        flush(1)
    if seen:
        p["part"] = counts / np.float32(seen)
        # rows of bounded length: Spark adds up each stretch of the weights on its own
        rows = [(k, lo // ROW, seen, v[lo : lo + ROW]) for k, v in ((k, v.ravel().astype(np.float32)) for k, v in p.items()) for lo in range(0, len(v), ROW)]
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["name", "block", "seen", "weights"])


def _average(group: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Weighted means of the stretches of weights that fell to this task, added up one row at a time."""
    total: dict[tuple[str, int], list] = {}
    for pdf in group:
        for name, block, seen, weights in pdf.itertuples(index=False):
            w = np.asarray(weights, dtype=np.float64) * seen
            held = total.setdefault((name, block), [0, np.zeros(len(w))])
            held[0] += seen
            held[1] += w
    if total:
        yield pd.DataFrame([(k, b, s, w / s) for (k, b), (s, w) in total.items()], columns=["name", "block", "seen", "weights"])


def train(docs: DataFrame, book: Words, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Local training by all trainers and averaging, ``rounds`` times. Partitions are joined without moving
    their rows, so no trainer is left with too few words."""
    spark = docs.sparkSession
    p, schema = initial(book), "name string, block int, seen long, weights array<float>"
    words = spark.sparkContext.broadcast(book)
    for turn in range(rounds):
        start = spark.sparkContext.broadcast(p)
        local = docs.select("text").coalesce(book.trainers).mapInArrow(lambda b, s=start, t=turn: _train(b, words, s, t, rounds), schema)
        # each stretch of the weights is averaged by one task; what is collected is one set of weights
        stretches = sum(-(-v.size // ROW) for v in p.values())
        parts = local.repartition(min(stretches, shuffle_partitions(spark)), "name", "block").mapInPandas(_average, schema).collect()
        found: dict[str, list] = {}
        for r in sorted(parts, key=lambda r: (r["name"], r["block"])):
            found.setdefault(r["name"], []).append(np.array(r["weights"], dtype=np.float32))
        p = {k: np.concatenate(found[k]).reshape(v.shape) if k in found else v for k, v in p.items()}
        if found:
            p["part"] = mixed(p["part"], book.share)
        start.unpersist()
    return p


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of all words of all documents."""
    return settle(docs.select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))


def vocabulary(counts: DataFrame) -> Words:
    """The most frequent words. Their number follows the corpus and is bounded, so they can be collected."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    size = min(MOST_VOCABULARY, max(LEAST_VOCABULARY, isqrt(total)))
    top = counts.orderBy(F.desc("n"), "word").limit(size).collect()
    n = np.array([r["n"] for r in top], dtype=float)
    return Words([bytes(r["word"]) for r in top], n, total - n.sum())


def log_likelihood(book: Words, p: dict[str, np.ndarray], ids: list[np.ndarray]) -> np.ndarray:
    """Sum of the conditional log-probabilities of the words of each text (places as ``Words.ids`` gives
    them), a word beyond the vocabulary as one that stands once in the corpus."""
    sizes = np.array([len(i) for i in ids], dtype=np.int64)
    if not sizes.sum():
        return np.zeros(len(ids))
    every = np.concatenate(ids)
    around, word = contexts(every, book.edge, sizes), np.minimum(every, book.size)
    score = np.empty(len(word))
    for lo in range(0, len(word), BATCH):
        s = slice(lo, lo + BATCH)
        g, _, _ = gates(p, around[s])
        g *= np.take(p["part"], word[s], axis=0)
        score[s] = np.log(np.maximum(row_sums(g)[:, 0], 1e-30))
    score[word == book.size] -= log(book.rare)
    return np.bincount(np.repeat(np.arange(len(ids)), sizes), weights=score, minlength=len(ids))


def _score(batches: Iterable[pa.RecordBatch], words, model) -> Iterator[pa.RecordBatch]:
    book, key = words.value, xxhash.xxh64_intdigest
    for some, words_, sizes in pieces(batches, 1):
        ends, ids = np.cumsum(sizes), book.ids(words_)
        total = log_likelihood(book, model.value, np.split(ids, ends[:-1]))
        at = np.flatnonzero(ids > book.size)
        others = words_.take(pa.array(at)).to_numpy(zero_copy_only=False)
        keys = np.fromiter(map(key, others, repeat(KEY_SEED)), dtype=np.uint64, count=len(at)).view(np.int64)
        rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.append(0, ends)), pa.int32()), pa.array(keys))
        yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sizes), pa.array(total), rare], ["doc_id", "n_words", "known", "rare"])


def score_documents(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_words, pll, mean_pll of every row of docs.

    Null and wordless texts have no words, a pll of 0 and a null mean. Texts of any length are read whole.
    Equal texts get equal scores but for rounding. Rows that repeat an id, or have none, are scored each.
    No rows in, no rows out; other columns are not read.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = count_words(slim)
    book = vocabulary(counts)
    model = spark.sparkContext.broadcast(train(slim, book, rounds))
    words = spark.sparkContext.broadcast(book)
    scored = slim.mapInArrow(lambda b: _score(b, words, model), "doc_id long, n_words long, known double, rare array<long>")
    scored = settle(scored.withColumn("row", F.monotonically_increasing_id()))
    # A word that stands once adds log 1 = 0, so only the counts from 2 on are joined. Words of the
    # vocabulary are in no document's list of rare ones.
    twice = counts.filter("n > 1").select(F.xxhash64("word").alias("key"), F.log("n").alias("more"))
    more = scored.select("row", F.explode("rare").alias("key")).join(twice, "key").groupBy("row").agg(F.sum("more").alias("more"))
    whole = scored.select("row", "doc_id", "n_words", "known").join(more, "row", "left")
    pll = F.col("known") + F.coalesce("more", F.lit(0.0))
    return whole.select("doc_id", "n_words", pll.alias("pll"), F.when(F.col("n_words") > 0, pll / F.col("n_words")).alias("mean_pll"))


def op10_masked_pseudo_likelihood(spark, sf_dir: str) -> DataFrame:
    """Pseudo-likelihood scores of all documents."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
