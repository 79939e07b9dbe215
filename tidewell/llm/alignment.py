"""Alignment of the tokens of two tokenizers through a dictionary of groups.

Where a token of A and a token of B end at the same byte, both cut a text into groups; inside a group the
tokens that overlap are linked. Groups repeat, so their kinds are interned: a kind is its A ids and B ids.

1. Each document becomes its kinds with frequencies (Arrow; units are aligned once and remembered).
2. Kinds are counted over all documents, and each is expanded to links once.
3. How many documents hold a pair of ids linked is the sum, over the kinds that hold it, of their
   documents, less the repeats of documents that hold the pair in several kinds. Each document
   finds its own repeats, so no document meets another.
4. Links meet the pair counts, each kind gets its sums, and documents get theirs by the kind's key.

A kind in very many documents would be one hot key: kinds (and pairs) that make up at least a 65,536th of
the rows to be joined are broadcast, of which there can be 65,536, and no other key has more rows than that.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import settle
from tidewell.llm.token_units import LONG, MEMORY, PLAIN, UNIT, byte_level, pieces, tokenizer_path

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A key of at least this share of all rows is hot; there are at most as many of them.
HOT_SHARE = 65_536
CHUNK = 256
#: Units that are encoded in one call.
JOINED = 4096


class Alignment(NamedTuple):
    """documents: row, doc_id, n_a, n_b, n_groups, groups_sha256, kinds array<struct<kind, n>>, repeats.
    kinds: kind, docs, occurrences. links: kind, docs, a, b, n. pairs: a, b, count, best."""

    documents: DataFrame
    kinds: DataFrame
    links: DataFrame
    pairs: DataFrame


def cut_groups(a: list[int], b: list[int], raw_a: dict[int, bytes], raw_b: dict[int, bytes]) -> list[str]:
    """Kinds of the groups of two token lists over the same bytes, in order: 'a1,a2|b1'."""
    out, i, j = [], 0, 0
    while i < len(a):
        at_a, at_b = len(raw_a[a[i]]), len(raw_b[b[j]])
        first_i, first_j = i, j
        i, j = i + 1, j + 1
        while at_a != at_b:
            if at_a < at_b:
                at_a += len(raw_a[a[i]])
                i += 1
            else:
                at_b += len(raw_b[b[j]])
                j += 1
        out.append(f"{','.join(map(str, a[first_i:i]))}|{','.join(map(str, b[first_j:j]))}")
    return out


def expand(kind: str, raw_a: dict[int, bytes], raw_b: dict[int, bytes]) -> Counter:
    """(a, b): how many token occurrences of the kind overlap so."""
    a, b = (list(map(int, side.split(","))) for side in kind.split("|"))
    out: Counter = Counter()
    i = j = 0
    end_a, end_b = len(raw_a[a[0]]), len(raw_b[b[0]])
    while True:
        out[a[i], b[j]] += 1
        if end_a == end_b:
            return out
        # inside a group the ends meet at its own end alone
        if end_a < end_b:
            i += 1
            end_a += len(raw_a[a[i]])
        else:
            j += 1
            end_b += len(raw_b[b[j]])


class Aligner:
    """Kinds of texts; units and kinds are remembered up to a bound."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = byte_level(path_a), pieces(path_b)
        self.bytes_a, self.bytes_b = (np.array([len(t.raw.get(i, b"")) for i in range(max(t.raw, default=0) + 1)]) for t in (self.a, self.b))
        #: Unit: its kinds in order, joined, and how many tokens of A and of B it has; None: not given back.
        self.units: dict[str, tuple[str, int, int] | None] = {}
        self.linked: dict[str, list] = {}

    def _learn_each(self, units: list[str], whole: bool) -> None:
        ids_b = [self.b.whole(u[1:]) for u in units] if whole else self.b(units)
        raw_a, raw_b = self.a.raw, self.b.raw
        for unit, a, b in zip(units, self.a(units), ids_b, strict=True):
            said = unit.encode("utf-8")
            fits = b"".join([raw_a.get(i, b"") for i in a]) == said and b"".join([raw_b.get(i, b"") for i in b]) == said
            self.units[unit] = (";".join(cut_groups(a, b, raw_a, raw_b)), len(a), len(b)) if fits else None

    def _learn_joined(self, units: list[str]) -> bool:
        """Units that stand beside each other as they do in a text, in one call of either tokenizer."""
        text = "".join(units)
        said = text.encode("utf-8")
        a, b = self.a.merger.encode_ordinary(text), self.b([text])[0]
        if b"".join(map(self.a.raw.__getitem__, a)) != said or b"".join([self.b.raw.get(i, b"") for i in b]) != said:
            return False
        ends_a, ends_b = np.cumsum(self.bytes_a[a]), np.cumsum(self.bytes_b[b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        to_a, to_b = np.searchsorted(ends_a, cuts) + 1, np.searchsorted(ends_b, cuts) + 1
        say_a, say_b = list(map(str, a)), list(map(str, b))
        kinds, i, j = [], 0, 0
        for i2, j2 in zip(to_a.tolist(), to_b.tolist(), strict=True):
            if i2 - i == 1 and j2 - j == 1:
                kinds.append(f"{say_a[i]}|{say_b[j]}")
            else:
                kinds.append(f"{','.join(say_a[i:i2])}|{','.join(say_b[j:j2])}")
            i, j = i2, j2
        unit_ends = np.cumsum(np.fromiter((len(u.encode("utf-8")) for u in units), np.int64, len(units)))
        group = np.searchsorted(cuts, unit_ends)
        if not np.array_equal(cuts[group], unit_ends):
            return False
        n_a, n_b = np.diff(to_a[group], prepend=0).tolist(), np.diff(to_b[group], prepend=0).tolist()
        lo = 0
        for unit, hi, x, y in zip(units, (group + 1).tolist(), n_a, n_b, strict=True):
            self.units[unit] = (";".join(kinds[lo:hi]), x, y)
            lo = hi
        return True

    def _learn(self, units: list[str]) -> None:
        if not self.b.apart or not self.a.merger:
            return self._learn_each(units, not self.b.apart)
        # a unit that ends in white space is the last of its text
        joined, others = [], []
        for u in units:
            (joined if len(u) <= LONG and u[0] in " \n" and not u[-1].isspace() and PLAIN.fullmatch(u) else others).append(u)
        for lo in range(0, len(joined), JOINED):
            some = joined[lo : lo + JOINED]
            if not self._learn_joined(some):
                others += some
        if others:
            self._learn_each(others, False)

    def pairs(self, kind: str) -> list[tuple[tuple[int, int], str]]:
        """The pairs that a kind links, each with the kind that is the pair alone."""
        if kind not in self.linked:
            if len(self.linked) > MEMORY:
                self.linked.clear()
            self.linked[kind] = [(p, f"{p[0]}|{p[1]}") for p in expand(kind, self.a.raw, self.b.raw)]
        return self.linked[kind]

    def __call__(self, texts: list[str | None]) -> list[tuple]:
        """(n_a, n_b, n_groups, sha256, {kind: n}, {pair: repeats}) of each text."""
        if len(self.units) > MEMORY:
            self.units.clear()
        split = [[] if not t else UNIT.findall(" " + t) if self.b.apart else [" " + t] for t in texts]
        new = list(set(chain.from_iterable(split)).difference(self.units))
        if new:
            self._learn(new)
        return [self._document(list(map(self.units.__getitem__, s))) for s in split]

    def _document(self, found: list[tuple | None]) -> tuple:
        if not found or None in found:
            return 0, 0, 0, "", {}, {}
        said, n_a, n_b = zip(*found, strict=True)
        whole = ";".join(said)
        kinds = Counter(whole.split(";"))
        # a pair is in two kinds only if one of them holds several tokens of a side
        held = Counter(chain.from_iterable([self.pairs(k) for k in kinds if "," in k]))
        repeats = {pair: n - (alone not in kinds) for (pair, alone), n in held.items() if n > 1 or alone in kinds}
        return sum(n_a), sum(n_b), kinds.total(), hashlib.sha256(whole.encode("ascii")).hexdigest(), kinds, repeats


DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, kinds array<struct<kind:string,n:long>>, repeats array<struct<a:int,b:int,n:long>>"


def _lists(rows: list[dict], keys: list[tuple[str, pa.DataType]]) -> pa.ListArray:
    """Lists of structs: the parts of a dictionary's keys, then its value as n."""
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    flat = [k for r in rows for k in r]
    parts = [flat] if len(keys) == 1 else (list(zip(*flat, strict=True)) or [[] for _ in keys])
    cols = [pa.array(p, kind) for p, (_, kind) in zip(parts, keys, strict=True)]
    values = pa.StructArray.from_arrays([*cols, pa.array([n for r in rows for n in r.values()], pa.int64())], [*(k for k, _ in keys), "n"])
    return pa.ListArray.from_arrays(pa.array(ends), values)


_aligners: dict[tuple, Aligner] = {}


def _aligner(path_a: str, path_b: str) -> Aligner:
    """One a worker: its memory outlives a task."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def _align_batches(batches: Iterable[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    align = _aligner(path_a, path_b)
    for batch in batches:
        for lo in range(0, batch.num_rows, CHUNK):
            n_a, n_b, n_groups, said, kinds, repeats = zip(*align(batch.column(1).slice(lo, CHUNK).to_pylist()), strict=True)
            cols = [batch.column(0).slice(lo, CHUNK), *(pa.array(c, pa.int64()) for c in (n_a, n_b, n_groups)), pa.array(said, pa.string())]
            cols += [_lists(kinds, [("kind", pa.string())]), _lists(repeats, [("a", pa.int32()), ("b", pa.int32())])]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "kinds", "repeats"])


def _link_batches(batches: Iterable[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    raw_a, raw_b = byte_level(path_a).raw, pieces(path_b).raw
    for batch in batches:
        kinds, docs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lo in range(0, len(kinds), CHUNK):
            rows = [(kind, n, a, b, m) for kind, n in zip(kinds[lo : lo + CHUNK], docs[lo : lo + CHUNK], strict=True) for (a, b), m in expand(kind, raw_a, raw_b).items()]
            types = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], ["kind", "docs", "a", "b", "n"])


def join_counted(rows: DataFrame, values: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """rows joined with values by keys, where ``weight`` says how many rows each key has.

    Keys with a HOT_SHARE-th of all rows or more are broadcast: they cannot be more than HOT_SHARE. The
    rest meets in a shuffle in which no key has more rows than that share.
    """
    total = values.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) * F.lit(HOT_SHARE) >= F.lit(total)
    hot, cold = values.filter(is_hot).drop(weight), values.filter(~is_hot).drop(weight)
    near = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return near.union(rest.select(*near.columns))


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> Alignment:
    """Align the tokens of every whole text by tokenizers A (byte-level) and B (pieces).

    Null and empty texts, and texts that either tokenizer does not give back byte by byte, have no tokens.
    Repeated rows and null ids are documents of their own; other columns are not read; no rows, no rows.
    """
    path_a, path_b = path_a or tokenizer_path(VOCABULARY_A), path_b or tokenizer_path(VOCABULARY_B)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    aligned = slim.mapInArrow(lambda b: _align_batches(b, path_a, path_b), DOCUMENT)
    documents = settle(aligned.select(F.monotonically_increasing_id().alias("row"), "*"))
    held = documents.select(F.explode("kinds").alias("x")).select("x.kind", "x.n")
    kinds = settle(held.groupBy("kind").agg(F.count("*").alias("docs"), F.sum("n").alias("occurrences")))
    links = settle(kinds.select("kind", "docs").mapInArrow(lambda b: _link_batches(b, path_a, path_b), "kind string, docs long, a int, b int, n long"))
    less = documents.select(F.explode("repeats").alias("x")).select("x.a", "x.b", (-F.col("x.n")).alias("docs"), F.lit(0).alias("kinds"))
    counts = links.select("a", "b", "docs", F.lit(1).alias("kinds")).union(less).groupBy("a", "b").agg(F.sum("docs").alias("count"), F.sum("kinds").alias("n_kinds"))
    counts = settle(counts)
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    pairs = settle(counts.join(highest, "a").select("a", "b", "count", "n_kinds", (F.col("count") == F.col("highest")).cast("long").alias("best")))
    return Alignment(documents, kinds, links, pairs)


def document_links(found: Alignment) -> DataFrame:
    """row, n_links, n_best, count_sum of the documents with tokens."""
    valued = join_counted(found.links.select("kind", "docs", "a", "b", "n"), found.pairs, ["a", "b"], "n_kinds")
    each = valued.groupBy("kind").agg(F.first("docs").alias("docs"), F.sum("n").alias("links"), F.sum(F.col("n") * F.col("best")).alias("bests"), F.sum(F.col("n") * F.col("count")).alias("counts"))
    held = found.documents.select("row", F.explode("kinds").alias("x")).select("row", "x.kind", "x.n")
    joined = join_counted(held, settle(each), ["kind"], "docs")
    return joined.groupBy("row").agg(*(F.sum(F.col("n") * F.col(c)).alias(to) for c, to in (("links", "n_links"), ("bests", "n_best"), ("counts", "count_sum"))))


def op12_token_alignment(spark, sf_dir: str) -> DataFrame:
    """All documents: their tokens, groups and links, and how common their links are in the corpus."""
    found = align(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    whole = found.documents.select("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256").join(document_links(found), "row", "left")
    sums = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_links", "n_best", "count_sum")]
    return whole.select("doc_id", "n_a", "n_b", "n_groups", *sums, "groups_sha256")
