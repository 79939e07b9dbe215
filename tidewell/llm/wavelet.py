"""Token ids in wavelet matrices, one compressed file a shard.

Texts are put in the order of their ids by a range shuffle, each task encodes its range and cuts it into
shards of about ``SHARD_TOKENS`` ids, whole documents each. A shard file holds

    header     magic, ids, planes, documents, symbols, ids of the task before this shard
    alphabet   the shard's ids by falling frequency: a symbol is an id's place here
    documents  their ids (and which are null) and lengths
    directory  for each plane its zeros, for each block of a plane its place, size and the ones before it
    blocks     2^16 bits each, deflated where that is shorter

Plane k holds bit k (from the highest) of the symbols in the order left by the planes above: zeros of the
plane before first, then its ones, both in their order. Rank and select read the blocks they need, so an
id at a place, the count of an id in a range and the places where it occurs come from the one file without
decoding the others; a whole shard is decoded plane by plane from the lowest up.

Files are the binary column of a Parquet table, which every executor can write and read wherever the
table lies, and in which a lost task leaves nothing behind.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import settle, shuffle_partitions
from tidewell.llm.token_units import TextIds, tokenizer_path

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
SHARD_TOKENS = 1 << 20
BLOCK_BITS = 1 << 16
MAGIC = b"TWM1"
HEADER = struct.Struct("<4sQIIIQIII")
BLOCK = np.dtype([("at", "<u8"), ("size", "<u4"), ("ones", "<u8")])
CHUNK = 256


def _deflate(raw: bytes) -> bytes:
    small = zlib.compress(raw, 1)
    return b"\1" + small if len(small) < len(raw) else b"\0" + raw


def _inflate(said: bytes) -> bytes:
    return zlib.decompress(said[1:]) if said[:1] == b"\1" else said[1:]


def build(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int], before: int = 0) -> bytes:
    """The file of a shard: all its ids, its documents and how many ids its task wrote before it."""
    alphabet, place, count = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    symbol = np.empty(len(order), np.uint32)
    symbol[order] = np.arange(len(order), dtype=np.uint32)
    now = symbol[place.reshape(-1)]
    planes = max(1, int(len(order) - 1).bit_length()) if len(order) else 0
    if planes <= 16:
        now = now.astype(np.uint16)
    zeros, directory, blocks, at = [], [], [], 0
    for bit in reversed(range(planes)):
        ones = (now >> bit) & 1 == 1
        packed = np.packbits(ones, bitorder="little")
        running = 0
        for lo in range(0, len(packed), BLOCK_BITS // 8):
            raw = packed[lo : lo + BLOCK_BITS // 8]
            said = _deflate(raw.tobytes())
            directory.append((at, len(said), running))
            blocks.append(said)
            at += len(said)
            running += int(np.bitwise_count(raw).sum())
        low = now[~ones]
        zeros.append(len(low))
        now = np.concatenate([low, now[ones]])
    names = np.array([0 if d is None else d for d in doc_ids], "<i8")
    known = np.packbits(np.array([d is not None for d in doc_ids], bool))
    letters = _deflate(alphabet[order].astype("<u4").tobytes())
    documents = _deflate(np.diff(names, prepend=names.dtype.type(0)).tobytes() + known.tobytes() + np.array(lengths, "<u8").tobytes())
    table = _deflate(np.array(zeros, "<u8").tobytes() + np.array(directory, BLOCK).tobytes())
    head = HEADER.pack(MAGIC, len(ids), planes, len(doc_ids), len(order), before, len(letters), len(documents), len(table))
    return b"".join([head, letters, documents, table, *blocks])


class Shard:
    """Reads one shard file; blocks are inflated when asked for."""

    def __init__(self, file: bytes):
        magic, self.n, self.planes, n_docs, n_symbols, self.before, *sizes = HEADER.unpack_from(file)
        if magic != MAGIC:
            raise ValueError("not a shard file")
        parts, at = [], HEADER.size
        for size in sizes:
            parts.append(_inflate(file[at : at + size]))
            at += size
        self.alphabet = np.frombuffer(parts[0], "<u4")
        n_known = (n_docs + 7) // 8
        names = np.cumsum(np.frombuffer(parts[1], "<i8", n_docs))
        known = np.unpackbits(np.frombuffer(parts[1], np.uint8, n_known, 8 * n_docs), count=n_docs)
        self.doc_ids = [d if k else None for d, k in zip(names.tolist(), known.tolist(), strict=True)]
        self.lengths = np.frombuffer(parts[1], "<u8", n_docs, 8 * n_docs + n_known).astype(np.int64)
        self.zeros = np.frombuffer(parts[2], "<u8", self.planes).astype(np.int64)
        self.per_plane = -(-self.n // BLOCK_BITS)
        self.directory = np.frombuffer(parts[2], BLOCK, self.planes * self.per_plane, 8 * self.planes)
        self.file, self.at = file, at
        self.open: dict[int, np.ndarray] = {}

    def _block(self, plane: int, block: int) -> np.ndarray:
        """Ones before each bit of a block, and after its last."""
        k = plane * self.per_plane + block
        if k not in self.open:
            row = self.directory[k]
            start = self.at + int(row["at"])
            raw = np.frombuffer(_inflate(self.file[start : start + int(row["size"])]), np.uint8)
            bits = np.unpackbits(raw, bitorder="little", count=min(BLOCK_BITS, self.n - block * BLOCK_BITS))
            self.open[k] = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)]) + int(row["ones"])
        return self.open[k]

    def rank(self, plane: int, at: int) -> int:
        """Ones before place ``at`` of a plane."""
        if at >= self.n:
            return self.n - int(self.zeros[plane])
        return int(self._block(plane, at // BLOCK_BITS)[at % BLOCK_BITS])

    def select(self, plane: int, bit: int, kth: np.ndarray) -> np.ndarray:
        """Places of the kth (from 0, rising) bits of a kind."""
        rows = self.directory[plane * self.per_plane : (plane + 1) * self.per_plane]
        first = np.arange(self.per_plane, dtype=np.int64) * BLOCK_BITS
        before = rows["ones"].astype(np.int64) if bit else first - rows["ones"].astype(np.int64)
        out = np.empty(len(kth), np.int64)
        block = np.searchsorted(before, kth, side="right") - 1
        for b in np.unique(block).tolist():
            ranks = self._block(plane, b)
            if not bit:
                ranks = b * BLOCK_BITS + np.arange(len(ranks)) - ranks
            mine = block == b
            out[mine] = b * BLOCK_BITS + np.searchsorted(ranks, kth[mine] + 1, side="left") - 1
        return out

    def access(self, at: int) -> int:
        """The id at a place of the shard."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        symbol = 0
        for plane in range(self.planes):
            ones = self.rank(plane, at)
            bit = self.rank(plane, at + 1) - ones
            symbol = symbol << 1 | bit
            at = int(self.zeros[plane]) + ones if bit else at - ones
        return int(self.alphabet[symbol])

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int, list[int]]:
        """Where the occurrences of an id among places lo to hi stand below the last plane."""
        found = np.flatnonzero(self.alphabet == token)
        lo, hi = max(0, lo), min(self.n, hi)
        if not len(found) or lo >= hi:
            return 0, 0, []
        bits = [int(found[0]) >> b & 1 for b in reversed(range(self.planes))]
        for plane, bit in enumerate(bits):
            a, b = self.rank(plane, lo), self.rank(plane, hi)
            lo, hi = (int(self.zeros[plane]) + a, int(self.zeros[plane]) + b) if bit else (lo - a, hi - b)
        return lo, hi, bits

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often an id occurs among places lo to hi (exclusive)."""
        a, b, _ = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def occurrences(self, token: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Places of an id among lo to hi (exclusive), rising."""
        a, b, bits = self._range(token, lo, self.n if hi is None else hi)
        at = np.arange(a, b, dtype=np.int64)
        for plane in reversed(range(len(bits))):
            at = self.select(plane, bits[plane], at - self.zeros[plane] if bits[plane] else at)
        return np.sort(at)

    def ids(self) -> np.ndarray:
        """All ids of the shard."""
        now = np.zeros(self.n, np.uint16 if self.planes <= 16 else np.uint32)
        for plane in reversed(range(self.planes)):
            rows = self.directory[plane * self.per_plane : (plane + 1) * self.per_plane]
            raw = b"".join(_inflate(self.file[self.at + a : self.at + a + s]) for a, s in zip(rows["at"].tolist(), rows["size"].tolist(), strict=True))
            ones = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n, bitorder="little").view(bool)
            up, cut = np.empty_like(now), int(self.zeros[plane])
            up[~ones] = now[:cut]
            up[ones] = now[cut:] | now.dtype.type(1 << (self.planes - 1 - plane))
            now = up
        return self.alphabet[now] if self.n else np.zeros(0, "<u4")


_memories: dict[str, TextIds] = {}


def _write_batches(batches: Iterable[pa.RecordBatch], path: str, end_id: int, shard_tokens: int) -> Iterator[pa.RecordBatch]:
    if path not in _memories:
        _memories[path] = TextIds(path)
    encode, part, tail = _memories[path], TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
    names: list[int | None] = []
    raws: list[bytes] = []
    held = shard = before = 0

    def close() -> pa.RecordBatch:
        lengths = [len(r) // 4 for r in raws]
        file = build(np.frombuffer(b"".join(raws), "<u4"), names, lengths, before)
        cols = [pa.array([v], k) for v, k in ((part, pa.int32()), (shard, pa.int32()), (len(names), pa.int64()), (held, pa.int64()), (file, pa.binary()))]
        return pa.RecordBatch.from_arrays(cols, ["part", "shard", "n_docs", "n_tokens", "file"])

    for batch in batches:
        for lo in range(0, batch.num_rows, CHUNK):
            texts = [t or "" for t in batch.column(1).slice(lo, CHUNK).to_pylist()]
            for name, raw in zip(batch.column(0).slice(lo, CHUNK).to_pylist(), encode(texts), strict=True):
                names.append(name)
                raws.append(raw + tail)
                held += len(raws[-1]) // 4
                if held >= shard_tokens:
                    yield close()
                    before, shard, held = before + held, shard + 1, 0
                    names.clear()
                    raws.clear()
    if names:
        yield close()


def write_shards(docs: DataFrame, path: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """part, shard, n_docs, n_tokens, file: the ids of all whole texts in ascending order of doc_id.

    Parts and the shards in them follow that order. Null and empty texts are the end id alone; rows with
    a null id come first, and rows that repeat an id, in the order they are read in, are documents each. A
    document is never cut, so a shard exceeds ``shard_tokens`` by less than its last one. Other columns
    are not read; no rows, no shards.
    """
    spark, path = docs.sparkSession, path or tokenizer_path(VOCABULARY)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("at"))
    # the row's place parts rows that repeat an id over tasks as well
    dealt = slim.repartitionByRange(shuffle_partitions(spark), "doc_id", "at").sortWithinPartitions("doc_id", "at")
    return dealt.select("doc_id", "text").mapInArrow(lambda b: _write_batches(b, path, end_id, shard_tokens), "part int, shard int, n_docs long, n_tokens long, file binary")


def part_starts(shards: DataFrame) -> DataFrame:
    """part, base: the ids of all parts before. One row a writing task."""
    sums = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return sums.select("part", F.coalesce(before, F.lit(0).cast("long")).alias("base"))


def _read_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, file in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            shard = Shard(file.as_py())
            raw = shard.ids().astype("<u4", copy=False).tobytes()
            ends = np.cumsum(shard.lengths)
            starts = ends - shard.lengths
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            n = len(crc)
            cols = [pa.array([part] * n, pa.int32()), pa.array(shard.doc_ids, pa.int64()), pa.array(starts + shard.before), pa.array(shard.lengths), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["part", "doc_id", "start", "n_tokens", "ids_crc32"])


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files."""
    found = shards.select("part", "file").mapInArrow(_read_batches, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    # one row a writing task, whatever it wrote
    based = found.join(F.broadcast(part_starts(shards)), "part")
    return based.select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def token_counts(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """token, n: how often each id occurs, counted by rank alone."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0):
                shard = Shard(file.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([shard.count(t) for t in tokens], pa.int64())], ["token", "n"])

    return shards.select("file").mapInArrow(read, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def token_places(shards: DataFrame, token: int) -> DataFrame:
    """doc_id, place, start: where an id occurs, by its document, its place there and in the corpus."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, file in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(file.as_py())
                at = shard.occurrences(token)
                ends = np.cumsum(shard.lengths)
                doc = np.searchsorted(ends, at, side="right")
                cols = [pa.array([part] * len(at), pa.int32()), pa.array([shard.doc_ids[d] for d in doc.tolist()], pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(at - (ends - shard.lengths)[doc]), pa.array(at + shard.before)], ["part", "doc_id", "place", "start"])

    found = shards.select("part", "file").mapInArrow(read, "part int, doc_id long, place long, start long")
    return found.join(F.broadcast(part_starts(shards)), "part").select("doc_id", "place", (F.col("start") + F.col("base")).alias("start"))


def tokens_at(shards: DataFrame, places: DataFrame) -> DataFrame:
    """start, token for places (start) of the corpus: each place meets the one shard that holds it."""
    starts = shards.select("part", "shard", "n_tokens").join(F.broadcast(part_starts(shards)), "part")
    before = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    spans = starts.select("part", "shard", (F.col("base") + F.coalesce(before, F.lit(0))).alias("lo"), "n_tokens")
    # a span covers the cells it touches, so a place meets the few spans of its own cell
    last = F.col("lo") + F.col("n_tokens") - 1
    spans = spans.withColumn("cell", F.explode(F.sequence(F.shiftright("lo", 20), F.shiftright(last, 20))))
    asked = places.withColumn("cell", F.shiftright("start", 20)).join(spans, "cell").filter((F.col("start") >= F.col("lo")) & (F.col("start") <= last))
    asked = asked.groupBy("part", "shard", "lo").agg(F.collect_set(F.col("start") - F.col("lo")).alias("inside"))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, inside, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                shard = Shard(file.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([lo + i for i in inside], pa.int64()), pa.array([shard.access(i) for i in inside], pa.int64())], ["start", "token"])

    return shards.select("part", "shard", "file").join(asked, ["part", "shard"]).select("lo", "inside", "file").mapInArrow(read, "start long, token long")


def op13_wavelet_shards(spark, sf_dir: str) -> DataFrame:
    """All documents written as wavelet matrices, and read back from their files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_shards(settle(write_shards(docs)))
