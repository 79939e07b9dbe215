"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Every document becomes the ids of its words, then id 0; documents longer than the capacity are cut
into full pieces and a rest. An instance of bin packing is known by how many pieces there are of each
length, so the packing is planned on that histogram (``capacity`` counters at most, whatever the input):

1. reduction: for the largest remaining length, fix bins that dominate every other way to fill them
   (nothing else fits; an exact complement; the largest partner where no two partners fit, or where it
   is at least as large as the best two) and take their pieces out of the instance;
2. best-fit decreasing over what remains, a whole length at a time.

The plan says which ranks of a length go to which sequences; each piece finds its place from its rank
among the pieces of its length, counted in cells, so no length is gathered in one task.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import set_aside, settle

CAPACITY = 2048
VOCABULARY = "word_bpe_49k.json"
#: Pieces whose ids a worker remembers; the memory is emptied when full.
MEMORY_WORDS = 300_000
CHUNK = 512
#: Pieces of one length that a cell is meant to hold; cells at least.
CELL_PIECES, LEAST_CELLS = 100_000, 64

_encoders: dict[str, "Encoder"] = {}


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts, as the tokenizer gives them.

    Texts of ASCII and Latin-1 signs are cut into letters, digits and other signs as the tokenizer's
    pattern says, and each piece is encoded once and remembered. tiktoken merges all new pieces in one
    call: a piece ends in a zero byte, which joins the byte before it first and so stands for the
    vocabulary's word ends. Both libraries merge the pair of the lowest rank first; tiktoken knows a
    pair by its joined bytes, which gives the same merges since every token of the vocabulary is
    reached from its own bytes by the pair that is listed for it (tested). All other texts go to the
    tokenizer itself, word by word, as it never joins what ASCII white space parts.
    """

    SIMPLE = re.compile("[\t\n\x0b\x0c\r !-~\u00a1-\u00ff]*")
    LONG = 4096
    #: The vocabulary's pattern for lower-cased texts of these signs.
    PIECE = re.compile("[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|'(?:s|t|re|ve|m|ll|d)|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\t\n\x0b\x0c\r a-z0-9\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xdf-\xf6\xf8-\xff]+")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ranks, self.id_of = byte_ranks(model)
        self.merger = tiktoken.Encoding("words", pat_str=r"[^\n]+|\n", mergeable_ranks=ranks, special_tokens={})
        self.line = ranks[b"\n"]
        self.known: dict[str, bytes] = {}

    def merge(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces without white space, as little-endian unsigned 32-bit."""
        found = np.array(self.merger.encode_ordinary("\0\n".join(pieces) + "\0"), dtype=np.int64)
        ends = np.append(np.flatnonzero(found == self.line), len(found))
        raw = self.id_of[found].astype("<u4").tobytes()
        starts = np.append(0, ends[:-1] + 1)
        return [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]

    def parts(self, text: str) -> list[str]:
        """Keys of the text's pieces: pieces of a simple text, else its words behind a blank."""
        if "<|" not in text and self.SIMPLE.fullmatch(text):
            return self.PIECE.findall(text.lower())
        return [" " + w.decode("utf-8") for w in text.encode("utf-8").split()]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit."""
        known = self.known
        if len(known) > MEMORY_WORDS:
            known.clear()
        split = [self.parts(t) for t in texts]
        new = set(chain.from_iterable(split)).difference(known)
        # what tiktoken is not made for, pieces of many bytes, the tokenizer itself encodes as well
        alone = [w for w in new if w[0] == " " or len(w) > self.LONG]
        for w in alone:
            known[w] = np.array(self.tok.encode(w.lstrip(" "), add_special_tokens=False).ids, dtype="<u4").tobytes()
        some = list(new.difference(alone)) if alone else list(new)
        if some:
            known.update(zip(some, self.merge(some), strict=True))
        return [b"".join(map(known.__getitem__, p)) for p in split]


def byte_ranks(model: dict) -> tuple[dict[bytes, int], np.ndarray]:
    """Ranks of byte strings for a vocabulary with word ends, an end being a zero byte; and the id of
    each rank, -1 where there is none."""
    vocab, end = model["vocab"], model["end_of_word_suffix"]
    # bytes that are printable in Latin-1 stand for themselves, the others for code points from 256
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    sign = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in shown)}
    byte = {c: b for b, c in sign.items()}

    def raw(token: str) -> bytes:
        body = token.removesuffix(end)
        return bytes(byte[c] for c in body) + (b"\0" if body != token else b"")

    ranks = {bytes([b]): b for b in range(256)}
    ids = [vocab.get(sign[b], -1) for b in range(256)]
    # the last byte of a piece takes its end before anything else is merged
    for left, right in [(sign[b], end) for b in range(1, 256)] + [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]:
        ranks[raw(left + right)] = len(ids)
        ids.append(vocab.get(left + right, -1))
    return ranks, np.array(ids, dtype=np.int64)


def encode(texts: list[str], path: str) -> list[bytes]:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path](texts)


def cut(batches: Iterable[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    step = 4 * capacity
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for lo in range(0, batch.num_rows, CHUNK):
            out: list[tuple] = []
            names = ids.slice(lo, CHUNK).to_pylist()
            for name, raw in zip(names, encode([t or "" for t in texts.slice(lo, CHUNK).to_pylist()], path), strict=True):
                raw += b"\0\0\0\0"
                for at in range(0, len(raw), step):
                    part = raw[at : at + step]
                    out.append((name, at // step, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = zip(*out, strict=True)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of every document."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(lambda b: cut(b, path, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


class Lengths:
    """A multiset of lengths."""

    def __init__(self, hist: dict[int, int]):
        self.n = {k: v for k, v in hist.items() if v}
        self.keys = sorted(self.n)

    def take(self, length: int, count: int) -> None:
        self.n[length] -= count
        if not self.n[length]:
            del self.n[length]
            self.keys.remove(length)

    def largest_to(self, room: int, but: int = 0) -> int:
        """The largest length within room, where one piece of length ``but`` is in use; 0 if none."""
        i = bisect_right(self.keys, room) - 1
        if i >= 0 and self.keys[i] == but and self.n[but] < 2:
            i -= 1
        return self.keys[i] if i >= 0 else 0

    def smallest(self, count: int, but: int) -> list[int]:
        """The lengths of the smallest pieces, without one piece of length ``but``."""
        out: list[int] = []
        for k in self.keys:
            out += [k] * min(count - len(out), self.n[k] - (k == but))
            if len(out) >= count:
                break
        return out


def best_two(free: Lengths, room: int, but: int) -> int:
    """The largest sum of two remaining pieces within room."""
    left = {k: free.n[k] - (k == but) for k in free.keys if k < room}
    keys = [k for k, n in left.items() if n]
    best, i, j = 0, 0, len(keys) - 1
    while i <= j:
        s = keys[i] + keys[j]
        if s > room:
            j -= 1
            continue
        if i < j or left[keys[i]] > 1:
            best = max(best, s)
        i += 1
    return best


def reduce_instance(free: Lengths, capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Fix dominating bins and take their pieces out of ``free``: [(((length, count), ...), bins)]."""
    fixed: list[tuple[tuple[tuple[int, int], ...], int]] = []

    def fix(a: int, b: int) -> None:
        if not b:
            bins, shape = free.n[a], ((a, 1),)
        elif a == b:
            bins, shape = free.n[a] // 2, ((a, 2),)
        else:
            bins, shape = min(free.n[a], free.n[b]), ((a, 1), (b, 1))
        for length, m in shape:
            free.take(length, bins * m)
        fixed.append((shape, bins))

    for a in reversed(list(free.keys)):
        while free.n.get(a):
            room = capacity - a
            b = free.largest_to(room, a)
            low = free.smallest(3, a)
            if not b or b == room or len(low) < 2 or low[0] + low[1] > room:
                fix(a, b)
            elif (len(low) < 3 or sum(low) > room) and b >= best_two(free, room, a):
                fix(a, b)
            else:
                break
    return fixed


def best_fit(free: Lengths, capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit decreasing: the largest pieces first, each into the fullest bin that still takes it."""
    open_: dict[int, list[list]] = {}
    rooms: list[int] = []

    def put(room: int, shape: tuple, bins: int) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append([shape, bins])

    for a in reversed(free.keys):
        left = free.n[a]
        while left:
            i = bisect_left(rooms, a)
            if i == len(rooms):
                room, shape, bins = capacity, (), -(-left // (capacity // a))
            else:
                room = rooms[i]
                shape, bins = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(i)
            m = room // a
            full = min(bins, left // m)
            if full:
                put(room - m * a, (*shape, (a, m)), full)
                left, bins = left - full * m, bins - full
            if bins and left and left < m:
                put(room - left * a, (*shape, (a, left)), 1)
                left, bins = 0, bins - 1
            if bins and shape:
                put(room, shape, bins)
    return [(shape, bins) for groups in open_.values() for shape, bins in groups]


def plan(hist: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from rank, to rank, pieces a sequence, first sequence, offset) for every length."""
    free = Lengths(hist)
    shapes = reduce_instance(free, capacity)
    shapes += best_fit(free, capacity)
    seen: dict[int, int] = {}
    rows, sequence = [], 0
    for shape, bins in shapes:
        offset = 0
        for length, m in shape:
            at = seen.get(length, 0)
            rows.append((length, at, at + m * bins, m, sequence, offset))
            seen[length] = at + m * bins
            offset += m * length
        sequence += bins
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (doc_id, piece, length of 1 to capacity, ...) with sequence_id and offset.

    Rows that repeat (doc_id, piece) are pieces of their own. No pieces, no rows. Columns of the input
    named sequence_id or offset are replaced, others come along whatever their names.
    """
    spark = pieces.sparkSession
    pieces, back = set_aside(pieces.drop("sequence_id", "offset"), "doc_id", "piece", "length", "ids_crc32")
    hist = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = spark.createDataFrame(plan(hist, capacity), "_length long, _from long, _to long, _m long, _seq long, _offset long")
    cells = max(LEAST_CELLS, sum(hist.values()) // CELL_PIECES)
    named = [c for c in ("doc_id", "piece", "ids_crc32") if c in pieces.columns]
    cell = F.pmod(F.xxhash64(*named), F.lit(cells))
    dealt = pieces.withColumn("_cell", cell)
    sums = dealt.groupBy("length", "_cell").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(F.col("length").alias("_l"), F.col("_cell").alias("_c"), F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("length", "_cell").orderBy(*named))
    ranked = dealt.withColumn("_inside", inside).join(sums, (F.col("length") == F.col("_l")) & (F.col("_cell") == F.col("_c")))
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_inside") - 1)
    # the plan has rows for lengths and bin shapes, not for pieces: its size follows the capacity alone
    placed = ranked.join(F.broadcast(places), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    nth = F.col("_rank") - F.col("_from")
    out = placed.select(
        *pieces.columns,
        (F.col("_seq") + F.floor(nth / F.col("_m"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + (nth % F.col("_m")) * F.col("length")).cast("long").alias("offset"),
    )
    return back(out)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pack the texts of docs. A null or empty text is the single id 0; a text of any length is cut whole."""
    return pack(settle(token_pieces(docs, path or tokenizer_path(), capacity)), capacity)


def op1_dominance_best_fit(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
