"""Sentences grouped into chunks by meaning, a sentence at a time.

Sentences of a document follow each other in one task, in order. Of sentences given as rows (``grouped``), what
is carried from one to the next is the chunk under way and the last embedding, so a document of any length
needs no more memory than a chunk. Numbers that depend on a document's end (pieces of oversized chunks come
after all others) are counted by windows over a document's chunks, which Spark spills. Of whole texts
(``semantic_chunks``), one document's sentences are held at a time, as its text was.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import text as tx
from tidewell.operators.retrieval import paragraph_cut, sentence_array, sentences, word_cut


def near(a: list | None, b: list | None) -> float:
    """Cosine of two embeddings; 0 for empty, unequal or zero ones."""
    x, y = np.asarray(a or [], dtype=float), np.asarray(b or [], dtype=float)
    if not len(x) or len(x) != len(y):
        return 0.0
    size = float(np.sqrt(x @ x) * np.sqrt(y @ y))
    return float(np.float32(x @ y / size)) if size else 0.0


def _grouped(batches: Iterable[pa.RecordBatch], least: int, most: int, similarity: float, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    name, held, size, last, nth, any_ = None, [], 0, None, 0, False

    def rows(done: list[tuple]) -> pa.RecordBatch:
        ids, nths, texts, counts = zip(*done, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(nths, pa.int32()), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], ["id", "nth", "chunk", "n"])

    for batch in batches:
        done = []
        for i, text, e in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            n = len(text.encode("utf-8"))
            if any_ and i != name:
                done.append((name, nth, " ".join(held), len(held)))
                held, size, nth = [], 0, 0
            elif any_ and (near(last, e) < similarity and size >= least or size + n > most):
                done.append((name, nth, " ".join(held), len(held)))
                held, size, nth = [], 0, nth + 1
            size += n + bool(held)
            held.append(text)
            name, last, any_ = i, e, True
        if done:
            yield rows(done)
    if any_:
        yield rows([(name, nth, " ".join(held), len(held))])


def grouped(rows: DataFrame, least: int = 100, most: int = 2000, similarity: float = 0.3) -> DataFrame:
    """(id, position, chunk) of sentences (id, position, sentence, embedding).

    A sentence starts a new chunk if it is unlike the one before and the chunk has ``least`` bytes, or if the
    chunk would pass ``most``. A longer chunk, which is one long sentence, is cut between words; such
    pieces are numbered after all other chunks. A document of one sentence is one chunk of any size.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(rows.dtypes)["id"]
    arrow = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    ordered = rows.select("id", "position", "sentence", "embedding").repartition(parts, "id").sortWithinPartitions("id", "position").select("id", "sentence", "embedding")
    chunks = ordered.mapInArrow(lambda b: _grouped(b, least, most, similarity, arrow), f"id {kind}, nth int, chunk string, n int")
    every = Window.partitionBy("id")
    known = chunks.withColumns({"total": F.count("*").over(every).cast("int"), "sentences": F.sum("n").over(every)})
    known = known.withColumn("long", (F.octet_length("chunk") > most) & (F.col("sentences") > 1))
    cut = F.udf(lambda text: None if text is None else word_cut(text, most), "array<string>")
    pieces = known.withColumn("pieces", F.coalesce(cut(F.when(F.col("long"), F.col("chunk"))), F.array("chunk")))
    rows = pieces.select("id", "nth", "total", "long", F.posexplode("pieces").alias("at", "chunk"))
    before = F.sum(F.col("long").cast("int")).over(every.orderBy("nth", "at").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("id", F.when(F.col("long"), F.col("total") + before - 1).otherwise(F.col("nth")).cast("int").alias("position"), "chunk")


def _nears(column: pa.Array, last: list | None) -> tuple[np.ndarray, list | None]:
    """(near of each embedding and the one before, the last embedding); ``last`` comes before the first.
    Rows without an embedding are passed over."""
    there = column.is_valid().to_numpy(zero_copy_only=False)
    some, out = column.drop_null(), np.zeros(len(column))
    if not len(some):
        return out, last
    sizes = np.diff(some.offsets.to_numpy())
    if sizes[0] and (sizes == sizes[0]).all() and not some.flatten().null_count:
        v = some.flatten().to_numpy().reshape(len(some), -1).astype(float)
        norms, dots = np.sqrt(np.einsum("ij,ij->i", v, v)), np.einsum("ij,ij->i", v[1:], v[:-1])
        scale = norms[1:] * norms[:-1]
        rest = np.where(scale > 0, dots / np.where(scale > 0, scale, 1), 0).astype(np.float32)
        first, last = near(last, v[0].tolist()), v[-1].tolist()
    else:
        es = some.to_pylist()
        first, rest, last = near(last, es[0]), [near(x, y) for x, y in zip(es, es[1:], strict=False)], es[-1]
    out[there] = [first, *rest]
    return out, last


def _document(texts: list[tuple], said: list[tuple], least: int, most: int, similarity: float) -> list[tuple[int, str]]:
    """(position, chunk) of a document. texts: (text, its number of sentences, its only sentence); said:
    (sentence, its bytes, near the one before, whether it has an embedding)."""
    n = sum(t[1] for t in texts)
    if n == 1:
        return [(0, t[2]) for t in texts]
    if n != sum(s[3] for s in said):
        return [(i, c) for text, _, _ in texts for i, c in enumerate(paragraph_cut(text, most))]
    chunks, size = [], 0
    for text, bytes_, close, _ in said:
        if not chunks or close < similarity and size >= least or size + bytes_ > most:
            chunks.append([])
            size = 0
        size += bytes_ + bool(chunks[-1])
        chunks[-1].append(text)
    out, pieces = [], []
    for i, chunk in enumerate(" ".join(c) for c in chunks):
        if len(chunk) > most or len(chunk.encode("utf-8")) > most:
            pieces += word_cut(chunk, most)
        else:
            out.append((i, chunk))
    return out + [(len(chunks) + i, c) for i, c in enumerate(pieces)]


#: Characters of chunks that are handed on together.
HANDED = 4 << 20


def _documents(batches: Iterable[pa.RecordBatch], least: int, most: int, similarity: float, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    name, texts, said, last, done, held = None, [], [], None, [], 0

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (kind, pa.int32(), pa.string()), strict=True)], ["id", "position", "chunk"])

    for batch in batches:
        ids, sentence, number, only = (batch.column(c).to_pylist() for c in (0, 1, 3, 4))
        has = pc.is_valid(batch.column(2)).to_pylist()
        sizes = pc.binary_length(batch.column(1)).to_pylist()
        nears, last = _nears(batch.column(2), last)
        for i, text, n, first, e, size, close in zip(ids, sentence, number, only, has, sizes, nears.tolist(), strict=True):
            if i != name:
                done += [(name, at, c) for at, c in _document(texts, said, least, most, similarity)]
                held += sum(s[1] for s in said)
                name, texts, said = i, [], []
                if held > HANDED and done:
                    yield rows()
                    done, held = [], 0
            if n is None:
                said.append((text, size, close, e))
            else:
                texts.append((text, n, first))
    done += [(name, at, c) for at, c in _document(texts, said, least, most, similarity)]
    if done:
        yield rows()


def semantic_chunks(docs: DataFrame, embed: Callable[[DataFrame], DataFrame], least: int = 100, most: int = 2000, similarity: float = 0.3) -> DataFrame:
    """(id, position, chunk) of whole texts (id, text). ``embed`` adds ``embedding`` to (id, position,
    sentence); where it has none for some sentence of a document, or has lost one, that document is cut
    into its paragraphs instead. Texts without a sentence have no chunk.

    Sentences and texts meet once, dealt by document, and ``embed`` runs once. A task holds the sentences of
    one document at a time, which came to it as one text.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(docs.dtypes)["id"]
    arrow = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    made = embed(sentences(docs)).select("id", "position", "sentence", "embedding", F.lit(None).cast("int").alias("n"), F.lit(None).cast("string").alias("only"))
    # a generator, as other uses of an array would each cut the text again
    counted = F.transform(F.array(sentence_array(F.col("text"))), lambda s: F.struct(F.size(s).alias("n"), F.when(F.size(s) == 1, s[0]).alias("only")))
    whole = docs.select("id", F.lit(-1).alias("position"), F.col("text").alias("sentence"), F.lit(None).cast(made.schema["embedding"].dataType).alias("embedding"), F.inline(F.filter(counted, lambda c: c["n"] > 0)))
    ordered = made.union(whole).repartition(parts, "id").sortWithinPartitions("id", "position")
    return ordered.select("id", "sentence", "embedding", "n", "only").mapInArrow(lambda b: _documents(b, least, most, similarity, arrow), f"id {kind}, position int, chunk string")
