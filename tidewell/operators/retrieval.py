"""Exact, hybrid and filtered top-k search, lexical ranking, and chunking of texts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import text as tx
from tidewell.functions import vectors as vx


def index_options(kind: str = "hnsw", dim: int = 0, m: int = 0, ef: int = 0, lists: int = 0) -> dict[str, int | str]:
    """Settings of an approximate index: what is not positive takes its usual value, any other kind than
    ivfflat is hnsw."""
    return {"kind": "ivfflat" if kind.lower() == "ivfflat" else "hnsw", "dim": dim if dim > 0 else 1536, "m": m if m > 0 else 16, "ef_construction": ef if ef > 0 else 64, "lists": lists if lists > 0 else 100}


def bucket_code(vector: Column, dim: int, bits: int, seed: int = 11) -> Column:
    """Signs of the products with ``bits`` fixed random directions, as a number."""
    planes = np.random.default_rng([seed, dim, bits]).standard_normal((bits, dim)).round(4).tolist()
    sides = [F.when(vx.dot(vector, vx.literal(p)) >= 0, 1 << j).otherwise(0) for j, p in enumerate(planes)]
    return reduce(lambda a, b: a + b, sides).cast("long")


def near_top_k(vectors: DataFrame, query: list[float], k: int = 5, where: Column | None = None, bits: int = 8, radius: int = 3, after: bool = True) -> DataFrame:
    """About the k best rows (key, embedding) by cosine: buckets whose code differs from the query's in
    ``radius`` bits at most are scored exactly. By default the filter comes after the top k, so fewer than
    k rows may be left. A radius of ``bits`` scores all buckets."""
    dim = len(query)
    rows = vectors if where is None or after else vectors.filter(where)
    far = F.bit_count(bucket_code(F.col("embedding"), dim, bits).bitwiseXOR(bucket_code(vx.literal(query), dim, bits)))
    best = rows.filter(far <= radius).withColumn("score", vx.cosine(F.col("embedding"), vx.literal(query))).orderBy(F.desc("score"), "key").limit(k if k > 0 else 5)
    return best if where is None or not after else best.filter(where)


def term_rank(text: Column, query: str) -> Column:
    """Rank of a text by how often each of the query's words stands in it, each further time for less; the
    mean over the query's words."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{Nd}]+")
    asked = sorted(set(query.lower().split()))
    n = lambda w: F.size(F.filter(words, lambda t: t == w))
    part = lambda w: F.when(n(w) > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n(w), F.lit(1))), F.lit(0.0), lambda a, i: a + 0.1 / (i * i)) / 1.64493406685).otherwise(0.0)
    return reduce(lambda a, b: a + b, [part(w) for w in asked]) / len(asked) if asked else F.lit(0.0)


def reranked(hits: DataFrame, ranks: DataFrame, k: int, key: str = "key") -> DataFrame:
    """The k best hits (position from 0, ...) in the order of ranks (index, rank): places out of range are
    left out, and without any rank the hits stay in their order."""
    n = hits.join(F.broadcast(ranks), F.col("position") == F.col("index"), "left")
    some = F.max(F.col("rank").isNotNull()).over(Window.partitionBy(F.lit(1)))
    # hits are the few rows of a top k
    return n.withColumn("_some", some).filter("rank is not null or not _some").orderBy(F.desc_nulls_last("rank"), "position").limit(k).select(*hits.columns)


def rendered(hits: DataFrame, corpus: str) -> DataFrame:
    """(text): the hits (position, score, filename, chunk, text) of one answer as a text."""
    head = F.format_string("[%d] score=%.4f", F.col("position") + 1, F.col("score"))
    named = F.concat(head, F.when(F.col("filename") != "", F.concat(F.lit("  file="), "filename")).otherwise(""), F.when(F.col("chunk") != "", F.concat(F.lit("  chunk="), "chunk")).otherwise(""), F.lit("\n"), F.col("text"))
    rows = hits.agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("position", named.alias("said")))).alias("rows"))
    body = F.concat(F.lit(f"Corpus: {corpus} — "), F.col("n").cast("string"), F.lit(" result(s)\n\n"), F.array_join(F.transform("rows", lambda r: r["said"]), "\n\n"))
    return rows.select(F.when(F.col("n") == 0, f'No results found in corpus "{corpus}".').otherwise(body).alias("text"))


def metadata_filter(conditions: dict[str, str | list[str]], metadata: str = "metadata") -> Column:
    """All conditions hold: equality, or membership for a list. A missing key counts as empty text."""
    value = lambda k: F.coalesce(F.col(metadata)[k], F.lit(""))
    tests = [value(k).isin(*v) if isinstance(v, list) else value(k) == v for k, v in conditions.items()]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def top_k(vectors: DataFrame, query: list[float], k: int = 5, key: str = "key", where: Column | None = None) -> DataFrame:
    """The k best rows by cosine, filtered first; ties by key."""
    k = k if k > 0 else 5
    rows = vectors if where is None else vectors.filter(where)
    return rows.withColumn("score", vx.cosine(F.col("embedding"), vx.literal(query))).orderBy(F.desc("score"), key).limit(k)


#: Vectors and queries of a cell, numbers of a block of products.
CELL_ROWS, CELL_QUERIES, BLOCK_NUMBERS = 1 << 14, 1 << 12, 1 << 20


def _by_size(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """size: (places, values (n, size)) of the vectors without nulls."""
    arr = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    sizes = np.asarray(pc.fill_null(pc.list_value_length(arr), 0).to_numpy(zero_copy_only=False))
    if arr.flatten().null_count:
        whole = np.array([v is not None and None not in v for v in arr.to_pylist()], dtype=bool)
        sizes = np.where(whole, sizes, 0)
    out = {}
    for size in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == size)
        out[size] = at, arr.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    return out


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of the rows, summed in the order of their numbers as vx.dot sums them."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += x[:, j] * y[:, j]
    return total


def _likely(q: np.ndarray, v: np.ndarray, qn: np.ndarray, vn: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, row) pairs that hold the k best rows of each query and whatever is as good, in blocks. Products
    of matrices find them, with a margin beyond their rounding; vectors of odd sizes are all returned."""
    both = np.concatenate([qn, vn])
    plain = bool(((both == 0) | (both > 1e-100) & (both < 1e100)).all()) and len(v) > k
    unit = v / np.where(vn > 0, vn, 1)[:, None] if plain else v
    step = max(1, BLOCK_NUMBERS // len(v))
    for lo in range(0, len(q), step):
        if plain:
            n = qn[lo : lo + step]
            near = (q[lo : lo + step] / np.where(n > 0, n, 1)[:, None]) @ unit.T
            bar = np.partition(near, len(v) - k, axis=1)[:, len(v) - k]
            i, j = np.nonzero(near >= bar[:, None] - 1e-9)
        else:
            i, j = (x.ravel() for x in np.indices((min(step, len(q) - lo), len(v))))
        yield i + lo, j


def _best_of_cell(asked: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """(qid, key, score): the k best rows for each query, by vx.cosine, then by key."""
    order = np.empty(rows.num_rows, dtype=np.int64)
    order[pc.sort_indices(rows.column("key"), null_placement="at_start").to_numpy()] = np.arange(rows.num_rows)
    vectors, found = _by_size(rows.column("embedding")), []

    def keep(i: np.ndarray, j: np.ndarray, score: np.ndarray) -> None:
        by = np.lexsort((order[j], np.where(np.isnan(score), -np.inf, -score), i))
        i, j, score = i[by], j[by], score[by]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        found.append((i[nth < k], j[nth < k], score[nth < k]))

    fitted = np.zeros(asked.num_rows, dtype=bool)
    lowest = np.argsort(order)
    for size, (at, q) in _by_size(asked.column("q")).items():
        if size not in vectors:
            continue
        fitted[at] = True
        place, v = vectors[size]
        qn, vn = np.sqrt(_dots(q, q)), np.sqrt(_dots(v, v))
        for i, j in _likely(q, v, qn, vn, k):
            with np.errstate(all="ignore"):
                scale = qn[i] * vn[j]
                score = np.where(scale <= 0, 0.0, _dots(q[i], v[j]) / np.where(scale <= 0, 1.0, scale))
            keep(at[i], place[j], score)
        rest = lowest[~np.isin(lowest, place)][:k]
        found.append((np.repeat(at, len(rest)), np.tile(rest, len(at)), np.zeros(len(at) * len(rest))))
    # no vector has the size of these queries: all rows score 0
    rest, first = np.flatnonzero(~fitted), lowest[:k]
    found.append((np.repeat(rest, len(first)), np.tile(first, len(rest)), np.zeros(len(rest) * len(first))))
    i, j, score = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.table({"qid": asked.column("qid").take(pa.array(i, pa.int64())), "key": rows.column("key").take(pa.array(j, pa.int64())), "score": pa.array(score, pa.float64())})


def batched_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k best rows of its namespace for every query (qid, namespace, q). Vectors and queries are dealt into
    cells by namespace and parts of their own keys, so a large namespace is shared by many tasks, and a task
    holds CELL_ROWS vectors and CELL_QUERIES queries or so; in a cell, products of blocks find the pairs that
    are scored. The cells' winners are merged."""
    rows, asked = vectors.select("namespace", "key", "embedding").filter("namespace is not null"), queries.select("namespace", "qid", "q")
    across, down = (-(-max(1, n) // most) for n, most in ((vectors.count(), CELL_ROWS), (queries.count(), CELL_QUERIES)))
    dealt = lambda df, name, n, other, m: df.withColumns({name: F.pmod(F.xxhash64(df.columns[1]), F.lit(n)), other: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))}).withColumns({c: F.col(c).cast("int") for c in (name, other)})
    cells = [dealt(asked, "_down", down, "_across", across), dealt(rows, "_across", across, "_down", down)]
    kinds = dict(asked.dtypes) | dict(rows.dtypes)
    left, right = (c.groupBy("namespace", "_across", "_down") for c in cells)
    local = left.cogroup(right).applyInArrow(lambda a, r: _best_of_cell(a, r, k), f"qid {kinds['qid']}, key {kinds['key']}, score double")
    final = Window.partitionBy("qid").orderBy(F.desc("score"), "key")
    return local.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k)


def bm25(docs: DataFrame, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of the documents (id, text) with a positive Okapi BM25 score. A repeated query term
    counts as often as it stands there. Each text is cut into terms once: what is kept of it is its
    length and how often each of the query's terms, a handful, stands in it."""
    spark = docs.sparkSession
    asked: dict[str, int] = {}
    for t in spark.range(1).select(tx.lexical_tokens(F.lit(query)).alias("t")).first()["t"]:
        asked[t] = asked.get(t, 0) + 1
    t = F.col("_term")
    parts = docs.select("id", F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{Nd}]+")).alias("_term"))
    # partial counts leave each map task with one row a document, which both branches below read
    counts = [F.count_if(t == w).alias(f"_tf{i}") for i, w in enumerate(asked)]
    held = parts.groupBy("id").agg(F.count_if((F.octet_length(t) >= 2) & ~t.isin(*tx.STOP_WORDS)).alias("len"), *counts)
    dfs = [F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(asked))]
    stats = held.agg(F.count("*").alias("_n"), F.avg("len").alias("_avg"), *dfs)
    # one row of a few numbers
    joined = held.filter(reduce(lambda a, c: a | c, [F.col(f"_tf{i}") > 0 for i in range(len(asked))], F.lit(False))).crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for i, times in enumerate(asked.values()):
        idf = F.log((F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5) + 1)
        tf = F.col(f"_tf{i}")
        score = score + times * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("_avg")))
    return joined.select("id", score.alias("score")).filter("score > 0")


def hybrid(vectors: DataFrame, lexical: DataFrame, query: list[float], weight: float, k: int) -> DataFrame:
    """Cosine and scaled lexical scores blended before the top k. Misses score 0; without any lexical
    score the vectors decide alone."""
    w = min(max(weight, 0.0), 1.0)
    best = lexical.agg(F.max("score").alias("_best"))
    scored = vectors.withColumn("cos", vx.cosine(F.col("embedding"), vx.literal(query))).join(lexical.select(F.col("id").alias("key"), F.col("score").alias("_lex")), "key", "left")
    # one row, null where nothing matched
    scored = scored.crossJoin(F.broadcast(best))
    blend = F.lit(1 - w) * F.col("cos") + F.lit(w) * F.coalesce(F.col("_lex") / F.col("_best"), F.lit(0.0))
    return scored.withColumn("score", F.when(F.col("_best").isNull(), F.col("cos")).otherwise(blend)).drop("_lex", "_best").orderBy(F.desc("score"), "key").limit(k)


def keyword_share(text: Column, query: str) -> Column:
    """Share of the query's words that the text contains, case-folded."""
    words = query.lower().split()
    if not words:
        return F.lit(0.0)
    low = F.lower(text)
    return reduce(lambda a, c: a + c, [low.contains(w).cast("int") for w in words]) / len(words)


def paragraphs(docs: DataFrame, text: Column) -> DataFrame:
    """Trimmed, non-empty paragraphs of each document with dense positions from 0."""
    parts = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n\n")
    kept = F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    return docs.select("*", F.posexplode(kept).alias("position", "chunk"))


def hard_cut(text: str, most: int) -> list[str]:
    """Pieces of at most ``most`` bytes, each trimmed; a character is never split."""
    raw, out = text.strip().encode("utf-8"), []
    while len(raw) > most:
        at = most
        while at > 0 and raw[at] & 0xC0 == 0x80:
            at -= 1
        at = at or most
        out.append(raw[:at].decode("utf-8", "ignore").strip())
        raw = raw[at:].strip()
    out.append(raw.decode("utf-8", "ignore"))
    return [p for p in out if p]


def word_cut(text: str, most: int) -> list[str]:
    """Pieces of whole words, at most ``most`` bytes each where the words allow it."""
    out, held, size = [], [], 0
    for w in text.split():
        n = len(w.encode("utf-8"))
        if held and size + n + 1 > most:
            out.append(" ".join(held))
            held, size = [], 0
        size += n + bool(held)
        held.append(w)
    return [*out, " ".join(held)] if held else out


def paragraph_cut(text: str | None, most: int) -> list[str]:
    """The paragraphs of a text, in pieces of at most ``most`` bytes."""
    return [c for p in (text or "").replace("\r\n", "\n").split("\n\n") for c in hard_cut(p, most)]


def embed(texts: DataFrame, text: str = "text", dim: int = 64, batch: int = 64) -> DataFrame:
    """texts with ``embedding``: hashed word counts of unit length, batch by batch in the order of the rows;
    every batch must come back whole and of the right size. Null and wordless texts are zero vectors."""
    def one(words: list[str]) -> np.ndarray:
        v = np.zeros(dim, dtype=np.float32)
        for w in words:
            h = zlib.crc32(w.encode("utf-8"))
            v[h % dim] += 1 if h >> 16 & 1 else -1
        size = np.linalg.norm(v)
        return v / size if size else v

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out: list = []
            for lo in range(0, len(part), batch):
                some = part.iloc[lo : lo + batch]
                vectors = [one((t or "").lower().split()) for t in some]
                if len(vectors) != len(some) or any(len(v) != dim for v in vectors):
                    raise ValueError("embeddings do not fit their texts")
                out += vectors
            yield pd.Series(out)

    return texts.withColumn("embedding", run(F.col(text)))


def capped_paragraphs(docs: DataFrame, most: int = 800) -> DataFrame:
    """(id, position, chunk): paragraphs of (id, text), none longer than ``most`` bytes."""
    def cut(batches):
        for pdf in batches:
            rows = []
            for name, text in zip(pdf["id"], pdf["text"], strict=True):
                rows += [(name, i, c) for i, c in enumerate(paragraph_cut(text, most))]
            yield pd.DataFrame(rows, columns=["id", "position", "chunk"])

    return docs.select("id", "text").mapInPandas(cut, "id long, position int, chunk string")


def sentence_array(text: Column) -> Column:
    """Parts that end in . ! or ? before a blank or a line end, or at a blank line, without white space
    around; parts with fewer than three bytes besides punctuation and white space are left out. Null
    texts have none."""
    lines = F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n"))
    # what most parts show at once is asked first: no white space at their ends, a word of three signs
    blank = lambda c: c.rlike(r"(?U)\s")
    trim = lambda s: F.when(blank(F.left(s, F.lit(1))) | blank(F.right(s, F.lit(1))), F.regexp_replace(s, r"(?U)^\s+|\s+$", "")).otherwise(s)
    parts = F.transform(F.split(lines, r" (?<=[.!?] )|(?=\n)(?<=[.!?])|\n\n"), trim)
    return F.filter(parts, lambda s: s.rlike("[0-9A-Za-z]{3}") | (F.octet_length(F.regexp_replace(s, r"(?U)[\p{P}\s]", "")) >= 3))


def sentences(docs: DataFrame) -> DataFrame:
    """(id, position, sentence) of texts (id, text), cut as sentence_array cuts them."""
    return docs.select("id", F.posexplode(sentence_array(F.col("text"))).alias("position", "sentence"))


def semantic_chunks(sentences_: DataFrame, least: int = 100, most: int = 2000, similarity: float = 0.3) -> DataFrame:
    """(id, position, chunk): sentences (id, position, sentence, embedding) joined until the next one
    differs and the chunk is long enough, or would be too long. The length feeds back into the decision,
    so each document is walked in order."""
    def walk(said: list[str], embeddings: list) -> list[str]:
        if len(said) > 1 and any(e is None for e in embeddings):
            # without an embedding for each sentence the paragraphs of the text stand in
            return hard_cut(" ".join(said), most)
        chunks, held, size, last = [], [], 0, None
        for s, e in zip(said, embeddings, strict=True):
            n, e = len(s.encode("utf-8")), np.asarray(e, dtype=float)
            if held:
                scale = float(np.linalg.norm(last) * np.linalg.norm(e))
                near = float(last @ e) / scale if scale else 0.0
                if near < similarity and size >= least or size + n > most:
                    chunks.append(" ".join(held))
                    held, size = [], 0
            size += n + bool(held)
            held.append(s)
            last = e
        if held:
            chunks.append(" ".join(held))
        return [p for c in chunks for p in (word_cut(c, most) if len(c.encode("utf-8")) > most else [c])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, said, embeddings = None, [], []

        def rows(done: list[tuple]) -> pa.RecordBatch:
            flat = [(i, nth, c) for i, chunks in done for nth, c in enumerate(chunks)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*flat), (pa.int64(), pa.int32(), pa.string()), strict=True)], ["id", "position", "chunk"])

        for batch in batches:
            done = []
            for i, s, e in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if said and i != name:
                    done.append((name, walk(said, embeddings)))
                    said, embeddings = [], []
                name = i
                said.append(s)
                embeddings.append(e)
            if any(c for _, c in done):
                yield rows(done)
        if said and (last := walk(said, embeddings)):
            yield rows([(name, last)])

    # documents follow each other in a task, so a document costs no call of its own
    parts = int(sentences_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = sentences_.select("id", "position", "sentence", "embedding").repartition(parts, "id").sortWithinPartitions("id", "position")
    return ordered.select("id", "sentence", "embedding").mapInArrow(run, "id long, position int, chunk string")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both, the last written of each key: new ones win, and among new ones the largest ``version``."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc("version"))
    return both.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", "_new")
