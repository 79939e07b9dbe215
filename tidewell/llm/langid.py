"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read as UTF-8 in windows of WINDOW bytes. A gated recurrent unit runs over each window from
either side, and a softmax on both states labels every position with a language. A document's
probabilities are the mean over all its positions. The network is trained in numpy by backpropagation
through time on a bounded sample of labelled rows; every other row is only scored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import held_out

WINDOW, HIDDEN = 64, 8
#: Bounds of the training sample: documents a language, windows a document. They bound the fit alone.
TRAIN_DOCS, TRAIN_WINDOWS = 400, 8
STEPS, BATCH, RATE, SEED = 300, 256, 0.02, 11
#: Windows that are scored together.
CHUNK = 4096
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


def windows(raw: bytes) -> np.ndarray:
    """(n, WINDOW) uint8, the last row padded with 0."""
    n = -(-len(raw) // WINDOW)
    return np.frombuffer(raw.ljust(n * WINDOW, b"\0"), dtype=np.uint8).reshape(n, WINDOW)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def initial(labels: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    h = HIDDEN
    p = {"head": rng.normal(0, 0.3, (2 * h, labels)), "bias": np.zeros(labels)}
    for way in "fb":
        p["in_" + way] = rng.normal(0, 0.5, (256, 3 * h))
        p["re_" + way] = rng.normal(0, 0.4, (h, 3 * h))
    return {k: v.astype(np.float32) for k, v in p.items()}


def _forward(table: np.ndarray, recur: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, list]:
    """States (steps, n, HIDDEN) over the columns of x, and what the way back needs."""
    h, past, states = np.zeros((len(x), HIDDEN), dtype=np.float32), [], []
    for t in range(x.shape[1]):
        g, a = table[x[:, t]], h @ recur
        gates = _sigmoid(g[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
        z, r, q = gates[:, :HIDDEN], gates[:, HIDDEN:], a[:, 2 * HIDDEN :]
        n = np.tanh(g[:, 2 * HIDDEN :] + r * q)
        past.append((h, z, r, n, q))
        h = n + z * (h - n)
        states.append(h)
    return np.stack(states), past


def _backward(recur: np.ndarray, x: np.ndarray, past: list, into: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of table and recurrence from the gradients ``into`` of all states."""
    d_recur, seen = np.zeros_like(recur), []
    dh = np.zeros_like(into[0])
    for t in range(x.shape[1] - 1, -1, -1):
        h, z, r, n, q = past[t]
        dh = dh + into[t]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * q * r * (1 - r)
        da = np.concatenate([dz, dr, dn * r], axis=1)
        d_recur += h.T @ da
        seen.append(np.concatenate([dz, dr, dn], axis=1))
        dh = dh * z + da @ recur.T
    all_ = np.concatenate(seen[::-1])
    flat = x.T.ravel()
    d_table = np.stack([np.bincount(flat, weights=all_[:, k], minlength=256) for k in range(all_.shape[1])], axis=1)
    return d_table.astype(np.float32), d_recur


def train(x: np.ndarray, y: np.ndarray, labels: int, steps: int = STEPS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Fit the network to windows x with the language y of each. Adam on the mean over positions."""
    rng = np.random.default_rng(seed)
    p = initial(labels, rng)
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        some = rng.integers(0, len(x), BATCH)
        xb, yb = x[some], y[some]
        back = xb[:, ::-1]
        sf, pf = _forward(p["in_f"], p["re_f"], xb)
        sb, pb = _forward(p["in_b"], p["re_b"], back)
        both = np.concatenate([sf, sb[::-1]], axis=2)
        logits = both @ p["head"] + p["bias"]
        prob = np.exp(logits - logits.max(2, keepdims=True))
        prob /= prob.sum(2, keepdims=True)
        d = prob
        d[:, np.arange(len(yb)), yb] -= 1
        d *= ((xb.T != 0)[:, :, None] / max(1, (xb != 0).sum())).astype(np.float32)
        into = d @ p["head"].T
        g = {"head": np.tensordot(both, d, ([0, 1], [0, 1])), "bias": d.sum((0, 1))}
        g["in_f"], g["re_f"] = _backward(p["re_f"], xb, pf, into[:, :, :HIDDEN])
        g["in_b"], g["re_b"] = _backward(p["re_b"], back, pb, into[::-1, :, HIDDEN:])
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1))) * min(1.0, 1.0 / max(norm, 1e-6))
        for k in p:
            first[k] = 0.9 * first[k] + 0.1 * g[k]
            second[k] = 0.99 * second[k] + 0.01 * g[k] ** 2
            p[k] -= RATE * (rate / RATE) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return p


class Scorer:
    """The trained network, laid out for many windows at a time."""

    def __init__(self, p: dict[str, np.ndarray]):
        h = HIDDEN
        half = np.ones((3 * h, 1), dtype=np.float32)
        half[: 2 * h] = 0.5  # sigmoid(x) = tanh(x / 2) / 2 + 1 / 2
        self.ways = [(np.ascontiguousarray(p["in_" + w].T) * half, np.ascontiguousarray(p["re_" + w].T) * half, np.ascontiguousarray(part.T)) for w, part in (("f", p["head"][:h]), ("b", p["head"][h:]))]
        self.bias = p["bias"][:, None]

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (labels, n) summed over the positions of each window that hold a byte."""
        cols = np.ascontiguousarray(x.T.astype(np.intp))
        steps, n, h = len(cols), len(x), HIDDEN
        logits = np.empty((steps, len(self.bias), n), dtype=np.float32)
        a, g = np.empty((3 * h, n), dtype=np.float32), np.empty((3 * h, n), dtype=np.float32)
        for back, (table, recur, head) in enumerate(self.ways):
            state = np.zeros((h, n), dtype=np.float32)
            for t in range(steps - 1, -1, -1) if back else range(steps):
                np.take(table, cols[t], axis=1, out=g, mode="clip")
                np.matmul(recur, state, out=a)
                gates = g[: 2 * h]
                gates += a[: 2 * h]
                np.tanh(gates, out=gates)
                gates += 1
                gates *= 0.5
                new, q = g[2 * h :], a[2 * h :]
                q *= gates[h:]
                new += q
                np.tanh(new, out=new)
                state -= new
                state *= gates[:h]
                state += new
                if back:
                    logits[t] += head @ state
                else:
                    np.matmul(head, state, out=logits[t])
        logits += self.bias
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        logits *= (cols != 0)[:, None] / logits.sum(1, keepdims=True)
        return logits.sum(0)

    def documents(self, texts: list[str]) -> np.ndarray:
        """(documents, labels): mean probabilities over all positions; zeros without bytes."""
        raw = [t.encode("utf-8").replace(b"\0", b" ") for t in texts]
        sizes = np.array([-(-len(r) // WINDOW) for r in raw])
        out = np.zeros((len(raw), len(self.bias)))
        if not sizes.sum():
            return out
        x = np.concatenate([windows(r) for r in raw if r])
        owner = np.repeat(np.arange(len(raw)), sizes)
        for lo in range(0, len(x), CHUNK):
            np.add.at(out, owner[lo : lo + CHUNK], self.positions(x[lo : lo + CHUNK]).T)
        return out / np.maximum(1, np.array([len(r) for r in raw]))[:, None]


def training_sample(docs: DataFrame, per_language: int = TRAIN_DOCS) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows, labels and the languages, from about ``per_language`` training documents of each."""
    seen = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in seen.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), []
    share = F.create_map(*[F.lit(x) for k, v in counts.items() for x in (k, per_language / v)])
    draw = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    size = WINDOW * TRAIN_WINDOWS
    start = F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id"), F.greatest(F.length("text") - size, F.lit(0)) + 1) + 1
    picked = seen.filter(draw < share[F.col("lang")]).limit(2 * per_language * len(langs)).select("doc_id", "lang", F.substring(F.col("text"), start.cast("int"), F.lit(size)).alias("text")).collect()
    picked = sorted(picked, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"]))
    xs, ys = [], []
    for r in picked:
        w = windows(r["text"].encode("utf-8").replace(b"\0", b" "))[:TRAIN_WINDOWS]
        xs.append(w)
        ys.append(np.full(len(w), langs.index(r["lang"])))
    if not xs:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), langs
    x, y = np.concatenate(xs), np.concatenate(ys)
    # every language as often as the largest
    most = np.bincount(y, minlength=len(langs)).max()
    index = np.concatenate([np.resize(np.flatnonzero(y == k), most) for k in range(len(langs)) if (y == k).any()])
    return x[index], y[index], langs


def _predict(batches: Iterable[pa.RecordBatch], model, langs: list[str]) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(model.value)
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            some = batch.slice(lo, 256)
            texts = [t or "" for t in some.column("text").to_pylist()]
            prob = scorer.documents(texts)
            best = prob.argmax(1)
            known = [bool(LETTER.search(t)) for t in texts]
            lang = [langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            score = np.where(known, np.clip(prob[np.arange(len(best)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([some.column(i) for i in range(some.num_columns)] + [pa.array(lang), pa.array(score)], [*some.schema.names, "lang_pred", "score"])


def identify(docs: DataFrame, steps: int = STEPS) -> DataFrame:
    """docs with lang_pred and score (which replace columns of these names).

    Null texts and texts without a letter are ``und`` with score 0, and so is every row where no row can
    be learnt from. Texts of any length are read whole; equal texts get equal predictions. No rows in, no
    rows out.
    """
    spark = docs.sparkSession
    docs = docs.drop("lang_pred", "score")
    x, y, langs = training_sample(docs)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema)}, lang_pred string, score double"
    if not len(x):
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    model = spark.sparkContext.broadcast(train(x, y, len(langs), steps))
    return docs.mapInArrow(lambda b: _predict(b, model, langs), schema)


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs without those whose language cannot be told (``und``)."""
    return identify(docs).filter(F.col("lang_pred") != UNKNOWN).select(*docs.columns)


def op4_byte_gru(spark, sf_dir: str) -> DataFrame:
    """The language of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
