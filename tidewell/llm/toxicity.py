"""Toxicity by weak supervision.

Voters are lexicon entries (words and word beginnings that the labelled training rows tie to toxic
texts) and patterns (address, shouting, stretched letters, masked words). Each votes toxic or abstains.
A generative label model explains the votes v of a text by a hidden class y:

    P(v, y) = P(y) * prod_j P(v_j | v_parent(j), y)

with a rate for each voter and class, and, where voters repeat each other more than the classes explain, a
rate for each vote of the parent: the correlated pairs form a forest. Voters that agree form a kind of the
toxic class (the insults of one language), and y is clean or one of the kinds. Expectation maximisation
raises the likelihood of the votes (with weak Beta priors on the rates) in every round; no
label enters it, and a voter that speaks alone, or often where the others are silent, weighs little. A
linear classifier is then trained on the posterior labels, and scores every document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from math import lgamma, log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import held_out
from tidewell.llm.ngram_join import shingle_set

THRESHOLD = 0.7
#: Bound of the training sample: labelled documents of either class. Their texts are read whole.
TRAIN_DOCS = 1200
#: Expected number of chance entries in the lexicon.
CHANCE = 0.05
#: A lexicon entry may be wrong: it stands in at least so many toxic texts for each other one.
RATIO = 4
PREFIXES = (4, 5, 6)
SEED, ROUNDS, STEPS = 5, 60, 3000
#: Weak Beta priors of a rate in the clean and the toxic class: a lexicon entry as if it had been silent in 20
#: clean texts of the thousand, and in toxic ones as good as nothing; of a pattern, nothing. The toxic share of
#: texts with votes, in two starts, and of those without.
LEXICON_PRIOR, PATTERN_PRIOR, SPOKEN, SILENT = ((0.02, 20.0), (0.2, 0.8)), ((0.1, 0.9), (0.1, 0.9)), (0.9, 0.99), 0.02
#: Words a worker remembers the entries of.
MEMORY_WORDS = 500_000
EDGE = "\"'.,;:!?()[]{}<>*_-#$%&/\\"

MASKED = re.compile(r"[A-Za-z][*#@$]{2,}[A-Za-z]")
#: Patterns on a text and its lower-cased form. Substring tests come before any expression.
PATTERNS: dict[str, Callable[[str, str], bool]] = {
    "address": lambda text, low: " you are a" in low or " you're a" in low or " you all " in low,
    "shout": lambda text, low: "!" in text and text.isupper(),
    "stretch": lambda text, low: any(c * 4 in low for c in "aeiou"),
    "marks": lambda text, low: "!!!" in text or "???" in text or "?!" in text,
    "masked": lambda text, low: any(c * 2 in text for c in "*#@$") and bool(MASKED.search(text)),
}


def words_of(text: str) -> set[str]:
    return {w.strip(EDGE) for w in text.lower().split()} - {""}


def terms_of(word: str) -> list[str]:
    """The word itself and its beginnings, the latter marked with a star."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n)]


def marks_of(text: str) -> list[int]:
    """Twelve minimum hashes of a text's word shingles; none without words."""
    shingles = shingle_set(text)
    return [int((shingles * np.uint64(2 * k + 0x9E3779B97F4A7C15) ^ (shingles >> np.uint64(31 - k))).min() >> np.uint64(1)) for k in range(12)] if len(shingles) else []


class Sample(NamedTuple):
    """What is kept of a labelled text: its distinct words, the patterns it shows, its marks and label."""

    words: list[set[str]]
    patterns: np.ndarray
    marks: list[list[int]]
    toxic: np.ndarray


def read_sample(texts: list[str], toxic: np.ndarray) -> Sample:
    return Sample([words_of(t) for t in texts], np.array([shown(t) for t in texts], dtype=float).reshape(len(texts), len(PATTERNS)), [marks_of(t) for t in texts], toxic)


def shown(text: str) -> list[bool]:
    low = text.lower()
    return [p(text, low) for p in PATTERNS.values()]


def distinct(marks: list[list[int]]) -> list[int]:
    """Places of texts that share no mark with an earlier one: copies would make the words of one text
    look like those of many."""
    seen: set[tuple[int, int]] = set()
    keep = []
    for i, own in enumerate(marks):
        named = set(enumerate(own))
        if not named & seen:
            keep.append(i)
        seen |= named
    return keep


def mine(words: list[set[str]], toxic: np.ndarray) -> list[str]:
    """Lexicon entries: terms that chance would hardly put into so many toxic texts and so few others."""
    has: dict[str, set[int]] = {}
    not_: Counter = Counter()
    for i, (own, t) in enumerate(zip(words, toxic, strict=True)):
        for x in {x for w in own for x in terms_of(w)}:
            if t:
                has.setdefault(x, set()).add(i)
            else:
                not_[x] += 1
    n, k = len(words), int(toxic.sum())
    if not k or k == n:
        return []

    def tail(a: int, b: int) -> float:
        """Log of the chance that all of the a + b texts with a term but b are toxic, at random."""
        m = a + b
        return lgamma(m + 1) - lgamma(a + 1) - lgamma(b + 1) + a * log(k / n)

    some = {x: tail(len(d), not_[x]) for x, d in has.items() if len(d) >= 3 and len(d) >= RATIO * not_[x]}
    limit = log(CHANCE / max(1, len(has)))
    kept: list[str] = []
    # the least likely first; of equal ones the most specific, whole words before beginnings
    for t, _, _, x in sorted((t, x.endswith("*"), -len(x), x) for x, t in some.items() if t < limit):
        # a term must find texts that related entries, its beginnings and its extensions, don't find
        stem = x.rstrip("*")
        related = [has[y] for y in kept if stem.startswith(y[:-1]) and y.endswith("*") or y.startswith(stem)]
        if len(has[x].difference(*related)) >= 3:
            kept.append(x)
    return sorted(kept)


class Voters:
    """Votes of the lexicon and of the patterns on texts."""

    def __init__(self, lexicon: list[str]):
        self.lexicon = lexicon
        self.place = {x: i for i, x in enumerate(lexicon)}
        self.known: dict[str, tuple[int, ...]] = {}
        self.size = len(lexicon) + len(PATTERNS)

    def vote(self, text: str) -> set[int]:
        known, low = self.known, text.lower()
        if len(known) > MEMORY_WORDS:
            known.clear()
        out: set[int] = set()
        for w in set(low.split()):
            hits = known.get(w)
            if hits is None:
                bare = w.strip(EDGE)
                hits = known[w] = tuple(self.place[x] for x in terms_of(bare) if x in self.place) if bare else ()
            if hits:
                out.update(hits)
        for i, p in enumerate(PATTERNS.values()):
            if p(text, low):
                out.add(len(self.lexicon) + i)
        return out

    def matrix(self, words: list[set[str]], patterns: np.ndarray) -> np.ndarray:
        m = np.zeros((len(words), self.size))
        for i, own in enumerate(words):
            m[i, [self.place[x] for w in own for x in terms_of(w) if x in self.place]] = 1
        m[:, len(self.lexicon) :] = patterns
        return m


class LabelModel:
    """The joint model of votes and hidden class. The toxic class has one or more kinds (the insults of one
    language, say), as voters that never meet say nothing against each other: ``mix[0]`` is the share of the
    clean class, ``mix[c]`` of kind c, and for voter j, kind c and vote u of its parent the rate is
    ``rates[j, c, u]`` (voters without a parent have one rate)."""

    def __init__(self, n_voters: int, lexicon: int, kinds: int = 1):
        self.mix = np.full(kinds + 1, 1 / (kinds + 1))
        named = (np.arange(n_voters) < lexicon)[:, None, None]
        which = [0] + [1] * kinds
        #: (voters, kinds and clean, a or b): the Beta priors.
        self.beta = np.where(named, np.array(LEXICON_PRIOR)[which], np.array(PATTERN_PRIOR)[which])
        self.parent = np.full(n_voters, -1)
        self.rates = np.full((n_voters, kinds + 1, 2), 0.05)

    @property
    def prior(self) -> float:
        """Share of the toxic class."""
        return float(1 - self.mix[0])

    def _parents(self, votes: np.ndarray) -> np.ndarray:
        return np.where(self.parent >= 0, votes[:, np.maximum(self.parent, 0)], 0.0)

    def log_joint(self, votes: np.ndarray) -> np.ndarray:
        """(rows, kinds and clean): log P(votes, kind)."""
        u, out = self._parents(votes), np.empty((len(votes), len(self.mix)))
        for c in range(len(self.mix)):
            rate = self.rates[:, c, 0] + u * (self.rates[:, c, 1] - self.rates[:, c, 0])
            out[:, c] = log(self.mix[c]) + np.where(votes > 0, np.log(rate), np.log1p(-rate)).sum(1)
        return out

    def shares(self, votes: np.ndarray) -> tuple[np.ndarray, float]:
        """Posterior of the clean class and of each kind, and what the rounds raise: the log-likelihood of
        the votes and the priors of the rates."""
        joint = self.log_joint(votes)
        top = joint.max(1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(joint - top).sum(1))
        own = self.beta[:, :, :1] * np.log(self.rates) + self.beta[:, :, 1:] * np.log1p(-self.rates)
        score = float(total.sum()) + float(np.log(self.mix).sum()) + float(own[:, :, 0].sum() + own[self.parent >= 0, :, 1].sum())
        return np.exp(joint - total[:, None]), score

    def expect(self, votes: np.ndarray) -> tuple[np.ndarray, float]:
        """Posterior of the toxic class, and what the rounds raise."""
        share, score = self.shares(votes)
        return share[:, 1:].sum(1), score

    def maximise(self, votes: np.ndarray, share: np.ndarray) -> None:
        """Rates and mixture for given posteriors."""
        u = self._parents(votes)
        self.mix = (share.sum(0) + 1) / (len(share) + len(self.mix))
        for c in range(len(self.mix)):
            a, b = self.beta[:, c].T
            for k, side in ((0, 1 - u), (1, u)):
                self.rates[:, c, k] = (share[:, c] @ (votes * side) + a) / (share[:, c] @ side + a + b)

    def correlations(self, votes: np.ndarray, post: np.ndarray) -> np.ndarray:
        """What two voters tell of each other inside the classes, or the kinds of (rows, kinds and clean), in
        nats: conditional mutual information."""
        return _told(votes, post if post.ndim == 2 else np.column_stack([1 - post, post]))

    def connect(self, votes: np.ndarray, share: np.ndarray) -> None:
        """The forest of the strongest correlations that pay for their further rates."""
        pays = self.correlations(votes, share) * len(votes)
        root = np.arange(len(pays))
        edges: dict[int, list[int]] = {}
        least = log(len(votes)) * (len(self.mix) / 2)
        for i, j in sorted(zip(*np.nonzero(np.triu(pays > least)), strict=True), key=lambda e: (-pays[e], e)):
            if root[i] != root[j]:
                edges.setdefault(int(i), []).append(int(j))
                edges.setdefault(int(j), []).append(int(i))
                root[root == root[j]] = root[i]
        self.parent[:] = -1
        seen: set[int] = set()
        for start in sorted(edges):
            todo = [start] if start not in seen else []
            while todo:
                at = todo.pop()
                seen.add(at)
                for other in edges[at]:
                    if other not in seen:
                        self.parent[other] = at
                        todo.append(other)


def _told(votes: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Mutual information of two voters given the kind of each row."""
    n, out = len(votes), 0.0
    for weight in share.T:
        one = weight @ votes / max(weight.sum(), 1e-9)
        both = (votes * weight[:, None]).T @ votes / max(weight.sum(), 1e-9)
        for a, b, p in ((one, one, both), (one, 1 - one, one[:, None] - both), (1 - one, one, one - both), (1 - one, 1 - one, 1 - one[:, None] - one + both)):
            p = np.maximum(p, 1e-12)
            out = out + weight.sum() / n * p * np.log(p / np.maximum(np.outer(a, b), 1e-12))
    np.fill_diagonal(out, 0)
    return out


def kinds_of(votes: np.ndarray) -> np.ndarray:
    """The kind of each voter, from 0: voters that agree more often than chance allows are of one kind.
    Voters that agree with nobody join the kind of the most voters."""
    n, k = votes.shape
    one, both = votes.mean(0), votes.T @ votes / max(1, n)
    agree = (_told(votes, np.ones((n, 1))) * n > log(max(2, n))) & (both > np.outer(one, one))
    root = np.arange(k)
    for i, j in zip(*np.nonzero(np.triu(agree)), strict=True):
        root[root == root[j]] = root[i]
    names, at, size = np.unique(root, return_inverse=True, return_counts=True)
    order = sorted(range(len(names)), key=lambda c: (-size[c], names[c]))
    place = {c: (i if size[c] > 1 else 0) for i, c in enumerate(order)}
    return np.array([place[c] for c in at], dtype=int)


def first_guess(votes: np.ndarray, kind: np.ndarray, spoken: float) -> np.ndarray:
    """Where the rounds start: texts on which a named voter speaks are likely toxic, of the kind whose
    voters say most. Nothing is held to it."""
    kinds = int(kind.max(initial=0)) + 1
    said = np.stack([votes[:, : len(kind)][:, kind == c].sum(1) for c in range(kinds)], axis=1)
    of = said == said.max(1, keepdims=True)
    toxic = np.where(said.any(1), spoken, SILENT)
    return np.column_stack([1 - toxic, of / of.sum(1, keepdims=True) * toxic[:, None]])


def label_model(votes: np.ndarray, lexicon: int | None = None, rounds: int = ROUNDS) -> tuple[np.ndarray, LabelModel, list[list[float]]]:
    """(posterior of the toxic class, model, what each round reached), from votes alone. Of the ``SPOKEN``
    starts the one that explains the votes best is kept. The first ``lexicon`` voters name the kinds."""
    lexicon = votes.shape[1] if lexicon is None else lexicon
    kind = kinds_of(votes[:, :lexicon])
    runs = [_rounds(votes, lexicon, kind, spoken, rounds) for spoken in SPOKEN]
    model, history = max(runs, key=lambda run: run[1][-1][-1])
    return model.expect(votes)[0], model, history


def _rounds(votes: np.ndarray, lexicon: int, kind: np.ndarray, spoken: float, rounds: int) -> tuple[LabelModel, list[list[float]]]:
    """Rounds of independent voters come first, then the forest of correlations is drawn and the rounds go
    on."""
    model, history = LabelModel(votes.shape[1], lexicon, int(kind.max(initial=0)) + 1), []
    share = first_guess(votes, kind, spoken)
    for step in range(2):
        if step:
            # the forest is drawn from what the first rounds found; the rounds start anew with it
            model.connect(votes, share)
            share = first_guess(votes, kind, spoken)
        model.maximise(votes, share)
        reached: list[float] = []
        for _ in range(rounds):
            share, score = model.shares(votes)
            reached.append(score)
            model.maximise(votes, share)
            if len(reached) > 1 and reached[-1] - reached[-2] < 1e-7 * abs(score):
                break
        history.append(reached)
    return model, history


def fit_linear(x: np.ndarray, y: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Logistic regression on posterior labels, by gradient steps with momentum."""
    w, b, vw, vb = np.zeros(x.shape[1]), -2.0, np.zeros(x.shape[1]), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        d = (p - y) / len(y)
        vw, vb = 0.9 * vw - 2.0 * (x.T @ d + 1e-5 * w), 0.9 * vb - 2.0 * d.sum()
        w, b = w + vw, b + vb
    return w, b


def features(votes: np.ndarray, lexicon: int) -> np.ndarray:
    """What the classifier reads: the votes, and whether the whole lexicon is silent."""
    return np.column_stack([votes, ~votes[:, :lexicon].any(1)])


def fit(sample: Sample) -> tuple[list[str], np.ndarray, float]:
    """(lexicon, weights, bias) from labelled texts. Labels choose the lexicon; the classifier learns
    from the label model's posteriors."""
    own = distinct(sample.marks)
    words, toxic = [sample.words[i] for i in own], sample.toxic[own]
    lexicon = mine(words, toxic)
    votes = Voters(lexicon).matrix(words, sample.patterns[own])
    post, _, _ = label_model(votes, len(lexicon))
    weights, bias = fit_linear(features(votes, len(lexicon)), post)
    return lexicon, weights, bias


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole texts (doc_id, toxic, text) as what a sample keeps of them."""
    for batch in batches:
        texts = [t or "" for t in batch.column(2).to_pylist()]
        cols = [pa.array([sorted(words_of(t)) for t in texts], pa.list_(pa.string())), pa.array([shown(t) for t in texts], pa.list_(pa.bool_())), pa.array([marks_of(t) for t in texts], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["doc_id", "toxic", "words", "patterns", "marks"])


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_DOCS) -> Sample:
    """About ``per_class`` labelled training documents of either class; their texts are read whole, in
    Spark's tasks, and only their distinct words, patterns and marks are collected."""
    known = labels.filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    share = F.when(F.col("toxic") == 1, per_class / max(1, counts.get(1, 1))).otherwise(per_class / max(1, counts.get(0, 1)))
    # about 2 * per_class ids: a bound that does not depend on the input; of repeated rows the least text
    picked = known.filter(draw < share).orderBy("doc_id").limit(4 * per_class)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = rows.mapInArrow(_digest, "doc_id long, toxic int, words array<string>, patterns array<boolean>, marks array<long>").collect()
    rows = sorted(rows, key=lambda r: r["doc_id"])
    patterns = np.array([r["patterns"] for r in rows], dtype=float).reshape(len(rows), len(PATTERNS))
    return Sample([set(r["words"]) for r in rows], patterns, [list(r["marks"]) for r in rows], np.array([r["toxic"] for r in rows], dtype=float))


def _score(batches: Iterable[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    lexicon, weights, bias = model.value
    voters = Voters(lexicon)
    for batch in batches:
        said = [sorted(voters.vote(t or "")) for t in batch.column(1).to_pylist()]
        logit = np.array([bias + sum(weights[i] for i in v) + (weights[-1] if not v or v[0] >= len(lexicon) else 0) for v in said], dtype=float)
        score = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Null and empty texts get the score of a text on which nobody votes. Texts of any length are read
    whole, equal texts get equal scores. Without labels nothing is learnt and every score is the same
    low one. A document with two labels counts as toxic if one says so; of repeated rows of a labelled
    id one text is learnt from, and each row is scored. No rows in, no rows out; other columns are not read.
    """
    spark = docs.sparkSession
    sample = training_sample(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), labels)
    learnt = fit(sample) if len(sample.words) else ([], np.zeros(len(PATTERNS) + 1), -4.0)
    model = spark.sparkContext.broadcast(learnt)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = slim.mapInArrow(lambda b: _score(b, model), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def op2_weak_supervision(spark, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    read = spark.read.parquet
    return score_documents(read(f"{sf_dir}/documents.parquet"), read(f"{sf_dir}/labels.parquet"))
