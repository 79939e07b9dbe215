"""Language ID, toxicity, language-model scores and media columns."""

import hashlib
import os
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewell.llm import langid, lm_scoring, media, toxicity
from tidewell.llm.common import held_out


def _spoken(n=240):
    rng = np.random.default_rng(8)
    syllables = {"en": ["the", "ing", "wh", "oo", "st"], "de": ["sch", "ei", "ung", "ä", "tz"], "fr": ["eau", "é", "que", "oi", "ê"]}
    rows = []
    for i in range(n):
        lang = ["en", "de", "fr"][i % 3]
        words = ["".join(rng.choice(syllables[lang], rng.integers(1, 4))) for _ in range(rng.integers(8, 60))]
        rows.append((i, " ".join(words), lang))
    return rows


def test_network_gradients_are_right():
    rng = np.random.default_rng(0)
    x = rng.integers(1, 256, (3, 5)).astype(np.uint8)
    table, recur = rng.normal(0, 0.5, (256, 3 * langid.HIDDEN)), rng.normal(0, 0.5, (langid.HIDDEN, 3 * langid.HIDDEN))
    into = rng.normal(size=(5, 3, langid.HIDDEN))
    value = lambda t, r: float((langid._forward(t.astype(np.float64), r.astype(np.float64), x)[0] * into).sum())
    _, past = langid._forward(table, recur, x)
    d_table, d_recur = langid._backward(recur, x, past, into)
    for k in ((0, 0), (3, 9), (5, 20)):
        up, down = recur.copy(), recur.copy()
        up[k] += 1e-3
        down[k] -= 1e-3
        assert d_recur[k] == pytest.approx((value(table, up) - value(table, down)) / 2e-3, rel=2e-2, abs=1e-3)
    k = (int(x[0, 2]), 4)
    up, down = table.copy(), table.copy()
    up[k] += 1e-3
    down[k] -= 1e-3
    assert d_table[k] == pytest.approx((value(up, recur) - value(down, recur)) / 2e-3, rel=2e-2, abs=1e-3)


def test_languages_are_told_apart(spark, odd_docs, no_docs):
    df = spark.createDataFrame(_spoken(), "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    out = langid.identify(df, steps=80).withColumn("held", held_out(F.col("doc_id"))).collect()
    held = [r for r in out if r.held]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.9 and all(0 <= r.score <= 1 for r in out)
    odd = langid.identify(odd_docs, steps=3).collect()
    assert len(odd) == odd_docs.count()
    assert {r.doc_id for r in odd if r.lang_pred == "und"} == {2, 3, 4, 5}
    assert langid.identify(no_docs).count() == 0
    assert langid.keep_identified(odd_docs.filter("doc_id in (2, 3)")).count() == 0


def test_batches_equal_single_windows():
    p = langid.initial(3, np.random.default_rng(1))
    scorer = langid.Scorer(p)
    texts = ["abc", "é" * 100, "", "word " * 50]
    together = scorer.documents(texts)
    assert np.allclose(together, np.concatenate([scorer.documents([t]) for t in texts]), atol=1e-5)
    assert np.allclose(together.sum(1), [1, 1, 0, 1], atol=1e-4)


def test_toxicity_on_held_out_documents(spark, odd_docs, no_docs):
    rng = np.random.default_rng(3)
    bad, good = ["scumbag", "vexxor", "grubbit"], [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(500):
        words = list(rng.choice(good, 40)) + (list(rng.choice(bad, 3)) if i % 4 == 0 else [])
        rows.append((i, " ".join(rng.permutation(words))))
        labels.append((i, 1, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.score_documents(docs, known).collect()}
    held = [r for r in out.values() if r.held_out]
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in held) and all(0 <= r.score <= 1 for r in out.values())
    assert toxicity.score_documents(odd_docs, known).count() == odd_docs.count()
    assert toxicity.score_documents(no_docs, known).count() == 0
    assert toxicity.score_documents(docs, known.limit(0)).filter("predicted = 1").count() == 0


def _votes(n=4000, seed=6):
    """Votes of six voters by class, and one more that repeats the first."""
    rng = np.random.default_rng(seed)
    y = rng.random(n) < 0.3
    rates = ((0.8, 0.01), (0.7, 0.02), (0.6, 0.05), (0.5, 0.01), (0.6, 0.03), (0.7, 0.02))
    votes = np.stack([np.where(y, rng.random(n) < a, rng.random(n) < b) for a, b in rates], axis=1).astype(float)
    again = np.where(rng.random(n) < 0.95, votes[:, 0], rng.random(n) < 0.1)
    return y, np.column_stack([votes, again]), rates


def test_label_model_raises_its_likelihood_and_finds_the_rates(monkeypatch):
    monkeypatch.setattr(toxicity, "LEXICON_PRIOR", ((0.1, 1.0), (0.1, 1.0)))
    y, votes, rates = _votes()
    post, model, history = toxicity.label_model(votes)
    assert all(b >= a - 1e-7 * abs(a) for phase in history for a, b in zip(phase, phase[1:]))
    known = np.log(0.3 / 0.7) + sum(np.where(votes[:, j] > 0, np.log(a / b), np.log((1 - a) / (1 - b))) for j, (a, b) in enumerate(rates))
    assert ((post > 0.5) == y).mean() > ((known > 0) == y).mean() - 0.01 and model.prior == pytest.approx(0.3, abs=0.03)
    pairs = {frozenset((i, int(j))) for i, j in enumerate(model.parent) if j >= 0}
    assert frozenset((0, 6)) in pairs
    for j in range(1, 6):
        if model.parent[j] < 0:
            assert model.rates[j, 1, 0] == pytest.approx(rates[j][0], abs=0.06) and model.rates[j, 0, 0] == pytest.approx(rates[j][1], abs=0.03)
    corr = model.correlations(votes, post)
    assert corr[0, 6] > 10 * corr[1, 2]


def test_label_model_posterior_equals_the_joint_table(monkeypatch):
    _, votes, _ = _votes(600)
    post, model, _ = toxicity.label_model(votes)
    total = 0.0
    for code in range(128):
        v = np.array([float(code >> j & 1) for j in range(7)])
        p = []
        for y in (0, 1):
            q = model.prior if y else 1 - model.prior
            for j in range(7):
                k = int(v[model.parent[j]]) if model.parent[j] >= 0 else 0
                r = model.rates[j, y, k]
                q *= r if v[j] else 1 - r
            p.append(q)
        total += sum(p)
        rows = (votes == v).all(1)
        assert np.allclose(post[rows], p[1] / sum(p), atol=1e-9)
    assert total == pytest.approx(1.0)


def test_label_model_learns_which_voters_are_often_wrong():
    rng = np.random.default_rng(8)
    y = rng.random(4000) < 0.3
    rates = ((0.8, 0.02), (0.7, 0.30), (0.6, 0.05), (0.7, 0.10), (0.6, 0.03), (0.7, 0.20), (0.8, 0.02))
    votes = np.stack([np.where(y, rng.random(4000) < a, rng.random(4000) < b) for a, b in rates], axis=1).astype(float)
    post, model, _ = toxicity.label_model(votes)
    assert len(model.mix) == 2 and model.prior == pytest.approx(0.3, abs=0.03)
    assert ((post > 0.5) == y).mean() > 0.97 and (votes.any(1) == y).mean() < 0.75
    for j in range(7):
        if model.parent[j] < 0:
            assert model.rates[j, :, 0] == pytest.approx(rates[j][::-1], abs=0.05)


def test_label_model_parts_kinds_of_voters_that_never_meet():
    rng = np.random.default_rng(9)
    kind = rng.choice(3, 3000, p=(0.7, 0.2, 0.1))
    own = np.repeat([1, 2], 10)
    votes = np.stack([rng.random(3000) < np.where(kind == k, 0.5, 0.02) for k in own], axis=1).astype(float)
    assert [len(set(g)) for g in np.split(toxicity.kinds_of(votes), 2)] == [1, 1]
    post, model, history = toxicity.label_model(votes)
    assert len(model.mix) == 3 and model.mix == pytest.approx([0.7, 0.2, 0.1], abs=0.04)
    assert ((post > 0.5) == (kind > 0)).mean() > (votes.any(1) == (kind > 0)).mean() + 0.2
    assert all(b >= a - 1e-7 * abs(a) for phase in history for a, b in zip(phase, phase[1:]))


def test_a_fit_on_labelled_texts_beats_the_or_of_its_lexicon():
    rng = np.random.default_rng(10)
    rates = ((0.7, 0.02), (0.7, 0.04), (0.6, 0.06), (0.8, 0.08), (0.6, 0.10), (0.7, 0.02), (0.6, 0.05))
    names = ["scum", "vexx", "grub", "moro", "trsh", "clwn", "losr"]

    def texts(n):
        y = rng.random(n) < 0.5
        own = [[w for w, (a, b) in zip(names, rates) if rng.random() < (a if t else b)] for t in y]
        return [" ".join(rng.permutation([*(f"w{k}" for k in rng.integers(0, 400, 30)), *o])) for o in own], y

    train, y = texts(1600)
    lexicon, weights, bias = toxicity.fit(toxicity.read_sample(train, y.astype(float)))
    assert {x for x in lexicon if not x.endswith("*")} >= set(names)
    seen, truth = texts(2000)
    out = next(toxicity._score([pa.RecordBatch.from_pydict({"doc_id": list(range(2000)), "text": seen})], SimpleNamespace(value=(lexicon, weights, bias))))
    score, voters = np.array(out.column(1)), toxicity.Voters(lexicon)
    either = np.array([any(v < len(lexicon) for v in voters.vote(t)) for t in seen])
    assert ((score >= 0.5) == truth).mean() > 0.96 and (either == truth).mean() < 0.9


def test_long_labelled_texts_are_read_whole(spark):
    bad = ["scumbag", "vexxor", "grubbit"]
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 300, 4000 if i < 20 else 40)) + (" " + " ".join(bad) if i % 4 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    sample = toxicity.training_sample(docs, labels)
    assert all(set(bad) <= w for w, t in zip(sample.words, sample.toxic, strict=True) if t)


def test_pseudo_likelihood(spark, odd_docs, no_docs):
    rows = [(i, " ".join(["red", "fox", "runs", "far"] * 30)) for i in range(60)] + [(100, "far red runs fox " * 30), (101, "zyx " * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = {r.doc_id: r for r in lm_scoring.score_documents(docs).collect()}
    assert out[0].mean_pll > out[100].mean_pll and out[0].n_words == 120 and out[0].pll == pytest.approx(out[1].pll, rel=1e-4)
    odd = {r.doc_id: r for r in lm_scoring.score_documents(odd_docs).collect()}
    assert odd[2].pll == 0 and odd[3].mean_pll is None and len(odd) == len({r.doc_id for r in odd_docs.collect()})
    assert lm_scoring.score_documents(no_docs).count() == 0


def test_probabilities_of_all_words_sum_to_one_and_texts_to_their_words():
    book = lm_scoring.Words([b"a", b"b", b"c"], np.array([5.0, 3.0, 2.0]), 4.0)
    p = lm_scoring.initial(book)
    words = [b"a", b"c", b"zz", b"b"]
    ids = book.ids(words)
    around = lm_scoring.contexts(ids, book.edge)
    g, _, _ = lm_scoring.gates(p, around)
    assert np.allclose((g @ p["part"].T).sum(1), 1, atol=1e-5)
    total = 0.0
    for i, w in enumerate(words):
        near = [book.edge if not 0 <= j < 4 else ids[j] for j in (i - 2, i - 1, i + 1, i + 2)]
        one, _, _ = lm_scoring.gates(p, np.array([near]))
        k = book.place.get(w, 3)
        total += np.log(float((one[0] * p["part"][k]).sum())) - (np.log(book.rare) if k == 3 else 0)
    assert lm_scoring.log_likelihood(book, p, [ids, ids[:0]])[0] == pytest.approx(total, rel=1e-4)


def test_gradient_of_the_gates_is_right():
    rng = np.random.default_rng(2)
    book = lm_scoring.Words([b"w%d" % i for i in range(20)], np.arange(20.0, 0, -1), 3.0)
    p = {k: v.astype(np.float64) for k, v in lm_scoring.initial(book).items()}
    ids = rng.integers(0, 20, 60)
    around, value = lm_scoring.contexts(ids, book.edge), lambda q: float(np.log((lm_scoring.gates(q, lm_scoring.contexts(ids, book.edge))[0] * q["part"][ids]).sum(1)).mean())
    moved = {k: v.copy() for k, v in p.items()}
    lm_scoring.learn(moved, np.zeros_like(p["part"]), around, ids, rate=1e-3)
    for name, at in (("gate", (3, 5)), ("bias", (7,)), ("mix", (2, 4)), ("tilt", (1,))):
        up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
        up[name][at] += 1e-4
        down[name][at] -= 1e-4
        assert (moved[name] - p[name])[at] / 1e-3 == pytest.approx((value(up) - value(down)) / 2e-4, rel=5e-2, abs=1e-6)


def test_network_beats_word_frequencies_on_held_out_documents(spark):
    """Two kinds of texts with words of their own: the neighbours tell the kind, frequencies do not."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"{'ab'[i % 2]}{k}" for k in rng.integers(0, 40, 60)) for i in range(4000)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts) if i % 5], "doc_id long, text string").repartition(2)
    counts = lm_scoring.count_words(docs)
    book = lm_scoring.vocabulary(counts)
    p = lm_scoring.train(docs, book)
    held = [book.ids(lm_scoring.split_words(t)) for i, t in enumerate(texts) if i % 5 == 0]
    plain = np.mean(np.log(book.share[np.concatenate(held)]))
    assert lm_scoring.log_likelihood(book, p, held).sum() / sum(map(len, held)) > plain + 0.5


def test_counts_of_rare_words_raise_their_documents(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "LEAST_VOCABULARY", 4)
    monkeypatch.setattr(lm_scoring, "isqrt", lambda n: 4)
    base = ["the of to in " * 10] * 30
    rows = [*base, "the alpha of", "the alpha of", "the gamma of"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    out = {r.doc_id: r.pll for r in lm_scoring.score_documents(docs).collect()}
    # the words have different letters but the same neighbours, and gamma stands once, alpha twice
    assert out[30] == pytest.approx(out[31]) and out[30] == pytest.approx(out[32] + np.log(2), abs=2e-2)


def test_flac_round_trips(spark, odd_docs, no_docs):
    rng = np.random.default_rng(1)
    some = [bytes(64), bytes(range(256)) * 9, rng.integers(0, 256, 6400, dtype=np.uint8).tobytes(), np.cumsum(rng.integers(-2, 3, 3200)).astype(np.uint8).tobytes(), b"\x00\xff" * 640, b"text of a kind " * 64]
    streams = media.encode(some)
    assert media.decode(streams) == some
    first, block = media.read_block(streams[1], 1500)
    assert first == 1024 and block == some[1][1024:2048]
    for place in (-3, 60, -40):
        broken = bytearray(streams[3])
        broken[place] ^= 4
        with pytest.raises(ValueError):
            media.decode([bytes(broken)])
    out = media.encode_media(odd_docs)
    blocks = media.pcm_blocks(out.select("doc_id", "media").filter("doc_id <> 9")).collect()
    whole = {}
    for b in sorted(blocks, key=lambda b: (b.doc_id, b.block)):
        assert b.sample_offset == len(whole.get(b.doc_id, b""))
        whole[b.doc_id] = whole.get(b.doc_id, b"") + bytes(b.pcm)
    for r in odd_docs.filter("doc_id <> 9").collect():
        assert whole[r.doc_id] == media.payload_of(r.text)[0]
    assert media.encode_media(no_docs).count() == 0


def test_checksums():
    assert media.crc8(b"123456789") == 0xF4
    data = np.frombuffer(b"123456789xx", np.uint8)
    assert media.crc16(data, np.array([0]), np.array([9]))[0] == 0xFEE8
    assert hashlib.sha256(b"").hexdigest() and zlib.crc32(b"") == 0


def test_every_word_is_a_training_target_once(monkeypatch):
    import types

    import pyarrow as pa

    names = [b"w%d" % i for i in range(60)]
    book = lm_scoring.Words(names, np.ones(60), 0.0)
    texts = [b" ".join(names[:n]).decode() for n in (1, 2, 7, 8, 40, 60)] + [None, ""]
    got = []
    monkeypatch.setattr(lm_scoring, "learn", lambda p, counts, around, word, rate: got.extend(map(tuple, np.column_stack([around, word]).tolist())))
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    share = lambda **x: list(lm_scoring._train([batch], types.SimpleNamespace(value=book), types.SimpleNamespace(value=lm_scoring.initial(book)), **x))
    ids = [book.ids(lm_scoring.split_words(t)) for t in texts if t]
    want = sorted(tuple(r) for i in ids for r in np.column_stack([lm_scoring.contexts(i, book.edge), i]).tolist())
    share()
    assert sorted(got) == want
    got.clear()
    for turn in range(3):
        share(turn=turn, turns=3)
    assert sorted(got) == want


def test_words_are_ascii_lowered_and_parted_by_ascii_space_alone(monkeypatch):
    texts = ["Ab\tcd\x0b\x0c EF\r\n", None, "", " \n ", "\u00c4b\u00a0c\u2003D \u0085 x\x1cY\x1f", "one", "  A " * 50, "\u0130stanbul \u03a3\U0001f600 a\x00B"]
    want = [(t or "").encode().lower().split() for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], ["doc_id", "text"]).slice(1)
    counts = Counter(w for t in want[1:] for w in t)
    book = lm_scoring.Words([b"a", b"one"], np.array([50.0, 1.0]), 9.0)
    p, got = lm_scoring.initial(book), []
    for piece, held in ((1, 1), (9, 70), (1 << 22, 1 << 22)):
        monkeypatch.setattr(lm_scoring, "PIECE", piece)
        monkeypatch.setattr(lm_scoring, "HELD_BYTES", held)
        found = list(lm_scoring.pieces([batch], 1))
        assert [w for _, words, _ in found for w in words.to_pylist()] == [w for t in want[1:] for w in t]
        assert [n for _, _, sizes in found for n in sizes.tolist()] == [len(t) for t in want[1:]]
        n: Counter = Counter()
        for out in lm_scoring._count([batch.select(["text"])]):
            for w, k in zip(*out.to_pydict().values(), strict=True):
                n[w] += k
        assert n == counts
        got.append([r for out in lm_scoring._score([batch], SimpleNamespace(value=book), SimpleNamespace(value=p)) for r in out.to_pylist()])
    for other in got[1:]:
        assert [(r["doc_id"], r["n_words"], r["rare"]) for r in other] == [(r["doc_id"], r["n_words"], r["rare"]) for r in got[0]]
        assert np.allclose([r["known"] for r in other], [r["known"] for r in got[0]], rtol=1e-5)


def test_words_of_texts_are_no_python_objects():
    """Counting, and finding the places of the words, takes no object a word: that was most of op10's time."""
    words = [b"w%d" % i for i in range(1000)]
    book, text = lm_scoring.Words(words, np.ones(1000), 0.0), b" ".join(words * 300).decode()
    batch = pa.RecordBatch.from_arrays([pa.array([text] * 3)], ["text"])
    tracemalloc.start()
    counted = sum(sum(out.column(1).to_pylist()) for out in lm_scoring._count([batch]))
    of_counting = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counted == 900_000 and of_counting < 4_000_000
    # a trainer whose words are all left for a later turn of many finds their places, and learns few of them
    tracemalloc.start()
    list(lm_scoring._train([batch.slice(0, 1)], SimpleNamespace(value=book), SimpleNamespace(value=lm_scoring.initial(book)), 0, 1000))
    of_places = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert of_places < 300_000 * 60  # six numbers a word; a word as an object has 37 bytes or more beside them


def test_sums_by_key_are_those_of_a_loop():
    rng = np.random.default_rng(5)
    for kind, keys in ((np.float32, rng.integers(0, 40, 500)), (np.float64, rng.integers(0, 90_000, 500)), (np.float32, np.zeros(1, np.int64))):
        rows = rng.normal(size=(len(keys), 6)).astype(kind)
        names, sums, n = lm_scoring._sums(keys, rows)
        assert names.tolist() == sorted(set(keys.tolist())) and n.tolist() == [int((keys == k).sum()) for k in names]
        assert sums.dtype == kind and np.allclose(sums, [rows[keys == k].sum(0) for k in names], atol=1e-5)


def _bits(*fields):
    """Fields (value, bits) joined to bytes."""
    value = size = 0
    for v, n in fields:
        value, size = value << n | v & ((1 << n) - 1), size + n
    pad = -size % 8
    return (value << pad).to_bytes((size + pad) // 8, "big")


def _frame(body, code=(6, b"\x0f")):
    head = bytes([0xFF, 0xF8, code[0] << 4, 0x00, 0x00]) + code[1]
    raw = head + bytes([media.crc8(head)]) + body
    crc = int(media.crc16(np.frombuffer(raw + b"\0", np.uint8), np.array([0]), np.array([len(raw)]))[0])
    return raw + crc.to_bytes(2, "big")


def test_streams_of_other_encoders_are_read():
    """Hand-assembled: no seek table, partitioned Rice codes, an escape, a zero width, another header."""
    x = [3, -2, 5, 0, 1, 1, -1, 2, 7, 7, 7, 7, -8, 0, 0, 0]
    rice = lambda v, k: [(1, ((v << 1) ^ (v >> 31) if v >= 0 else -2 * v - 1) // (1 << k) + 1), (((v << 1) if v >= 0 else -2 * v - 1) & ((1 << k) - 1), k)]
    fields = [(0b00010000, 8), (0, 2), (2, 4)]  # order 0, four partitions
    for p, k in ((x[:4], 2), (x[4:8], 1)):
        fields.append((k, 4))
        for v in p:
            fields += rice(v, k)
    fields += [(15, 4), (4, 5), *[(v, 4) for v in x[8:12]], (3, 4)]
    for v in x[12:]:
        fields += rice(v, 3)
    frames = _frame(_bits(*fields)) + _frame(b"\x00\xfb")
    info = (16).to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | 7 << 36 | 32).to_bytes(8, "big") + bytes(16)
    stream = b"fLaC\x80" + len(info).to_bytes(3, "big") + info + frames
    want = bytes((v + 128) & 255 for v in x) + bytes([123] * 16)
    assert media.decode([stream]) == [want]
    assert media.read_block(stream, 20) == (16, want[16:])
    with pytest.raises(ValueError):
        media.decode([b"fLaC\x80" + len(info).to_bytes(3, "big") + info[:10] + (8000 << 44 | 1 << 41 | 7 << 36 | 32).to_bytes(8, "big") + bytes(16) + frames])


def test_op5_columns_equal_plain_python(spark, odd_docs, tmp_path):
    docs = odd_docs.filter("doc_id is not null and doc_id <> 9")
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in media.op5_flac_media(spark, str(tmp_path)).collect()}
    for r in docs.collect():
        p, n = media.payload_of(r.text)
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert g.blocks[0].sample_offset == 0 and [b.sample_offset for b in g.blocks] == list(range(0, len(p), media.BLOCK))
        stream = media.encode([p])[0]
        assert g.media_sha256 == hashlib.sha256(stream).hexdigest()
        last = g.blocks[-1]
        first, block = media.read_block(stream, len(p) - 1)
        assert first == last.sample_offset and zlib.crc32(block) == last.pcm_crc32


def test_stored_streams_stay_below_their_input(spark, monkeypatch):
    """Disk: the streams' table takes less than 1.2 times the (compressed) documents, every text read back whole."""
    tables, stored = [], media.settle
    monkeypatch.setattr(media, "settle", lambda *a: tables.append(stored(*a)) or tables[-1])
    got = {r.doc_id: r.payload_sha256 for r in media.op5_flac_media(spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert got == {r.doc_id: hashlib.sha256(media.payload_of(r.text)[0]).hexdigest() for r in docs.collect()}
    size = lambda df: sum(os.path.getsize(f.removeprefix("file://").removeprefix("file:")) for f in df.inputFiles())
    assert size(tables[0]) < 1.2 * size(docs)


def test_frames_are_coded_where_it_pays_in_the_stored_table():
    smooth = np.rint(128 + 100 * np.sin(np.arange(2048) / 40)).astype(np.uint8).tobytes()
    text = ("an even text of some words, each of them plain; " * 50).encode()[:2048]
    for payload, kinds in ((smooth, {8, 9, 10} | set(range(32, 40))), (text, {1}), (b"7" * 2048, {0})):
        stream = media.encode([payload])[0]
        assert {stream[media._frame_head(stream, at)[1]] >> 1 for _, at, _ in media.seek_table(stream)[0]} <= kinds
        assert media.decode([stream]) == [payload]
    x = np.frombuffer(b"aabbccdd" + b"a" * 8, np.uint8).reshape(2, 8).astype(np.int32) - 128
    assert media.entropy_bits(x).tolist() == [16, 0]


def test_frames_take_the_cheapest_of_all_predictors_and_parameters():
    rng = np.random.default_rng(1)
    u = np.concatenate([rng.geometric(p, (200, 64)) - 1 for p in (0.9, 0.5, 0.2, 0.05, 0.02)] + [(rng.random((200, 64)) < p) * 200 + rng.integers(0, 4, (200, 64)) for p in (0.02, 0.1, 0.17)]).astype(np.int32)
    bits, k = media._way_bits(u, 0, 0)
    every = np.stack([(u >> j).sum(1) + 64 * (j + 1) + 10 for j in range(8)], axis=1)
    assert (bits == every.min(1)).all() and (every[np.arange(len(u)), k] == bits).all()
    # differences of the third order are all 1: none are left at the fourth
    cubic = bytes(128 + n * (n - 1) * (n - 2) // 6 for n in range(-7, 9))
    stream = media.encode([cubic])[0]
    at = media.seek_table(stream)[0][0][1]
    assert stream[media._frame_head(stream, at)[1]] >> 1 == 0b001100 and media.decode([stream]) == [cubic]


def test_op2_and_op4_columns(spark, tmp_path):
    rows = _spoken(150) + [(900, None, "en"), (901, "", None), (902, "12 34", "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for out in (langid.op4_byte_gru(spark, str(tmp_path)), toxicity.op2_weak_supervision(spark, str(tmp_path))):
        got = out.collect()
        assert len(got) == len(rows) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
        if "lang_pred" in out.columns:
            assert {r.doc_id for r in got if r.lang_pred == "und"} == {900, 901, 902} and {r.lang_pred for r in got} <= {"en", "de", "fr", "und"}
        else:
            assert all(r.predicted == int(r.score >= 0.7) for r in got)


def test_positions_equal_a_plain_recurrence():
    """A window position by position, in plain Python floats."""
    p = langid.initial(3, np.random.default_rng(4))
    raw, h = b"ab\xc3\xa9 c", langid.HIDDEN

    def run(way, data):
        state, out = np.zeros(h), []
        for b in data:
            g, a = p["in_" + way][b].astype(float), state @ p["re_" + way].astype(float)
            z, r = (1 / (1 + np.exp(-(g[k * h : (k + 1) * h] + a[k * h : (k + 1) * h]))) for k in (0, 1))
            new = np.tanh(g[2 * h :] + r * a[2 * h :])
            state = (1 - z) * new + z * state
            out.append(state)
        return out

    padded = raw.ljust(langid.WINDOW, b"\0")
    both = np.concatenate([np.array(run("f", padded)), np.array(run("b", padded[::-1]))[::-1]], axis=1)
    logits = both @ p["head"] + p["bias"]
    prob = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    assert np.allclose(langid.Scorer(p).documents([raw.decode()])[0], prob[: len(raw)].mean(0), atol=1e-4)


def test_gates_of_far_apart_numbers_are_a_softmax():
    for far in (0.5, 30.0, 200.0, -200.0, 5000.0):
        z = np.array([[0.0, far, 1.0], [far, far, far]], dtype=np.float32)
        want = np.exp(z - z.max(1, keepdims=True).astype(float))
        assert lm_scoring.softmax(z.copy()) == pytest.approx(want / want.sum(1, keepdims=True), abs=1e-6)


def test_neighbours_of_many_texts_are_those_of_each():
    texts = [np.arange(1, 6), np.arange(0), np.array([7]), np.arange(8, 11)]
    together = lm_scoring.contexts(np.concatenate(texts), 99, np.array([len(t) for t in texts]))
    assert together.tolist() == [r for t in texts for r in lm_scoring.contexts(t, 99).tolist()]
    assert together[5].tolist() == [99] * (2 * lm_scoring.WINDOW)


def test_scores_do_not_hang_on_partitions(spark):
    """Held out, the network beats word frequencies by the same margin whether a corpus lies in 4 or 64 parts."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    learnt, held = docs.filter("doc_id % 5 <> 0"), [r.text for r in docs.filter("doc_id % 5 = 0").collect()]
    book = lm_scoring.vocabulary(lm_scoring.count_words(learnt))
    ids = [book.ids(lm_scoring.split_words(t)) for t in held]
    every = np.concatenate(ids)
    plain = np.log(np.maximum(book.share[np.minimum(every, book.size)], 1e-30)).mean()
    gains = []
    for parts in (4, 64):
        p = lm_scoring.train(learnt.repartition(parts, "doc_id"), book)
        score = lm_scoring.log_likelihood(book, p, ids).sum() + np.log(book.rare) * (every >= book.size).sum()
        gains.append(score / len(every) - plain)
    assert min(gains) > 0.45 and abs(gains[0] - gains[1]) < 0.05
