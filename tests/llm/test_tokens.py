"""Token alignment, wavelet shards and the source audit against plain Python."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import alignment, divergence, token_units, wavelet

ODD = [
    "tabs\tand\r\nreturns;\r\n", "  two  blanks  ", "\n\n  lines\n\n\n", "<|endoftext|> <s> </s> <unk>", "a\0b", "x▁y", " ", "\n", "　wide　blank", "nbsp\xa0here\x85 next",
    "don't I'll we've", "日本語 テキスト", "ﬁ é́ Ａ 😀😀 end", "x" * 9000, " " * 5000 + "z", "мир и война 1234567", "a\x1cb \x1d c", "ሰላም ᠎ x", "tail \t\r", "end;\r",
]


@pytest.fixture(scope="module")
def tools():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def test_units_give_the_ids_of_whole_texts(tools):
    a, b = tools
    ids = token_units.TextIds(token_units.tokenizer_path("byte_bpe_50k.json"))
    got = [np.frombuffer(x, "<u4").tolist() for x in ids(ODD)]
    assert got == [a.encode(t, add_special_tokens=False).ids for t in ODD]
    p = token_units.pieces(token_units.tokenizer_path("piece_bpe_32k.model"))
    assert p.apart
    units = [token_units.UNIT.findall(" " + t) for t in ODD]
    assert all("".join(u) == " " + t for u, t in zip(units, ODD, strict=True))
    assert [[i for u in p(us) for i in u] for us in units if "▁" not in us[0]] == [b.encode(t) for t in ODD if "▁" not in t]


def test_random_texts_cut_into_units(tools):
    a, b = tools
    rng = random.Random(5)
    signs = " \n\t\r\x0b'’.;,aZé0ß9\xa0 　▁字😀-_<>|"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    byte, piece = token_units.byte_level(token_units.tokenizer_path("byte_bpe_50k.json")), token_units.pieces(token_units.tokenizer_path("piece_bpe_32k.model"))
    for t in texts:
        units = token_units.UNIT.findall(" " + t)
        assert [i for u in byte(units) for i in u] == a.encode(" " + t, add_special_tokens=False).ids
        # a sign that reads as a blank is not given back, so such texts have no tokens
        assert "▁" in t or [i for u in piece(units) for i in u] == b.encode(t)


def _aligned(texts, tools):
    """Plain alignment: {row: (n_a, n_b, n_groups, n_links, n_best, count_sum, sha)}."""
    a, b = tools
    raw = token_units.byte_level(token_units.tokenizer_path("byte_bpe_50k.json")).raw
    found, held = [], Counter()
    for t in texts:
        if not t:
            found.append(None)
            continue
        ids = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        said = [raw[i] for i in ids[0]], [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
        if any(b"".join(s) != (" " + t).encode() for s in said):
            found.append(None)
            continue
        ends = [list(itertools.accumulate(map(len, s))) for s in said]
        starts = [[0, *e[:-1]] for e in ends]
        links = [(x, y) for x, s, e in zip(ids[0], starts[0], ends[0], strict=True) for y, s2, e2 in zip(ids[1], starts[1], ends[1], strict=True) if s < e2 and s2 < e]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = ["|".join(",".join(str(i) for i, e in zip(ids[k], ends[k], strict=True) if lo < e <= hi) for k in (0, 1)) for lo, hi in zip([0, *cuts], cuts)]
        held.update(set(links))
        found.append((len(ids[0]), len(ids[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else (*f[:3], len(f[3]), sum(held[p] == best[p[0]] for p in f[3]), sum(held[p] for p in f[3]), f[4]) for f in found]


@pytest.mark.parametrize("share", [alignment.HOT_SHARE, 4])
def test_alignment_equals_plain_python(spark, odd_docs, no_docs, tools, monkeypatch, tmp_path, share):
    monkeypatch.setattr(alignment, "HOT_SHARE", share)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(r.doc_id, (r.text or "")[:20_000] or None) for r in odd_docs.collect()]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("n", F.lit(2)).write.parquet(str(tmp_path / "documents.parquet"))
    out = alignment.op12_token_alignment(spark, str(tmp_path))
    got = sorted((tuple(r) for r in out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)
    want = sorted(((d, *w) for (d, _), w in zip(rows, _aligned([t for _, t in rows], tools), strict=True)), key=str)
    assert got == want
    assert alignment.document_links(alignment.align(no_docs)).count() == 0


def test_groups_and_their_links():
    raw_a, raw_b = {1: b"ab", 2: b"c", 3: b"def"}, {7: b"a", 8: b"bc", 9: b"def"}
    assert alignment.cut_groups([1, 2, 3], [7, 8, 9], raw_a, raw_b) == ["1,2|7,8", "3|9"]
    assert alignment.expand("1,2|7,8", raw_a, raw_b) == {(1, 7): 1, (1, 8): 1, (2, 8): 1}


def test_wavelet_files_answer_like_arrays():
    rng = np.random.default_rng(3)
    for n, most in ((0, 1), (1, 1), (7, 1), (1000, 3), (200_000, 50_000), (70_000, 1 << 20)):
        ids = np.minimum(rng.zipf(1.3, n), most).astype("<u4")
        shard = wavelet.Shard(wavelet.build(ids, [5, None], [n, 0], 11))
        assert shard.doc_ids == [5, None] and shard.lengths.tolist() == [n, 0] and shard.before == 11
        assert np.array_equal(shard.ids(), ids)
        for at in rng.integers(0, n, 30).tolist() if n else []:
            assert shard.access(at) == ids[at]
        for token in [1, 2, most, most + 1, *(ids[:3].tolist())]:
            lo, hi = sorted(rng.integers(0, n + 1, 2).tolist())
            assert shard.count(token) == int((ids == token).sum())
            assert shard.count(token, lo, hi) == int((ids[lo:hi] == token).sum())
            assert np.array_equal(shard.occurrences(token, lo, hi), np.flatnonzero(ids[lo:hi] == token) + lo)


def test_shards_hold_every_document(spark, odd_docs, no_docs, tools):
    rows = odd_docs.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(ODD, 100)), "doc_id long, text string"))
    shards = wavelet.write_shards(rows.withColumn("part", F.lit(1)).withColumn("at", F.lit(1)), shard_tokens=60).cache()
    assert shards.count() > 8
    got = sorted((tuple(r) for r in wavelet.read_shards(shards).collect()), key=lambda r: r[1])
    texts = sorted(((r.doc_id, r.text or "") for r in rows.collect()), key=lambda r: (r[0] is not None, r[0]))
    at, want, stream = 0, [], []
    for d, t in texts:
        ids = [*tools[0].encode(t, add_special_tokens=False).ids, 2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
        stream += [(d, i, x) for i, x in enumerate(ids)]
    assert got == want
    counts = {r.token: r.n for r in wavelet.token_counts(shards, [2, 257, 99_999]).collect()}
    assert counts == {t: sum(x == t for _, _, x in stream) for t in (2, 257, 99_999)}
    places = sorted((r.start, r.doc_id, r.place) for r in wavelet.token_places(shards, 257).collect())
    assert places == [(k, d, i) for k, (d, i, x) in enumerate(stream) if x == 257]
    asked = spark.createDataFrame([(k,) for k in range(0, len(stream), 37)], "start long")
    assert sorted(tuple(r) for r in wavelet.tokens_at(shards, asked).collect()) == [(k, stream[k][2]) for k in range(0, len(stream), 37)]
    assert wavelet.read_shards(wavelet.write_shards(no_docs)).count() == 0


def _audited(rows, least, most):
    """The audit's rows by plain Python, of (text, lang, source)."""
    cut = [(g or "", s or "", _terms(t or "")) for t, g, s in rows]
    out = []
    for lang in {g for g, _, _ in cut}:
        mine = [(s, w) for g, s, w in cut if g == lang]
        docs = Counter(t for _, w in mine for t in set(w))
        kept = sorted(t for t, n in docs.items() if n >= least)
        total = Counter(t for _, w in mine for t in w)
        by = {s: Counter(t for s2, w in mine if s2 == s for t in w) for s, _ in mine}

        def rates(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        own, p = rates(total), {s: rates(c) for s, c in by.items()}
        for s in by:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in by if o != s]
            terms = [(-((p[s][t] - own[t]) ** 2 // own[t]), t.encode(), t) for t in kept if by[s][t] and p[s][t] > own[t]]
            out += [(lang, s, "pair", x[2], -x[0], i) for i, x in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", x[2], -x[0], i) for i, x in enumerate(sorted(terms)[:most], 1)]
    return sorted(out)


def _terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return [w for w in "".join(c if "a" <= c <= "z" or ord(c) >= 128 else " " for c in low).split(" ") if w]


def test_audit_equals_plain_python(spark, odd_docs, no_docs, tmp_path):
    rng = random.Random(2)
    words = ["Élan", "river", "RIVER", "stone", "字", "b-c", "x1y", "été", "zz", "q"]
    rows = [(" ".join(rng.choices(words, range(1, 11), k=rng.randint(0, 30))), rng.choice(["en", None, "de"]), rng.choice(["a", "b", None, "é", "Z"])) for _ in range(60)]
    rows += [("only here", "fr", "lone"), (None, "fr", "two"), ("", "it", "x")] + [(r.text, r.lang, r.source) for r in odd_docs.collect() if not r.text or "\xa0" not in r.text]
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("term", F.lit("t")).withColumn("n", F.lit(1))
    for least, most in ((3, 200), (1, 4)):
        got = divergence.audit(df, least, most)
        pairs = got.pairs.select("lang", "source", F.lit("pair"), "other", "value", "rank").collect()
        terms = got.terms.select("lang", "source", F.lit("term"), "term", "value", "rank").collect()
        want = [(g, s, p, i, v, k) for g, s, p, i, v, k in _audited([(t, g, s) for t, g, s in rows], least, most)]
        assert sorted(tuple(r) for r in pairs + terms) == want
    none = divergence.audit(no_docs)
    assert none.pairs.count() == 0 and none.terms.count() == 0


def test_rates_are_exact_beyond_a_long_product(spark):
    cases = [(0, 1), (5, 6), (123_456_789_012_345, 987_654_321_098_765), (8 * 10**15, 8 * 10**15 + 1)]
    df = spark.createDataFrame(cases, "n long, total long").selectExpr("n", "total", f"{divergence._rate('n', 'total')} as p")
    assert all(r.p == 1 + 10**9 * (r.n + 1) // r.total for r in df.collect())
