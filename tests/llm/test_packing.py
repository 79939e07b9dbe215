import json
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewell.llm import packing


def _check(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_ids_are_the_tokenizers(odd_docs):
    path = packing.tokenizer_path()
    tok = Tokenizer.from_file(path)
    texts = [r.text or "" for r in odd_docs.collect() if len(r.text or "") < 50_000]
    texts += ["It's <|endoftext|>x don'T  IT'S 3²½ µª «oui» ΣΑΣ İ ﬁ é", "a\x1cb", " x y", "a" * 65, "!?.,..x-y_z 日本語 🙂🙂"]
    assert [np.frombuffer(r, "<u4").tolist() for r in packing.encode(texts, path)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(st.characters(max_codepoint=255), max_size=80), st.text("abcdefgh IJ'é-_.,!1²ß|<>", max_size=80)))
def test_ids_of_any_text_are_the_tokenizers(text):
    path = packing.tokenizer_path()
    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer.from_file(path)
    assert np.frombuffer(packing.encode([text], path)[0], "<u4").tolist() == _tokenizers[path].encode(text, add_special_tokens=False).ids


_tokenizers = {}


def test_every_token_is_merged_from_its_own_bytes_by_its_listed_pair():
    """What makes merging by joined bytes the same as merging by listed pairs."""
    with open(packing.tokenizer_path(), encoding="utf-8") as f:
        model = json.load(f)["model"]
    ranks, _ = packing.byte_ranks(model)
    inverse = {r: b for b, r in ranks.items()}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    first = len(ranks) - len(pairs)
    size = {}
    for k, (left, right) in enumerate(pairs):
        whole = inverse[first + k]
        parts = [whole[i : i + 1] for i in range(len(whole))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 30))
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        end = model["end_of_word_suffix"]
        size[left], size[right] = (len(x.removesuffix(end)) + (x.endswith(end)) for x in (left, right))
        assert len(parts[0]) == size[left] and len(parts[1]) == size[right], (left, right)


def test_documents_are_whole_and_packed(spark, odd_docs, no_docs):
    rows = packing.pack_documents(odd_docs).collect()
    _check(rows, 2048)
    path = packing.tokenizer_path()
    want = {(r.doc_id, r.text): packing.encode([r.text or ""], path)[0] + b"\0\0\0\0" for r in odd_docs.collect() if r.doc_id != 9}
    pieces = defaultdict(dict)
    for r in rows:
        pieces[r.doc_id][r.piece] = r
    for (name, _), raw in want.items():
        own = [pieces[name][i] for i in range(len(pieces[name]))]
        assert sum(p.length for p in own) * 4 == len(raw)
        assert all(zlib.crc32(raw[4 * p.start : 4 * (p.start + p.length)]) == p.ids_crc32 for p in own)
        assert all(p.length == 2048 for p in own[:-1])
    assert sum(r.doc_id == 9 for r in rows) == 2  # repeated rows are packed each
    assert packing.pack_documents(no_docs).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(4, 40).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(1, 25), min_size=1, max_size=10))))
def test_plan_places_every_piece_once(case):
    capacity, hist = case
    bins, ranks = defaultdict(list), defaultdict(list)
    for length, lo, hi, m, seq, offset in packing.plan(dict(hist), capacity):
        ranks[length].append((lo, hi))
        for k in range(hi - lo):
            bins[seq + k // m].append((offset + k % m * length, length))
    for length, n in hist.items():
        spans = sorted(ranks[length])
        assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity


def _optimum(items, capacity):
    """Fewest bins, by search over all assignments."""
    best = len(items)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for k in {r: j for j, r in enumerate(rooms)}.values():
            if rooms[k] >= items[i]:
                go(i + 1, [*rooms[:k], rooms[k] - items[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best


@settings(max_examples=80, deadline=None)
@given(st.integers(6, 20).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), min_size=1, max_size=8))))
def test_reduction_keeps_the_optimum(case):
    capacity, items = case
    hist = defaultdict(int)
    for x in items:
        hist[x] += 1
    free = packing.Lengths(hist)
    fixed = sum(n for _, n in packing.reduce_instance(free, capacity))
    rest = sorted((k for k, n in free.n.items() for _ in range(n)), reverse=True)
    assert fixed + _optimum(rest, capacity) == _optimum(sorted(items, reverse=True), capacity)
