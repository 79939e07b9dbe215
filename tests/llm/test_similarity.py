import random
import re

import numpy as np

from tests.llm.conftest import sentence
from tidewell.llm import cap_filters, graph, ngram_join


def _sets(rows):
    out = {}
    for name, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        out[name] = frozenset([tuple(words)] if 0 < len(words) < 5 else (tuple(words[i : i + 5]) for i in range(len(words) - 4)))
    return out


def _components(names, links):
    root = {n: n for n in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in names}


def _brute(rows):
    sets = _sets(rows)
    names = sorted(sets)
    links = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return {n: (len(sets[n]), c) for n, c in _components(names, links).items()}


def _copies():
    rng = random.Random(4)
    rows = []
    for family in range(6):
        base = sentence(rng.choice([8, 40, 160, 400]), family).split()
        for _ in range(14):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
            rows.append(" ".join(words))
    shared = sentence(60, 77)
    rows += [sentence(90, 200 + i) + " " + shared for i in range(12)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_join_equals_brute_force(spark, odd_docs, no_docs, monkeypatch):
    rows = _copies() + [(1000 + r.doc_id, r.text) for r in odd_docs.collect() if r.doc_id is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = _brute(rows)
    for exact, postings in ((False, ngram_join.POSTINGS), (True, 500)):
        monkeypatch.setattr(ngram_join, "POSTINGS", postings)
        got = ngram_join.link_components(df, exact=exact).collect()
        assert len(got) == len(rows)
        assert all(want[r.doc_id] == (r.n_shingles, r.component_id) for r in got)
    assert ngram_join.link_components(no_docs).count() == 0
    assert len({c for _, c in want.values()}) > 20


def test_chunks_lose_no_link(spark, monkeypatch):
    rows = _copies()
    monkeypatch.setattr(ngram_join, "CHUNK", 700)
    monkeypatch.setattr(ngram_join, "COMMON", 4)
    got = ngram_join.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = _brute(rows)
    assert all(want[r.doc_id] == (r.n_shingles, r.component_id) for r in got)


def test_null_ids_and_repeats(spark, odd_docs):
    out = ngram_join.keep_one(odd_docs)
    names = sorted(r.doc_id for r in out.collect() if r.doc_id is not None)
    assert out.columns == odd_docs.columns and names == [0, 2, 3, 4, 5, 6, 7, 9, 11]
    assert out.filter("doc_id is null").count() == 1


def test_divide_skip_equals_counting():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in rng.integers(1, 60, 80)]
    sets += [np.unique(np.append(s[1:], [np.uint64(1000 + i)])) for i, s in enumerate(sets[:30])]
    lists = ngram_join.Lists(sets)
    for q in sets:
        want = [i for i, s in enumerate(sets) if ngram_join.similar(q, s, 75)]
        assert sorted(lists.search(q, 75)) == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (200, 150), (200, 151)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    names = {x for e in edges for x in e}
    assert got == _components(names, edges)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def _vectors():
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 32))
    rows = [c + 0.2 * rng.standard_normal(32) for c in centres for _ in range(15)] + list(rng.standard_normal((300, 32)))
    return [(i, [float(np.float32(v)) for v in x]) for i, x in enumerate(rows)]


def test_caps_find_the_links(spark, monkeypatch):
    rows = _vectors()
    odd = [(900, None), (901, []), (902, [0.0] * 32), (903, [float("nan")] + [1.0] * 31), (904, [None] + [1.0] * 31), (905, rows[0][1]), (906, rows[0][1]), (907, [1.0, 2.0]), (908, [1e30] * 32), (909, [1e-30] * 32)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    plain = {n: np.array(v, dtype=float) for n, v in rows + odd[5:]}
    names = sorted(plain)
    links = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if len(plain[a]) == len(plain[b]) and plain[a] @ plain[b] / np.linalg.norm(plain[a]) / np.linalg.norm(plain[b]) >= 0.9]
    want = {n: 0 for n in names}
    for a, b in links:
        want[a] += 1
        want[b] += 1
    for chunk in (cap_filters.CHUNK, 8):
        monkeypatch.setattr(cap_filters, "CHUNK", chunk)
        got = {r.vec_id: r for r in cap_filters.near_duplicates(df).collect()}
        assert len(got) == len(rows) + len(odd)
        assert all(got[n].n_links <= want[n] for n in names)
        assert sum(got[n].n_links for n in names) >= 0.95 * sum(want.values())
        assert all(got[n].n_links == 0 and got[n].component_id == n and got[n].kept for n in (900, 901, 902, 903, 904))
        assert got[905].n_links >= 2 and got[905].component_id == 0 and not got[906].kept
    assert cap_filters.near_duplicates(df.limit(0)).count() == 0


def test_decoding_lists_exactly_the_exceeding_directions():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((40, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    _, books = cap_filters.codebooks(12, 3, 6)
    rows, code = cap_filters.decode(x, books, 1.2)
    parts = np.split(x, 3, axis=1)
    want = set()
    s = [p @ b.T for p, b in zip(parts, books)]
    for i in range(40):
        for a in range(6):
            for b in range(6):
                for c in range(6):
                    if s[0][i, a] + s[1][i, b] + s[2][i, c] >= 1.2:
                        want.add((i, (a * 6 + b) * 6 + c))
    assert set(zip(rows.tolist(), code.tolist())) == want


def _pairs(n, dim):
    """n random pairs of unit vectors at a cosine of just over 0.9."""
    x, z = np.random.default_rng(21).standard_normal((2, n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (x * z).sum(1, keepdims=True) * x
    return x, 0.9001 * x + np.sqrt(1 - 0.9001**2) * z / np.linalg.norm(z, axis=1, keepdims=True)


def test_caps_find_the_links_at_any_size():
    sides = _pairs(500, 64)
    for n in (20_000, 1_000_000, 10_000_000):
        plan = cap_filters.design(n, 64)
        found = np.zeros(500, dtype=bool)
        for table in range(plan.tables):
            rotation, books = cap_filters.codebooks(64, plan.blocks, plan.size, cap_filters.SEED + table)
            met = [set(zip(*(v.tolist() for v in cap_filters.decode(x @ rotation, books, plan.threshold)))) for x in sides]
            found[[row for row, _ in met[0] & met[1]]] = True
        assert found.mean() >= 0.95


def test_caps_against_all_pairs_at_three_sizes(spark):
    """Pairs at just the cosine among unrelated vectors, in tables of three sizes: no link is wrong, few are missing."""
    for pairs, others in ((20, 60), (100, 1800), (300, 11_400)):
        x, y = _pairs(pairs, 64)
        v = np.concatenate([x, y, np.random.default_rng(pairs).standard_normal((others, 64))])
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        want = (v @ v.T >= 0.9).sum(1) - 1
        df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(v)], "vec_id long, embedding array<double>")
        got = {r.vec_id: r.n_links for r in cap_filters.near_duplicates(df).collect()}
        assert all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.93 * want.sum() > 0


def test_several_tables_count_a_link_once(spark, monkeypatch):
    monkeypatch.setattr(cap_filters, "LOAD", 0.5)  # at 2,400 vectors as narrow as at 300,000
    x, y = _pairs(200, 64)
    other = np.random.default_rng(3).standard_normal((2000, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y, other]))]
    got = {r.vec_id: r for r in cap_filters.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert sum(got[i].n_links == got[i + 200].n_links == 1 and got[i + 200].component_id == i for i in range(200)) >= 0.9 * 200
    assert all(r.n_links <= 1 for r in got.values())


def test_recall_holds_at_every_size():
    """Random pairs at just the cosine that the design has not tried, for tables of very different sizes."""
    for dim, n in ((64, 20), (2, 100), (5, 3000), (64, 500), (64, 2000), (64, 10_000), (64, 1_000_000), (64, 100_000_000), (256, 50_000), (256, 100_000_000)):
        plan = cap_filters.design(n, dim)
        rng = np.random.default_rng([5, dim, n])
        x, z = rng.standard_normal((2, 250, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z -= (x * z).sum(1, keepdims=True) * x
        y = 0.9 * x + np.sqrt(1 - 0.81) * z / np.linalg.norm(z, axis=1, keepdims=True)
        found = np.zeros(250, dtype=bool)
        for table in range(plan.tables):
            rotation, books = cap_filters.codebooks(dim, plan.blocks, plan.size, cap_filters.SEED + table)
            keys = [r * plan.size**plan.blocks + c for r, c in (cap_filters.decode(v @ rotation, books, plan.threshold) for v in (x, y))]
            found[np.intersect1d(*keys) // plan.size**plan.blocks] = True
        assert plan.tables and found.mean() >= 0.95, (dim, n, plan, found.mean())
