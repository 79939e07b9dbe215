"""Stored indexes against brute force, with changes, odd rows and writers that meet."""

import random
from collections import Counter
from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import lexical_index as li
from tidewell.operators import retrieval as rt
from tidewell.operators import vector_index as vi
from tidewell.sources import tables


def _vectors(spark, sf):
    return spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select(F.col("vec_id").alias("key"), "label", "embedding")


def test_recall_and_rows_read(spark, tmp_path):
    v, path = _vectors(spark, "sf0.1"), str(tmp_path / "ix")
    vi.build(v, path)
    asked = v.filter("key % 100 = 0").select(F.col("key").alias("qid"), F.col("embedding").alias("q"))
    n, ef = v.count(), 600
    got = {(r.qid, r.key) for r in vi.search(spark, path, asked, 10, ef).collect()}
    one = F.lit(1).alias("namespace")
    exact = {(r.qid, r.key) for r in rt.batched_top_k(v.select("key", "embedding", one), asked.select("*", one), 10).collect()}
    read = vi.probes(spark, path, asked, ef).groupBy("qid").agg(F.sum("rows").alias("n")).agg(F.max("n")).first()[0]
    assert len(got & exact) >= 0.9 * len(exact) and read < 0.35 * n
    all_rows = {(r.qid, r.key) for r in vi.search(spark, path, asked, 10, n).collect()}
    assert all_rows == exact


def test_odd_vectors_copies_and_changes(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(8).round(3).tolist()) for i in range(200)]
    rows += [(1000 + i, [1.0] * 8) for i in range(150)] + [(2000, None), (2001, [0.0] * 8), (2002, [1.0] * 3), (2003, [1.0] * 7 + [None]), (2004, [float("nan")] * 8)]
    v, path = spark.createDataFrame(rows, "key long, embedding array<double>"), str(tmp_path / "ix")
    vi.build(v, path)
    asked = spark.createDataFrame([(1, [1.0] * 8)], "qid int, q array<double>")
    found = vi.search(spark, path, asked, 5, 400).orderBy("rank").collect()
    assert [r.key for r in found] == [1000, 1001, 1002, 1003, 1004] and found[0].score == pytest.approx(1)
    vi.remove(spark, path, spark.createDataFrame([(1000,), (1002,), (77777,)], "key long"))
    vi.upsert(spark, path, spark.createDataFrame([(1001, [-1.0] * 8), (1000, [1.0] * 8)], "key long, embedding array<double>"))
    assert [r.key for r in vi.search(spark, path, asked, 4, 400).orderBy("rank").collect()] == [1000, 1003, 1004, 1005]
    empty = str(tmp_path / "none")
    vi.build(v.limit(0), empty)
    assert vi.search(spark, empty, asked).count() == 0


def _brute(texts, query, stop):
    import re

    cut = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if len(w.encode()) >= 2 and w not in stop]
    docs = {i: Counter(cut(t or "")) for i, t in texts.items()}
    n, mean = len(docs), sum(c.total() for c in docs.values()) / len(docs)
    df = Counter(w for c in docs.values() for w in c)
    out = {}
    for i, c in docs.items():
        s = sum(log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * c.total() / mean)) for w in cut(query) if c[w])
        if s:
            out[i] = s
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


def test_words_equal_brute_force_through_changes(spark, tmp_path, monkeypatch):
    from tidewell.functions.text import STOP_WORDS

    monkeypatch.setattr(li, "BLOCK_ROWS", 4)
    rng, path = random.Random(3), str(tmp_path / "words")
    names = [f"w{i}" for i in range(30)] + ["common"] * 20 + ["the"]
    text = lambda: " ".join(rng.choices(names, k=rng.randint(0, 60)))
    texts = {i: text() for i in range(300)} | {900: None, 901: "", 902: "only common common"}
    put = lambda some: spark.createDataFrame(list(some.items()), "id long, text string")
    li.upsert(put(texts), path)
    for step in range(3):
        for query, k in (("common w3", 5), ("w1 w1 w2 common the", 10), ("nothing here", 3), ("", 3), ("w9", 1000)):
            want = _brute(texts, query, STOP_WORDS)
            got = [(r.id, r.score) for r in li.search(spark, path, query, k).collect()]
            assert [i for i, _ in got] == [i for i, _ in want[:k]]
            assert [s for _, s in got] == pytest.approx([s for _, s in want[:k]])
        assert {r.id: pytest.approx(r.score) for r in li.scores(spark, path, "common w3").collect()} == dict(_brute(texts, "common w3", STOP_WORDS))
        if step == 0:
            new = {i: text() for i in range(0, 320, 9)}
            li.upsert(put(new), path)
            li.delete(spark.createDataFrame([(i,) for i in range(1, 300, 13)] + [(5555,), (None,)], "id long"), path)
            texts = {i: t for i, t in (texts | new).items() if i not in range(1, 300, 13)}
        elif step == 1:
            li.compact(spark, path)
    q = li.Query(spark, path, "common w3")
    assert q.needed(3).count() < q.blocks.count()


def test_a_query_reads_the_folders_of_its_terms(spark, tmp_path):
    path = str(tmp_path / "words")
    li.upsert(spark.createDataFrame([(i, f"alpha word{i}") for i in range(50)], "id long, text string"), path)
    plan = li.Query(spark, path, "alpha").blocks._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1][:60]


def test_readers_see_whole_changes(spark, tmp_path):
    path = str(tmp_path / "store")
    one, two = spark.range(3), spark.range(5)
    assert tables.read(spark, tables.current(spark, path), "rows", "id long").count() == 0
    first = tables.publish(one, path)
    reader = tables.read(spark, tables.current(spark, path), "rows", "id long")
    staged = tables.stage(two, path, "rows")
    # a staged segment is in no reader's view, and a reader keeps its view over the swap
    assert tables.read(spark, tables.current(spark, path), "rows", "id long").count() == 3
    tables.commit(spark, path, first, {"rows": [staged]})
    assert reader.count() == 3
    assert tables.read(spark, tables.current(spark, path), "rows", "id long").count() == 5
    with pytest.raises(tables.Conflict):
        tables.commit(spark, path, first, {"rows": []})
    # a writer that died after staging left a file that is no manifest
    (tmp_path / "store" / "manifest" / "00000003.half").write_text("{")
    assert tables.current(spark, path).number == 2


def test_best_rows_of_odd_vectors_are_those_of_plain_scores(spark, monkeypatch):
    """Copies, other sizes, nulls, zeros and numbers that no double holds, in cells of a few rows: each
    query's best by vx.cosine, bit by bit, ties by key."""
    from pyspark.sql import Window

    from tidewell.functions import vectors as vx

    monkeypatch.setattr(rt, "CELL_ROWS", 40)
    monkeypatch.setattr(rt, "CELL_QUERIES", 3)
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(0, 3)), rng.standard_normal(6).tolist()) for i in range(150)] + [(200 + i, 1, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(30)]
    rows += [(300, 0, None), (301, 0, []), (302, 0, [0.0] * 6), (303, 0, [1.0] * 3), (304, 0, [1.0] * 5 + [None]), (305, 2, [float("nan")] * 6), (306, 2, [float("inf")] + [1.0] * 5), (307, 2, [1e-200] * 6), (308, None, [1.0] * 6), (309, 3, [-1.0, 0.0]), (310, 3, [0.0, 2.0]), (311, 4, [1.0])]
    v = spark.createDataFrame(rows, "key long, namespace int, embedding array<double>")
    asked = v.filter("key % 9 = 0 or key >= 300").select(F.col("key").alias("qid"), "namespace", F.col("embedding").alias("q"))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "key")
    plain = asked.join(v, "namespace").withColumn("score", vx.cosine(F.col("embedding"), F.col("q"))).withColumn("rank", F.row_number().over(best)).filter("rank <= 4")
    said = lambda df: sorted((r.qid, r["rank"], r.key, repr(abs(r.score) if r.score == 0 else r.score)) for r in df.collect())
    assert said(rt.batched_top_k(v, asked, 4)) == said(plain)
    assert rt.batched_top_k(v.limit(0), asked, 4).count() == 0 and rt.batched_top_k(v, asked.limit(0), 4).count() == 0


def test_few_pairs_are_scored_one_by_one():
    rng = np.random.default_rng(4)
    q, v = rng.standard_normal((50, 16)), rng.standard_normal((20_000, 16))
    norm = lambda x: np.sqrt((x * x).sum(1))
    blocks = list(rt._likely(q, v, norm(q), norm(v), 5))
    assert sum(len(i) for i, _ in blocks) == 250 and len(blocks) == -(-50 // (rt.BLOCK_NUMBERS // 20_000))
