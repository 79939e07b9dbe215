"""Work that grows with the input and no faster: long texts, large groups, many keys."""

import itertools
import time
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  registers the base queries
from tidewell.functions import maths as ma
from tidewell.functions import pages as pg
from tidewell.operators import lexical_index as li
from tidewell.operators import records as rc
from tidewell.operators import retrieval as rt
from tidewell.operators import vector_index as vi
from tidewell.plans import catalog
from tidewell.sources import tables
from tidewell.streaming import stateful


def _documents(spark, folder, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_patches_of_long_texts(spark, tmp_path):
    lines = [f"line {i}" for i in range(6000)]
    lines[4000] = "the line"
    d = _documents(spark, tmp_path, ["\n".join(lines)] * 4)
    began = time.time()
    rows = catalog.queries()["f6_text_patches"](spark, d).collect()
    assert time.time() - began < 30
    assert [(r.old_start, r.old_lines) for r in rows] == [(3998, 7)] * 4


@pytest.mark.parametrize("old, new, want", [
    ("a\nb\n", "a\nb\n", None), ("", "a", (1, 0, 1, ["+a"])), ("a", "", (1, 1, 0, ["-a"])), ("a\nb", "a\nb\nb", (1, 2, 3, [" a", " b", "+b"])),
    ("a\na\na", "a\na", (1, 3, 2, [" a", " a", "-a"])), ("0\n1\n2\n3\n4\n5", "0\n1\n2\n3\nx\ny\n5", (2, 5, 6, [" 1", " 2", " 3", "-4", "+x", "+y", " 5"])),
])
def test_patches_of_short_texts(spark, old, new, want):
    p = spark.createDataFrame([(old, new)], "a string, b string").select(ma.line_patch(F.col("a"), F.col("b")).alias("p")).first()["p"]
    assert (p and tuple(p)) == want


def test_sections_of_long_texts(spark, tmp_path):
    d = _documents(spark, tmp_path, ["\n".join(f"section {i}" for i in range(1500))])
    began = time.time()
    assert catalog.queries()["h12_sections"](spark, d).count() == 1
    got = catalog.queries()["h12_sections"](spark, d).first()["digest"]
    assert time.time() - began < 30
    # heading, lines 1 and 2; the next heading is of a lower level, the one at 7 of the same
    want = spark.range(1).select(F.md5(F.lit("# section 0\nsection 1\nsection 2\n## section 3\nsection 4\nsection 5\nsection 6").cast("binary"))).first()[0]
    assert got == want


def test_sections_of_short_texts(spark):
    rows = [(None, ""), ("x\n## A tion\ny\n### b\n# c\nz", "## A tion\ny\n### b"), ("tion\n# no", ""), ("x\n# TION", "# TION")]
    got = spark.createDataFrame(rows, "t string, want string").select(pg.section(F.col("t"), "Tion").alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_large_teams_are_shared_by_tasks(spark):
    members = spark.range(4000).coalesce(1).select(F.lit(1).alias("team"), F.col("id").alias("member"))
    rows = rc.fan_out(members.filter("member < 100").withColumnRenamed("member", "sender"), members)
    made = [r["n"] for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(made) == 100 * 3999 and max(made) < sum(made)
    assert rows.columns == ["team", "sender", "member"]


def test_messages_that_are_repeated_for_cells_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(rc, "CELL_MEMBERS", 8)
    sizes = {1: 100, 2: 7, 3: 1}
    people = spark.createDataFrame([(t, 1000 * t + i) for t, n in sizes.items() for i in range(n)] + [(None, 5), (4, None)], "team int, member long")
    rows = rc.fan_out(people.filter("member % 3 = 0").withColumnRenamed("member", "sender"), people)
    lines = rows._jdf.queryExecution().sparkPlan().toString().splitlines()
    join = next(i for i, line in enumerate(lines) if "Join" in line)
    assert "SortMergeJoin" in lines[join] and any("Generate explode" in line for line in lines[join:])
    want = sorted((t, s, m) for t, n in sizes.items() for s in range(1000 * t, 1000 * t + n) if s % 3 == 0 for m in range(1000 * t, 1000 * t + n) if m != s)
    assert sorted((r.team, r.sender, r.member) for r in rows.collect()) == want


class _Kept:
    """A state's values by key, in memory; a value state has one of key ()."""

    def __init__(self):
        self.of = {}

    exists, get, clear = (lambda self: () in self.of), (lambda self: self.of.get((), ())), (lambda self: self.of.clear())
    update = put = lambda self, value: self.of.__setitem__((), value)
    appendList = lambda self, more: self.of.__setitem__((), [*self.get(), *more])
    getValue, updateValue, removeKey = (lambda self, k: self.of.get(k)), (lambda self, k, v: self.of.__setitem__(k, v)), (lambda self, k: self.of.pop(k, None))


@pytest.mark.parametrize("files", [1, 40])
def test_rows_that_wait_are_folded_a_few_at_a_time(monkeypatch, files):
    for name, n in (("RUN", 20_000), ("PIECE", 500), ("FAN", 8), ("ROWS", 1000)):
        monkeypatch.setattr(stateful, name, n, raising=False)
    rng, n, held, seen = np.random.default_rng(5), 200_000, [], []
    rows = pd.DataFrame({"fold_key": rng.choice(["a", "b"], n), "at": rng.integers(0, 9000, n) * 1_000_000, "place": rng.permutation(n), "closing": 0})

    def step(state, row):
        held.append(pa.total_allocated_bytes() if len(seen) % 1000 == 0 else 0)
        seen.append(row)
        return (state or 0) + 1, (row[1], (state or 0) + 1)

    timers, before = set(), pa.total_allocated_bytes()
    made = lambda *a: _Kept()
    handle = SimpleNamespace(getValueState=made, getListState=made, getMapState=made, registerTimer=timers.add, deleteTimer=timers.remove)
    fold = stateful._Fold(step, ["fold_key", "at", "place"], ["at", "place"], ["k", "place", "nth"])
    fold.init(handle)
    for part in np.array_split(np.arange(n), files):
        assert list(fold.handleInputRows((1,), (rows.iloc[b] for b in np.array_split(part, -(-len(part) // 10_000))), None)) == []
    out = []
    for passed in (2_000_000, 2_000_500, 5_000_000, 9_000_000):
        now = SimpleNamespace(getCurrentWatermarkInMs=lambda passed=passed: passed)
        assert len(timers) == 1
        if min(timers) <= passed:
            timers.clear()
            out += list(fold.handleExpiredTimer((1,), now, None))
            assert len(seen) == (rows["at"] <= passed * 1000).sum()
    # all rows are 5 MB of columns
    assert max(held) - before < 1_000_000
    assert not timers and fold._known() == [] and not fold.pieces.of
    want = rows.sort_values(["at", "place"])
    assert seen == list(zip(want["at"].tolist(), want["place"].tolist(), strict=True))
    assert (pd.concat(out)["nth"].to_numpy() == want.groupby("fold_key").cumcount().to_numpy() + 1).all()


def test_a_full_read_cache_finds_its_oldest_entry_at_once():
    step, state = stateful.read_cache_step(500), None
    began = time.time()
    for i in range(300_000):
        state, (_, hit) = step(state, (i, i, f"f{i}", 0, 100, 0))
        assert not hit
    assert time.time() - began < 6 and list(state) == [f"f{i}" for i in range(299_500, 300_000)]


def test_products_with_very_many_centres_are_bounded():
    """8192 rows by 30 000 centres are 2 GB of products at once."""
    unit = np.eye(16)[np.arange(30_000) % 16] * np.linspace(1, 0.5, 30_000)[:, None]
    x = np.eye(16)[np.arange(8192) % 16]
    tracemalloc.start()
    near = vi._near(x, unit)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (near == np.arange(8192) % 16).all() and peak < 200e6
    assert vi._near(np.zeros((0, 16)), unit).shape == (0,)


def test_centres_beyond_a_block_all_count(spark, tmp_path, monkeypatch):
    """43 centres in blocks of 7, copies and odd rows among them: every row lies in the list of the nearest of all."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(200)] + [(200 + i, [1.0] * 8) for i in range(15)] + [(301, None), (302, [0.0] * 8), (303, [2.0] * 3)]
    v = spark.createDataFrame(rows, "key long, embedding array<double>").repartition(3)
    x = np.array([e if e is not None and len(e) == 8 else [0.0] * 8 for _, e in rows])
    centres = np.array([e for k, e in rows if k % 5 == 0 and k < 215])
    near = (x @ (centres / np.linalg.norm(centres, axis=1)[:, None]).T).round(9).argmax(1)
    asked = v.filter("key % 10 = 0").select(F.col("key").alias("qid"), F.col("embedding").alias("q"))
    probes, lists = [], []
    for most in (vi.MOST_NUMBERS, 7 * 8):
        monkeypatch.setattr(vi, "MOST_NUMBERS", most)
        path = str(tmp_path / f"ix{most}")
        held = vi.build(v, path, rounds=0, seeds=v.filter("key % 5 = 0 and key < 215"))
        found = {r.key: r.list for r in tables.read(spark, held, "lists", "key long, embedding array<double>, version int, list int").collect()}
        assert len(centres) == 43 and found == {k: n for (k, _), n in zip(rows, near.tolist(), strict=True)}
        probes.append({(r.qid, r.list, r.rows) for r in vi.probes(spark, path, asked, 60).collect()})
        # the fit in blocks too; rows added later find the same lists
        fitted = vi.build(v, f"{path}fit", lists=30, rounds=1)
        fitted = vi.upsert(spark, f"{path}fit", v.filter("key < 50"))
        lists.append(sorted((r.key, r.list) for r in tables.read(spark, fitted, "lists", "key long, embedding array<double>, version int, list int").collect()))
        assert tables.read(spark, fitted, "centres", "list int, centre array<double>").count() == 30
    assert probes[0] == probes[1] and lists[0] == lists[1] and len({n for _, n in lists[0]}) > 14


def test_blocks_of_postings_come_in_few_batches():
    rows = sorted((t % 3, f"t{t}", i, 1 + i % 4, 5 + i % 7) for t in range(300) for i in range(1 + t * 7 % 290))
    kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    cut = lambda a, b: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[a:b]), kinds, strict=True)], ["bucket", "term", "id", "tf", "len"])
    for size in (1, 1000, len(rows)):
        part = rows[:700] if size == 1 else rows
        batches = [cut(i, min(i + size, len(part))) for i in range(0, len(part), size)]
        made = list(li._blocks(iter(batches), 128))
        assert len(made) <= len(batches) + 1
        want = []
        for (b, t), g in itertools.groupby(part, key=lambda r: r[:2]):
            g = list(g)
            for at in range(0, len(g), 128):
                p = g[at : at + 128]
                want.append({"bucket": b, "term": t, "n": len(p), "max_tf": max(x[3] for x in p), "min_len": min(x[4] for x in p), "entries": [{"id": x[2], "tf": x[3], "len": x[4]} for x in p]})
        assert [r for m in made for r in m.to_pylist()] == want
    assert list(li._blocks(iter([]), 128)) == []


def test_chunks_of_many_documents_need_no_call_each(spark):
    said = spark.range(20_000).select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("position")).withColumns({"sentence": F.concat(F.lit("s"), F.col("position").cast("string")), "embedding": F.array(F.lit(1.0))})
    chunks = rt.semantic_chunks(said.withColumn("embedding", F.when(F.col("id") % 2 == 0, F.col("embedding"))))
    assert "FlatMapGroupsInPandas" not in chunks._jdf.queryExecution().toString()
    assert chunks.groupBy("chunk", "position").count().collect() == [("s0 s1", 0, 20_000)]
