"""Operators and expressions on small hand-made rows."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tidewell.functions import numeric as nm
from tidewell.functions import text as tx
from tidewell.functions import vectors as vx
from tidewell.operators import metrics as mt
from tidewell.operators import records as rc
from tidewell.operators import retrieval as rt
from tidewell.operators import schedules as sc
from tidewell.operators import search as se
from tidewell.sources import files as fs


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_quantiles_are_values_of_the_data(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (3, 1, 4, 1, 5, 9, 2, 6)], "k string, v double")
    r = nm.summary(df, ["k"], "v").first()
    assert (r.p25, r.median, r.n) == (1.0, 3.0, 8) and r.std_dev == pytest.approx(2.748376143938713)


def test_cosine_guards(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, [])]
    df = spark.createDataFrame(rows, "key int, embedding array<float>")
    got = {r.key: r.score for r in df.withColumn("score", vx.cosine(F.col("embedding"), vx.literal([1.0, 0.0]))).collect()}
    assert got[1] == pytest.approx(1.0) and got[2] == got[3] == got[4] == 0


def test_metadata_filter_takes_a_missing_key_as_empty(spark):
    df = spark.createDataFrame([(1, {"a": "x"}), (2, {"b": "y"}), (3, {"a": "z"})], "id int, metadata map<string,string>")
    assert [r.id for r in df.filter(rt.metadata_filter({"a": ""})).collect()] == [2]
    assert [r.id for r in df.filter(rt.metadata_filter({"a": ["x", "z"]})).orderBy("id").collect()] == [1, 3]


def test_bm25_without_a_match(spark):
    docs = spark.createDataFrame([(1, "quick brown fox"), (2, "slow green turtle"), (3, None)], "id long, text string")
    assert rt.bm25(docs, "zebra").count() == 0
    assert [r.id for r in rt.bm25(docs, "the quick fox").collect()] == [1]


def test_hybrid_prefers_the_lexical_match(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "key long, embedding array<float>")
    docs = spark.createDataFrame([(1, "an unrelated text"), (2, "the quick brown fox jumps")], "id long, text string")
    assert rt.hybrid(vectors, rt.bm25(docs, "quick fox"), [1.0, 0.0], 0.7, 2).first().key == 2


def test_hard_cuts_stay_within_bytes():
    parts = rt.hard_cut("é" * 50 + " tail", 33)
    assert all(len(p.encode()) <= 33 for p in parts) and "".join(parts).replace(" ", "") == "é" * 50 + "tail"


def test_upsert_takes_the_last_version(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, version int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (4, "e", 1)], "id int, v string, version int")
    assert {r.id: r.v for r in rt.upsert(old, new, ["id"]).collect()} == {1: "a", 2: "d", 4: "e"}


def test_irr_and_npv(spark):
    flows = F.array(*[F.lit(float(v)) for v in (-100, 60, 60)])
    rate = _one(spark, nm.irr(flows))
    assert rate == pytest.approx(0.13066238629, abs=1e-6)
    assert _one(spark, nm.npv(flows, F.lit(rate))) == pytest.approx(0, abs=1e-4)


def test_temperatures(spark):
    assert _one(spark, nm.convert_temperature(F.lit(-300.0), "C", "K")) is None
    assert _one(spark, nm.convert_temperature(F.lit(212.0), "F", "C")) == pytest.approx(100)


def test_circuit_breaker_opens_tries_and_closes(spark):
    rows = [(1, i, i * 1, True) for i in range(5)] + [(1, 5, 10, False), (1, 6, 80, True), (1, 7, 90, False), (1, 8, 150, False), (1, 9, 151, True)]
    df = spark.createDataFrame(rows, "u int, n int, s long, failed boolean").withColumn("ts", F.timestamp_seconds("s"))
    out = [r.state for r in mt.circuit_breaker(df, "u", "failed", "ts", ["ts", "n"]).orderBy("n").collect()]
    assert out == ["closed"] * 4 + ["open", "open", "open", "open", "closed", "closed"]


def test_cron_fields():
    assert sc.cron_field("*/20", 0, 59) == [0, 20, 40] and sc.cron_field("1-5/2,9", 0, 23) == [1, 3, 5, 9]
    for wrong in ("60", "5-1", "*/0"):
        with pytest.raises(ValueError):
            sc.cron_field(wrong, 0, 59)


def test_globs_and_wildcards(spark):
    match = lambda p, s: _one(spark, F.lit(s).rlike(p))
    assert match(tx.glob_pattern("src/**/*.py"), "src/a/b/c.py") and not match(tx.glob_pattern("src/*.py"), "src/a/c.py")
    assert match(tx.wildcard_pattern("HTTP*x?z"), "https://a/b/xyz") and not match(tx.wildcard_pattern("a?c"), "abbc")


def test_stable_ids_and_sizes(spark):
    import hashlib

    want = int.from_bytes(hashlib.sha256(b"ns\0key").digest()[:8], "little")
    assert _one(spark, tx.stable_id(F.lit("ns"), F.lit("key"))) == str(want)
    assert [_one(spark, tx.human_size(F.lit(n))) for n in (5, 1536, 3 << 20)] == ["5 B", "1.5 KB", "3.0 MB"]


def test_grep_and_context(spark):
    docs = spark.createDataFrame([(1, "a\nhit\nb\nc\nd\nHIT"), (2, None), (3, "none")], "id long, text string")
    assert [(r.id, r.number) for r in se.grep(docs, "hit", ignore_case=True).collect()] == [(1, 2), (1, 6)]
    assert [r.number for r in se.context_lines(docs, "hit", 1).orderBy("number").collect()] == [1, 2, 3]
    assert se.grep(docs, "hit", ignore_case=True, offset=1).count() == 1


def test_domain_rules(spark):
    hosts = spark.createDataFrame([(1, "a.example.org"), (2, "example.org"), (3, "badexample.org"), (4, "x.net")], "id int, host string")
    domains = spark.createDataFrame([("example.org",)], "domain string")
    assert sorted(r.id for r in se.domain_rules(hosts, domains, True).collect()) == [1, 2]
    assert sorted(r.id for r in se.domain_rules(hosts, domains, False).collect()) == [3, 4]


def test_message_rows(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "  first line\nsecond"), (1, 2, "assistant", "answer"), (1, 3, "user", ""), (1, 4, "other", "x")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    s = rc.session_summary(t).first()
    assert (s.messages, s.turns, s.asked, s.title) == (5, 5, 2, "first line")
    assert [r.turn for r in rc.last_turns(t, 1).orderBy("turn").collect()] == [3, 4]
    assert rc.transcript(t).first().transcript == "user:   first line\nsecond\nassistant: answer\nuser: "
    assert [r.turn for r in rc.preserved_tail(t, F.lit(10), 15).orderBy("turn").collect()] == [3, 4]
    assert rc.canonical(t).count() == 4


def test_relations_and_inserts(spark):
    relations = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "a")], "source string, target string")
    names = spark.createDataFrame([("a",)], "name string")
    assert rc.touching(relations, names).count() == 2
    old, new = spark.createDataFrame([("x", 1)], "name string, id int"), spark.createDataFrame([("x", 2), ("y", 4), ("y", 3), (" ", 5)], "name string, id int")
    assert [tuple(r) for r in rc.insert_or_ignore(old, new, ["name"], "id").collect()] == [("y", 3)]


def test_memory_scores(spark):
    assert _one(spark, rc.importance(F.lit(120), F.lit(4))) == pytest.approx(0.9)
    assert _one(spark, rc.relevance(F.lit(1.0), F.lit(1.0), F.lit(0), F.lit(True), F.lit(3))) == 1.0
    assert _one(spark, rc.relevance(F.lit(0.5), F.lit(0.5), F.lit(None).cast("int"), F.lit(False), F.lit(0))) == pytest.approx(0.3)


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\nthree\n")
    got = [(r.number, r.line) for r in fs.text_lines(spark, str(tmp_path / "a.txt"), 1, 2).collect()]
    assert got == [(2, "two"), (3, "three")]
    (tmp_path / "b.bin").write_bytes(b"ab\0cd")
    (tmp_path / "c.dat").write_bytes(b"%PDF-1.7")
    kinds = {r.path.rsplit("/", 1)[1]: r.kind for r in fs.artifacts(spark, str(tmp_path)).collect()}
    assert kinds == {"a.txt": "text", "b.bin": "binary", "c.dat": "pdf"}


def test_notebooks_and_logs(spark):
    book = json.dumps({"cells": [{"cell_type": "code", "source": ["a = 1\n", "a"], "outputs": [{"output_type": "stream", "text": ["1"]}]}, {"cell_type": "markdown", "source": ["# t"]}]})
    cells = fs.notebook_cells(spark.createDataFrame([("p", book)], "path string, text string")).orderBy("position").collect()
    assert [(c.kind, c.source, c.outputs) for c in cells] == [("code", "a = 1\na", "1"), ("markdown", "# t", "")]
    logs = spark.createDataFrame([(1, '{"a":"1"}'), (2, '{"api_key":"k","m":"x"}'), (3, '{"b":"' + "y" * 99 + '"}')], "offset long, line string")
    out = [json.loads(r.line) for r in fs.log_tail(logs, 2, most=60).collect()]
    assert out == [{"api_key": "[REDACTED]", "m": "x"}, {"a": "1"}]


def test_write_to_all(spark, tmp_path):
    fs.write_to_all(spark.range(5), fs.files_sink(str(tmp_path / "a")), fs.files_sink(str(tmp_path / "b"), "parquet"))
    assert spark.read.json(str(tmp_path / "a")).count() == spark.read.parquet(str(tmp_path / "b")).count() == 5


def test_stream_breaker_equals_batch(spark, tmp_path):
    from tidewell.streaming import events as ev

    rows = [(i, i, i % 2, "error" if i % 7 else "view", 1.0, None) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double, props string").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    df.select("event_id", "ts", "user_id", "event_type", "value", "props").coalesce(1).write.parquet(str(tmp_path / "e"))
    got = {r.event_id: r.state for r in ev.drain(ev.breaker_states(ev.event_stream(spark, str(tmp_path / "e")))).collect()}
    batch = mt.circuit_breaker(df.withColumn("failed", F.col("event_type") == "error"), "user_id", "failed", "ts", ["ts", "event_id"])
    assert got == {r.event_id: r.state for r in batch.collect()} and "open" in got.values()
    assert not math.isnan(len(got))


def test_stream_once_over_many_files_without_order(spark, tmp_path):
    from tidewell.streaming import events as ev

    # 20 files, later files with earlier times; ids of the first file come again days apart in the last
    for k in range(20):
        rows = [(i if k < 19 else i - 19 * 10, (20 - k) * 86_400 + i) for i in range(k * 10, k * 10 + 10)]
        df = spark.createDataFrame(rows, "event_id long, s long").withColumn("ts", F.timestamp_seconds("s"))
        df.selectExpr("event_id", "ts", "1L AS user_id", "'view' AS event_type", "1D AS value", "'' AS props").coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    got = sorted(r.event_id for r in ev.drain(ev.once(ev.event_stream(spark, str(tmp_path / "e"))).select("event_id")).collect())
    assert got == list(range(190))


def test_stream_breaker_with_a_hot_user_in_files_without_order(spark, tmp_path):
    from tidewell.streaming import events as ev

    # 12,000 events of one user, dealt over 24 files against the order of time
    df = spark.range(12_000).selectExpr("id AS event_id", "timestamp_seconds(id * 7) AS ts", "if(id % 40 = 39, 2L, 1L) AS user_id", "if(pmod(hash(id), 100) < 70, 'error', 'view') AS event_type", "1D AS value", "'' AS props")
    for k in range(24):
        df.filter(f"pmod(event_id * 7 + event_id div 500, 24) = {23 - k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    got = {r.event_id: r.state for r in ev.drain(ev.breaker_states(ev.event_stream(spark, str(tmp_path / "e")))).collect()}
    want, held = {}, {}
    for r in df.orderBy("ts", "event_id").collect():
        state, row, since = held.get(r.user_id, ("closed", 0, None))
        now, bad = r.ts.timestamp(), r.event_type == "error"
        if state == "open" and now - since >= 60:
            state = "half_open"
        if state == "half_open":
            state, row, since = ("open", 5, now) if bad else ("closed", 0, since)
        elif state == "closed":
            row = row + 1 if bad else 0
            if row >= 5:
                state, since = "open", now
        held[r.user_id] = state, row, since
        want[r.event_id] = state
    assert len(got) == 12_000 and got == want
