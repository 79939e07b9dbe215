"""Upkeep and boundary records on small rows."""

from pyspark.sql import functions as F

from tidewell.operators import boundaries as bo
from tidewell.operators import upkeep as up


def test_a_dry_run_reports_and_keeps(spark):
    rows = [("a", "x", 5), ("b", "x", 15), ("c", "y", 5), ("d", None, 5), ("e", "x", None)]
    items = spark.createDataFrame(rows, "key string, namespace string, s long").select("key", "namespace", F.timestamp_seconds("s").alias("expires"))
    now = F.timestamp_seconds(F.lit(5))
    for spaces, gone in ((None, {"a", "c", "d"}), (["x"], {"a"}), (["z"], set())):
        left, report = up.collected(items, now, spaces)
        assert {r.key for r in left.collect()} == set("abcde") - gone
        assert sum(r.deleted for r in report.collect()) == len(gone) and sum(r.scanned for r in report.collect()) == 5
        dry, same = up.collected(items, now, spaces, dry=True)
        assert dry.count() == 5 and sorted(same.collect(), key=str) == sorted(report.collect(), key=str)
    assert up.collected(items.limit(0), now)[1].count() == 0


def test_globs_have_base_folders(spark):
    from tidewell.operators.rules import base_folder

    globs = ["src/**/*.py", "*.md", "/*.txt", "a/b/c.txt", "C:/*.txt", "a/b{1,2}/c", "plain", "/x", "a\\b*", "é/ü?.x", ""]
    got = spark.createDataFrame([(g,) for g in globs], "g string").select("g", up.glob_base(F.col("g")).alias("b")).collect()
    assert [(r.b.folder, r.b.rest) for r in got] == [base_folder(g) for g in globs]


def test_every_mistake_of_a_record_is_told(spark):
    schema = "s int, seq int, id string, turn int, uses string, answers string"
    rows = [(1, 0, "a", 1, "t1", None), (1, 1, "b", 1, "", "t1"), (1, 2, "c", 2, "", None), (2, 0, "d", 1, "", "t9"), (3, 0, "e", 1, "", ""), (4, 0, "f", 1, "", "t4"), (4, 1, "g", 1, "t4", None)]
    messages = spark.createDataFrame(rows, schema)
    starts = spark.createDataFrame([(i, 0) for i in range(1, 5)] + [(5, 0)], "s int, start int")
    found = bo.records(bo.tails(messages, starts, "s", "seq"), starts, "s", "seq", ["id"]).collect()
    by = {r.s: r for r in found}
    assert (by[1].messages, by[1].turns, by[1].tool_pairs, by[1].first_id, by[1].last_id, by[1].fault) == (3, 2, 1, "a", "c", None)
    assert [by[i].fault for i in (2, 3, 4)] == ["orphaned result of t9", "result without a call's name", "result before its call t4"]
    assert (by[5].messages, by[5].first_id, by[5].fault) == (0, "", None)
    changes = [("version", 3), ("messages", 9), ("turns", 9), ("tool_pairs", 9), ("first_id", ""), ("first_id", "x"), ("last_id", "x"), ("tail_hash", ""), ("tail_hash", "x")]
    told = []
    for field, value in changes:
        claim = {f: by[1][f] for f in bo.FIELDS} | {field: value}
        df = spark.createDataFrame([(1, *claim.values())], "s int, version int, messages long, turns long, tool_pairs long, first_id string, last_id string, tail_hash string")
        told.append(bo.problems(df, spark.createDataFrame(found), "s").first().problem)
    assert told == ["unknown version 3", "messages mismatch: 9 for 3", "turns mismatch: 9 for 2", "tool_pairs mismatch: 9 for 1", "missing ids", "first_id mismatch: x for a", "last_id mismatch: x for c", "missing tail_hash", "tail_hash mismatch"]
