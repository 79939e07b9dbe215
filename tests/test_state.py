"""State in the stream: any order of files, any cut into triggers, restarts, and sinks that fail half-way."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import metrics as mt
from tidewell.streaming import delivery, stateful


def _events(spark, path, rows, files, seed=1):
    """(user_id, event_id, seconds, failed) dealt into files at random."""
    rng = random.Random(seed)
    rows = [(*r, rng.randrange(files)) for r in rows]
    df = spark.createDataFrame(rows, "user_id long, event_id long, s double, failed boolean, f int").withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long") + 10**15))
    for f in range(files):
        df.filter(F.col("f") == f).select("user_id", "event_id", "ts", "failed").coalesce(1).write.mode("append").parquet(path)
    return df.select("user_id", "event_id", "ts", "failed")


def _fold(spark, path, step, columns, out, late="400 days", runs=1, base=None, each=1):
    def source(closing):
        rows = spark.readStream.schema("user_id long, event_id long, ts timestamp, failed boolean").option("maxFilesPerTrigger", each).parquet(path)
        return stateful.ordered_fold(stateful.with_closing(rows, closing), "user_id", "ts", "event_id", columns, step, out, late)

    return stateful.run_closed(source, spark, base, runs)


def test_breaker_is_the_batch_fold_whatever_the_files(spark, tmp_path):
    rng, rows, now = random.Random(7), [], 0.0
    for i in range(400):
        now += rng.choice([0.5, 1, 5, 61])
        rows.append((rng.randint(1, 3), i, now, rng.random() < 0.75))
    df = _events(spark, str(tmp_path / "in"), rows, 5)
    want = sorted((r.user_id, r.event_id, r.state) for r in mt.circuit_breaker(df, "user_id", "failed", "ts", ["ts", "event_id"]).join(df, ["user_id", "event_id"]).collect())
    got = sorted(tuple(r) for r in _fold(spark, str(tmp_path / "in"), stateful.breaker_step(), ["failed"], "event_id long, state string", runs=2).collect())
    assert got == want
    assert {s for _, _, s in got} == {"closed", "open"}


def test_rows_wait_for_the_watermark_and_go_on_after_a_restart(spark, tmp_path):
    path, base = str(tmp_path / "in"), str(tmp_path / "run")
    _events(spark, path, [(1, i, 10.0 * i, True) for i in range(30)], 1)

    def source(closing):
        rows = spark.readStream.schema("user_id long, event_id long, ts timestamp, failed boolean").parquet(path)
        return stateful.ordered_fold(stateful.with_closing(rows, closing), "user_id", "ts", "event_id", ["failed"], stateful.breaker_step(), "event_id long, state string", "100 seconds")

    # without a closing row those of the last 100 seconds wait in the state
    first = stateful.run_closed(source, spark, base, close=False)
    assert sorted(r.event_id for r in first.collect()) == list(range(20))
    again = stateful.run_closed(source, spark, base)
    assert [r.state for r in again.orderBy("event_id").collect()] == (["closed"] * 4 + ["open"] * 7 + ["open"] * 19)


def test_half_open_lets_three_trials_in():
    step = stateful.breaker_step(most=2, reset=10)
    state, seen = None, []
    for s, failed in ((0, True), (1, True), (5, False), (12, True), (13, False), (23, False), (24, True)):
        state, (_, name) = step(state, (s * 1_000_000, s, failed))
        seen.append(name)
    assert seen == ["closed", "open", "open", "open", "open", "closed", "closed"]


def _cache(reads, entries, age):
    """Plain cache: [(at, path, start, size, mtime)] to hits."""
    held, out = [], []
    for at, path, start, size, mtime in reads:
        old = next((h for h in held if h[0] == path), None)
        hit = old is not None and old[1:4] == (start, size, mtime) and at - old[4] <= age
        out.append(hit)
        if not hit:
            if len(held) >= entries:
                held.remove(min(held, key=lambda h: h[4]))
            held = [h for h in held if h[0] != path] + [(path, start, size, mtime, at)]
    return out


def test_read_cache_equals_a_plain_one():
    rng, now, reads = random.Random(11), 0, []
    for _ in range(5000):
        now += rng.choice([1, 3, 600])
        reads.append((now, f"f{rng.randrange(12)}", rng.randrange(2), 100, now // 4000))
    for entries, age in ((500, 7200), (4, 7200), (1, 50), (6, 900)):
        step, state, got = stateful.read_cache_step(entries, age), None, []
        for i, (at, *rest) in enumerate(reads):
            state, (_, hit) = step(state, (at * 1_000_000, i, *rest))
            got.append(hit)
        assert got == _cache(reads, entries, age) and any(got) and not all(got)
        assert len(state) <= entries


def test_a_batch_that_dies_half_way_is_delivered_once(spark, tmp_path):
    path, base = str(tmp_path / "in"), str(tmp_path / "run")
    _events(spark, path, [(1, i, float(i), False) for i in range(60)], 3)
    tries, dropped = {"bad": 0, "late": 0}, {}

    def failing_once(batch, number):
        delivery.put_batch(f"{base}/must")(batch, number)
        if number == 1 and tries["bad"] == 0:
            tries["bad"] += 1
            raise OSError("lost half-way")

    def never(batch, number):
        tries["late"] += 1
        raise OSError("full")

    handled = []
    sinks = {"plain": lambda b, n: handled.append(n) or delivery.put_batch(f"{base}/plain")(b, n), "must": failing_once, "never": never}
    sink = delivery.fan_out(sinks, f"{base}/progress", {"must", "plain"}, dropped)

    def run():
        rows = spark.readStream.schema("user_id long, event_id long, ts timestamp, failed boolean").option("maxFilesPerTrigger", 1).parquet(path)
        rows.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
        return rows.schema

    with pytest.raises(Exception, match="lost half-way"):
        run()
    schema = run()
    for name in ("must", "plain"):
        ids = [r.event_id for r in delivery.batches_written(spark, f"{base}/{name}", schema).collect()]
        assert sorted(ids) == list(range(60))
    # the sink that had taken the batch did not get it again; the best-effort one lost every batch, once
    assert handled == [0, 1, 2] and dropped == {"never": 3} and tries["late"] == 3


def test_an_inbox_marks_before_it_handles(spark, tmp_path):
    path, base, calls = str(tmp_path / "in"), str(tmp_path / "run"), []
    _events(spark, path, [(1, i, float(i), False) for i in range(20)], 2)

    def handle(batch, number):
        calls.append((number, batch.count()))
        if number == 0:
            raise OSError("handler failed")

    def run():
        rows = spark.readStream.schema("user_id long, event_id long, ts timestamp, failed boolean").option("maxFilesPerTrigger", 1).parquet(path)
        rows.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(delivery.inbox(handle, f"{base}/read")).start().awaitTermination()

    with pytest.raises(Exception, match="handler failed"):
        run()
    run()
    # what the handler failed on is read all the same, and not handled twice
    assert [n for n, _ in calls] == [0, 1]
    assert spark.read.parquet(f"{base}/read").count() == 20


def test_drains_keep_a_repeated_batch_once(spark, tmp_path):
    put = delivery.put_batch(str(tmp_path / "out"))
    some = spark.range(5)
    put(some, 0)
    put(some, 0)
    put(spark.range(2), 1)
    assert delivery.batches_written(spark, str(tmp_path / "out"), some.schema).count() == 7
    assert delivery.batches_written(spark, str(tmp_path / "out"), some.schema, last_only=True).count() == 2
    assert delivery.batches_written(spark, str(tmp_path / "none"), some.schema).count() == 0
