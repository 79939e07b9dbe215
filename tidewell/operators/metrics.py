"""Histograms, counters, gauges, tool statistics, streaks and circuit breakers over event rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.numeric import bucket_of

# Bounds of the latency histogram, in milliseconds.
TIMER_BOUNDS = [1, 5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000]


def histogram(df: DataFrame, by: str, value: str, bounds: list[float] = TIMER_BOUNDS) -> DataFrame:
    """(by, bucket, n): how many values fall into each bucket."""
    return df.groupBy(by, bucket_of(F.col(value), bounds).alias("bucket")).agg(F.count("*").alias("n"))


def histogram_percentile(hist: DataFrame, by: str, percent: float, bounds: list[float] = TIMER_BOUNDS) -> DataFrame:
    """(by, bound): upper bound of the first bucket at which the running count reaches the share."""
    # a group has as many rows as there are buckets
    w = Window.partitionBy(by)
    running = F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    need = F.greatest(F.lit(1), F.floor(F.sum("n").over(w) * percent / 100))
    hit = hist.select(by, "bucket", running.alias("running"), need.alias("need")).filter("running >= need").groupBy(by).agg(F.min("bucket").alias("bucket"))
    return hit.select(by, F.element_at(F.array(*[F.lit(float(b)) for b in bounds]), F.least(F.col("bucket") + 1, F.lit(len(bounds)))).alias("bound"))


def tool_stats(df: DataFrame, by: str, ok: str, took: str, order: list[str]) -> DataFrame:
    """Attempts, successes, failures and the integer mean that is truncated at every step. The mean
    depends on the order: rows are sorted by Spark, and four numbers are carried from row to row."""
    import pyarrow as pa

    kinds = dict(df.dtypes)

    def walk(batches):
        key, n, good, mean, any_ = None, 0, 0, 0, False
        for batch in batches:
            done = []
            for k, fine, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if not any_ or k != key:
                    if any_:
                        done.append((key, n, good, n - good, mean))
                    key, n, good, mean, any_ = k, 0, 0, 0, True
                mean = (mean * n + (t or 0)) // (n + 1)
                n, good = n + 1, good + bool(fine)
            if done:
                yield table(done)
        if any_:
            yield table([(key, n, good, n - good, mean)])

    def table(rows):
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0]), *[pa.array(c, pa.int64()) for c in cols[1:]]], [by, "attempts", "successes", "failures", "mean_ms"])

    ordered = df.repartition(by).sortWithinPartitions(by, *[F.asc_nulls_last(c) for c in order])
    slim = ordered.select(by, F.col(ok).alias("_ok"), F.col(took).cast("long").alias("_took"))
    return slim.mapInArrow(walk, f"{by} {kinds[by]}, attempts long, successes long, failures long, mean_ms long")


def learned_patterns(df: DataFrame, by: str, ok: str, message: str, ts: str, place: str, least: int = 3, most: int = 5, low: float = 0.5) -> DataFrame:
    """(by, attempts, success_rate, examples) of what was tried ``least`` times or more. Examples are the
    messages of the first ``most`` failures at which, from the least-th try on, fewer than ``low`` of the
    tries so far had succeeded. Tries so far are counted by hour first and inside the hour then, so a name
    of very many rows is dealt over its hours."""
    rows = df.select(by, F.col(ok).cast("int").alias("_ok"), F.col(message).alias("_said"), F.col(ts).alias("_ts"), F.col(place).alias("_place"), F.date_trunc("hour", ts).alias("_hour"))
    hours = rows.groupBy(by, "_hour").agg(F.count("*").alias("_n"), F.sum("_ok").alias("_good"))
    earlier = Window.partitionBy(by).orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    before = hours.select(by, "_hour", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("_n", "_good")))
    inside = Window.partitionBy(by, "_hour").orderBy("_ts", "_place").rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.withColumns({"_i": F.count("*").over(inside), "_g": F.sum("_ok").over(inside)}).join(before, [by, "_hour"])
    tries = counted.withColumns({"_try": F.col("_i") + F.col("_n_before"), "_won": F.col("_g") + F.col("_good_before")})
    bad = tries.filter((F.col("_ok") == 0) & (F.coalesce("_said", F.lit("")) != "") & (F.col("_try") >= least) & (F.col("_won") < low * F.col("_try")))
    first = bad.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy("_try"))).filter(F.col("_k") <= most)
    examples = first.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_k", "_said"))).alias("_e")).select(by, F.col("_e._said").alias("examples"))
    totals = hours.groupBy(by).agg(F.sum("_n").alias("attempts"), (F.sum("_good") / F.sum("_n")).alias("success_rate")).filter(F.col("attempts") >= least)
    return totals.join(examples, by, "left").withColumn("examples", F.coalesce("examples", F.array().cast("array<string>")))


def failure_streaks(df: DataFrame, by: str, failed: str, order: list[str]) -> DataFrame:
    """df with ``streak``: failures in a row up to and including each row; a success resets it."""
    w = Window.partitionBy(by).orderBy(*order)
    islands = df.withColumn("_island", F.sum((~F.col(failed)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(by, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return islands.withColumn("streak", F.sum(F.col(failed).cast("int")).over(inside)).drop("_island")


def denial_streaks(df: DataFrame, by: str, denied: str, ts: str, order: list[str], idle: int = 300) -> DataFrame:
    """As failure_streaks, but an idle gap of more than ``idle`` seconds starts again as well."""
    w = Window.partitionBy(by).orderBy(*order)
    gap = F.coalesce(F.unix_timestamp(ts) - F.unix_timestamp(F.lag(ts).over(w)) > idle, F.lit(False))
    starts = df.withColumn("_start", ((~F.col(denied)) | gap).cast("int"))
    starts = starts.withColumn("_island", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(by, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return starts.withColumn("streak", F.sum(F.col(denied).cast("int")).over(inside)).drop("_start", "_island")


def circuit_breaker(df: DataFrame, by: str, failed: str, ts: str, order: list[str], most: int = 5, reset: int = 60) -> DataFrame:
    """df's keys with ``state`` after each row: closed, open or half_open. ``most`` failures in a row
    open it; the first row after ``reset`` seconds is a trial that closes or opens it again (rows come one
    after the other, so no second trial runs beside it); rows in between are refused. A machine with feedback, so each key is walked in order."""
    import pyarrow as pa

    kinds = dict(df.dtypes)
    micros = reset * 1_000_000

    def walk(batches):
        # a key's rows follow each other in order: four values are carried from batch to batch
        key, state, row, since, first = None, "closed", 0, None, True
        for batch in batches:
            out = []
            at = batch.column(3).cast(pa.int64())  # microseconds
            for k, bad, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), at.to_pylist(), strict=True):
                if first or k != key:
                    key, state, row, since, first = k, "closed", 0, None, False
                if state == "open" and t is not None and since is not None and t - since >= micros:
                    state = "half_open"
                if state == "half_open":
                    state, row = ("open", most) if bad else ("closed", 0)
                    since = t if bad else since
                elif state == "closed":
                    row = row + 1 if bad else 0
                    if row >= most:
                        state, since = "open", t
                out.append(state)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], [by, order[-1], "state"])

    ordered = df.repartition(by).sortWithinPartitions(by, *[F.asc_nulls_last(c) for c in order])
    slim = ordered.select(by, order[-1], F.col(failed).alias("_bad"), F.col(ts).alias("_at"))
    return slim.mapInArrow(walk, f"{by} {kinds[by]}, {order[-1]} {kinds[order[-1]]}, state string")
