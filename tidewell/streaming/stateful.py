"""Machines whose state lives in the stream: rows are put in event order, then folded one by one.

Rows wait in state until the watermark has passed them; a timer then takes those that are due, in order,
through ``step`` and keeps what is left. They wait as sorted runs of small pieces, which are merged piece by
piece, so a task holds a bounded number of rows however many wait. Keys share a fixed number of states, so
many keys cost no calls of their own. What the fold carries is one small value a key, so a restart goes on from the checkpoint, and
neither the order of files nor the cut into triggers changes a result. Rows later than the watermark are left out, as in any windowed stream.
"""

from __future__ import annotations

import pickle
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tidewell.session import shared_dir
from tidewell.streaming.delivery import batches_written, put_batch

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
Step = Callable[[Any, tuple], tuple[Any, tuple | None]]


#: Keys are dealt into so many states. A state costs some calls a trigger, whatever the number of its rows.
STATES = 512
#: Rows that are worked on at once as Python values; all others wait as columns.
ROWS = 10_000
#: Rows that are sorted at once into a run, rows of a piece, and runs that are merged at once.
RUN, PIECE, FAN = 200_000, 5_000, 64
ORDER = [("at", "ascending"), ("place", "ascending")]


def _upto(rows: pa.Table, at: int, place: Any) -> int:
    """How many of the sorted rows stand at (at, place) or before; null places stand last."""
    times, said, rank = rows["at"].to_numpy(), rows["place"], lambda p: (p is None, p)
    lo, hi = (int(np.searchsorted(times, at, side)) for side in ("left", "right"))
    return lo + bisect_right(range(lo, hi), rank(place), key=lambda i: rank(said[i].as_py()))


class _Fold(StatefulProcessor):
    """Rows (key, at in microseconds, place, ...) of a share of the keys through ``step(state, row) -> (state,
    result)``, each key with a state of its own. Rows wait in sorted runs (number, first piece, end, time of the
    first row), cut into pieces of columns; one timer is set, for the first row of all."""

    def __init__(self, step: Step, columns: list[str], whole: list[str], out: list[str]):
        self.step, self.columns, self.whole, self.out = step, columns, whole, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "said binary")
        self.due = handle.getValueState("due", "at long")
        self.runs = handle.getValueState("runs", "said binary")
        self.pieces = handle.getMapState("pieces", "run long, nth long", "rows binary")

    def _timer(self, at: int) -> None:
        """Timers are in milliseconds; of two the earlier one is kept."""
        at = int(at // 1000 + 1)
        if self.due.exists():
            before = self.due.get()[0]
            if before <= at:
                return
            self.handle.deleteTimer(before)
        self.due.update((at,))
        self.handle.registerTimer(at)

    def _rows(self, part: pd.DataFrame) -> pa.Table:
        rows = pa.Table.from_pandas(part[self.columns], preserve_index=False).replace_schema_metadata(None)
        # whole numbers with nulls among them come as floats
        for i, name in enumerate(self.columns):
            if name in self.whole:
                rows = rows.set_column(i, name, rows.column(i).cast(pa.int64()))
        return rows

    def _known(self) -> list[list[int]]:
        return pickle.loads(self.runs.get()[0]) if self.runs.exists() else []

    def _put(self, run: list[int], nth: int, rows: pa.Table) -> None:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as writer:
            writer.write_table(rows)
        self.pieces.updateValue((run[0], nth), (sink.getvalue().to_pybytes(),))
        if nth == run[1]:
            run[3] = rows["at"][0].as_py()

    def _take(self, run: list[int]) -> pa.Table:
        rows = pa.ipc.open_stream(self.pieces.getValue((run[0], run[1]))[0]).read_all()
        self.pieces.removeKey((run[0], run[1]))
        run[1] += 1
        return rows

    def _new_run(self, runs: list[list[int]], tables: Iterator[pa.Table]) -> None:
        """A run of sorted tables that follow each other."""
        run, held = [max((r[0] for r in runs), default=0) + 1, 0, 0, 0], None
        for rows in tables:
            held = rows if held is None else pa.concat_tables([held, rows], promote_options="permissive")
            while len(held) >= PIECE:
                self._put(run, run[2], held.slice(0, PIECE))
                run[2], held = run[2] + 1, held.slice(PIECE)
        if held is not None and len(held):
            self._put(run, run[2], held)
            run[2] += 1
        runs.append(run)

    def _merged(self, runs: list[list[int]], until: int | None = None) -> Iterator[pa.Table]:
        """The runs' rows in order, a few pieces at a time, to ``until`` and no further; they are taken out of the runs."""
        runs = [r for r in runs if until is None or r[3] <= until]
        ahead: list[pa.Table | None] = [None] * len(runs)
        while True:
            bound = None
            for i, run in enumerate(runs):
                if (ahead[i] is None or not len(ahead[i])) and run[1] < run[2]:
                    ahead[i] = self._take(run)
                if run[1] < run[2]:
                    last = (ahead[i]["at"][-1].as_py(), ahead[i]["place"][-1].as_py())
                    bound = last if bound is None else min(bound, last, key=lambda b: (b[0], b[1] is None, b[1]))
            ready = []
            for i, rows in enumerate(ahead):
                if rows is not None and len(rows):
                    n = len(rows) if bound is None else _upto(rows, *bound)
                    if until is not None:
                        n = min(n, int(np.searchsorted(rows["at"].to_numpy(), until, "right")))
                    if n:
                        ready.append(rows.slice(0, n))
                        ahead[i] = rows.slice(n)
            if not ready:
                break
            yield ready[0] if len(ready) == 1 else pa.concat_tables(ready, promote_options="permissive").sort_by(ORDER)
        for run, rows in zip(runs, ahead, strict=True):
            if rows is not None and len(rows):
                run[1] -= 1
                self._put(run, run[1], rows)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        runs, blocks, n, first = self._known(), [], 0, []
        sort = lambda: iter([pa.concat_tables(blocks, promote_options="permissive").sort_by(ORDER)])
        for part in rows:
            # a row of no key closes the stream: it moves the watermark and nothing else
            part = part[(part["closing"] == 0) & part["at"].notna()]
            if len(part):
                blocks.append(self._rows(part))
                n += len(part)
            if n >= RUN:
                self._new_run(runs, sort())
                first.append(runs[-1][3])
                blocks, n = [], 0
        if blocks:
            self._new_run(runs, sort())
            first.append(runs[-1][3])
        if first:
            self.runs.update((pickle.dumps(runs),))
            self._timer(min(first))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self.due.clear()
        runs = self._known()
        while len(runs) > FAN:
            # the smallest ones, so that no row is merged often
            runs.sort(key=lambda r: r[2] - r[1])
            few = runs[: min(FAN, len(runs) - FAN + 1)]
            self._new_run(runs, self._merged(few))
            runs = runs[len(few) :]
        states = pickle.loads(self.held.get()[0]) if self.held.exists() else {}
        for due in self._merged(runs, passed):
            for at in range(0, len(due), ROWS):
                results = []
                for name, *row in zip(*(c.to_pylist() for c in due.slice(at, ROWS).columns), strict=True):
                    states[name], result = self.step(states.get(name), tuple(row))
                    if result is not None:
                        results.append((name, *result))
                if results:
                    yield pd.DataFrame(results, columns=self.out)
        runs = [r for r in runs if r[1] < r[2]]
        if runs:
            self.runs.update((pickle.dumps(runs),))
            self._timer(min(r[3] for r in runs))
        else:
            self.runs.clear()
        if states:
            self.held.update((pickle.dumps(states),))

    def close(self) -> None:
        pass


def ordered_fold(rows: DataFrame, key: str, ts: str, place: str, columns: list[str], step: Step, out: str, late: str = "1 hour") -> DataFrame:
    """(key, out...): the results of ``step(state, (microseconds, place, columns...))`` over each key's rows
    in the order of (ts, place). ``state`` is None at first and must be a plain value."""
    kinds = dict(rows.dtypes)
    slim = rows.select(F.pmod(F.xxhash64(key), F.lit(STATES)).alias("_state"), F.col(key).alias("fold_key"), F.col(ts).alias("_ts"), F.unix_micros(ts).alias("at"), F.col(place).alias("place"), *columns, F.col("_closing").alias("closing") if "_closing" in kinds else F.lit(0).alias("closing"))
    whole = [c for c, t in slim.dtypes if t in ("tinyint", "smallint", "int", "bigint")]
    result = StructType.fromDDL(f"{key} {kinds[key]}, {out}")
    fold = _Fold(step, ["fold_key", "at", "place", *columns], whole, result.fieldNames())
    return slim.withWatermark("_ts", late).groupBy("_state").transformWithStateInPandas(statefulProcessor=fold, outputStructType=result, outputMode="append", timeMode="eventTime")


def breaker_step(most: int = 5, reset: int = 60, trials: int = 3) -> Step:
    """Rows (at, place, failed) to ('place', 'state'): closed, open or half_open after each.

    ``most`` failures in a row open it. A row ``reset`` seconds later or more is a trial, of which ``trials``
    may be under way; one success closes the breaker, one failure opens it anew. Others are refused.
    """
    micros = reset * 1_000_000

    def step(state, row):
        at, place, failed = row
        name, failures, since, tried = state or ["closed", 0, 0, 0]
        if name == "open" and at - since >= micros:
            name, tried = "half_open", 0
        allowed = name == "closed" or name == "half_open" and tried < trials
        if allowed:
            tried += name == "half_open"
            failures = failures + 1 if failed else 0
            if failures >= most:
                name, since = "open", at
            elif name == "half_open" and not failures:
                name, tried = "closed", 0
        return [name, failures, since, tried], (place, name)

    return step


def queue_step(capacity: int, drain_every: int) -> Step:
    """Rows (at, place) to (place, kept, held, overflow): a queue that drops what it has no room for and is
    read once every ``drain_every`` rows."""

    def step(state, row):
        n, held, overflow = state or [0, 0, 0]
        kept = held < capacity
        n, held, overflow = n + 1, held + kept, overflow + (not kept)
        held -= n % drain_every == 0 and held > 0
        return [n, held, overflow], (row[1], kept, held, overflow)

    return step


def read_cache_step(entries: int = 500, age: int = 7200) -> Step:
    """Rows (at, place, path, start, size, mtime) to (place, hit): a cache of file reads.

    A read hits if the path was read last with the same start and size, at most ``age`` seconds ago, and
    its mtime is as it was. Any other read is kept in the path's place; a full cache loses its oldest
    entry first, even where the path itself is in it.
    """

    def step(state, row):
        at, place, path, start, size, mtime = row
        held = state or {}
        found = held.get(path)
        hit = found is not None and at - found[3] <= age * 1_000_000 and found[:3] == [start, size, mtime]
        if not hit:
            # entries stand in the order in which they were kept, which is that of the rows
            if len(held) >= entries:
                del held[next(iter(held))]
            held.pop(path, None)
            held[path] = [start, size, mtime, at, place]
        return held, (place, hit)

    return step


def run_closed(source: Callable[[DataFrame | None], DataFrame], spark: SparkSession, base: str | None = None, runs: int = 1, close: bool = True) -> DataFrame:
    """All results of a stream with a watermark over what is there now.

    ``source(closing)`` makes the stream from a stream of closing rows (ts), of which one of the far future
    is put in last: it moves the watermark beyond every row, so all that waits becomes due (without
    ``close`` it waits on). Each step is a run of its own that goes on from the checkpoint under ``base``.
    Rows of 1970 and before are late: Spark's watermark starts there.
    """
    base = base or f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    closing = f"{base}/closing"
    spark.createDataFrame([], "ts timestamp").write.mode("ignore").parquet(closing)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        for run in range(runs + close):
            if run == runs:
                spark.sql("SELECT timestamp'2200-01-01' AS ts").write.mode("append").parquet(closing)
            stream = source(spark.readStream.schema("ts timestamp").parquet(closing))
            writer = stream.writeStream.outputMode("append").option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
            writer.foreachBatch(put_batch(f"{base}/out")).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return batches_written(spark, f"{base}/out", stream.schema)


def with_closing(rows: DataFrame, closing: DataFrame, ts: str = "ts") -> DataFrame:
    """rows with the closing rows beneath, which have a mark and no other value."""
    empty = [F.lit(None).cast(t).alias(c) if c != ts else F.col("ts").alias(ts) for c, t in rows.dtypes]
    return rows.withColumn("_closing", F.lit(0)).union(closing.select(*empty, F.lit(1)))
