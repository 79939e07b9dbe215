"""Queries whose state lives in a stream, with SQL on the same rows where SQL can fold."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewell.plans.catalog import register
from tidewell.plans.stream_queries import _stream
from tidewell.session import shared_dir
from tidewell.streaming import delivery, stateful


def _folded(spark, d, prepare, key, columns, step, out):
    def source(closing):
        rows = stateful.with_closing(prepare(_stream(spark, d)), closing)
        return stateful.ordered_fold(rows, key, "ts", "event_id", columns, step, out)

    return stateful.run_closed(source, spark)


@register("e3_stream_states", """WITH RECURSIVE e AS (SELECT user_id, event_id, event_type = 'error' AS failed, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, 'closed' AS state, 0 AS failures, 0::BIGINT AS since FROM e GROUP BY user_id
 UNION ALL
 SELECT user_id, n, event_id, CASE WHEN was = 'open' THEN 'open' WHEN grown >= 5 THEN 'open' WHEN was = 'half_open' AND grown = 0 THEN 'closed' ELSE was END,
        CASE WHEN was = 'open' THEN failures ELSE grown END, CASE WHEN was <> 'open' AND grown >= 5 THEN t ELSE since END
 FROM (SELECT e.user_id, e.n, e.event_id, e.t, s.failures, s.since, CASE WHEN e.failed THEN s.failures + 1 ELSE 0 END AS grown,
              CASE WHEN s.state = 'open' AND e.t - s.since >= 60000000 THEN 'half_open' ELSE s.state END AS was
       FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1))
SELECT user_id, event_id, state FROM s WHERE n > 0""")
def e3(spark, d):
    """A breaker for each user, with its failures, time of opening and trials as state of the stream."""
    return _folded(spark, d, lambda e: e.select("user_id", "event_id", "ts", (F.col("event_type") == "error").alias("failed")), "user_id", ["failed"], stateful.breaker_step(), "event_id long, state string")


@register("e1_stream_queue", """WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
q AS (SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, true AS kept, 0::BIGINT AS held, 0::BIGINT AS overflow FROM e GROUP BY user_id UNION ALL
 SELECT q.user_id, e.n, e.event_id, q.held < 8, greatest(0, least(q.held + 1, 8) - CASE WHEN e.n % 3 = 0 THEN 1 ELSE 0 END), q.overflow + CASE WHEN q.held < 8 THEN 0 ELSE 1 END FROM q JOIN e ON e.user_id = q.user_id AND e.n = q.n + 1)
SELECT user_id, event_id, kept, held, overflow FROM q WHERE n > 0""")
def e1(spark, d):
    """A queue of eight for each user that is read at every third row; what finds it full is dropped and counted."""
    return _folded(spark, d, lambda e: e.select("user_id", "event_id", "ts"), "user_id", [], stateful.queue_step(8, 3), "event_id long, kept boolean, held long, overflow long")


@register("e5_file_reads")
def e5(spark, d):
    """Hits and misses of a cache of file reads for each kind of event: the user is the file, what the event
    carries is the range read, and a file changes every 90 minutes."""
    reads = lambda e: e.select(
        "event_type", "event_id", "ts", F.concat(F.lit("file"), F.col("user_id").cast("string")).alias("path"),
        F.pmod(F.get_json_object("props", "$.k").cast("int"), F.lit(2)).cast("long").alias("start"), F.lit(100).cast("long").alias("size"),
        F.floor((F.unix_timestamp("ts") + F.col("user_id") * 600) / 5400).alias("mtime"))
    return _folded(spark, d, reads, "event_type", ["path", "start", "size", "mtime"], stateful.read_cache_step(), "event_id long, hit boolean")


@register("e14_inbox", "SELECT event_type, count(*) AS unread, count(*) AS handled FROM events WHERE event_type IN ('error', 'signup') GROUP BY event_type")
def e14(spark, d):
    """Rows are noted as read, then handled by two sinks of which one must not lose any."""
    base = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    rows = _stream(spark, d).filter("event_type IN ('error', 'signup')").select("event_id", "event_type")
    sinks = {"all": delivery.put_batch(f"{base}/all"), "errors": lambda b, n: delivery.put_batch(f"{base}/errors")(b.filter("event_type = 'error'"), n)}
    handle = delivery.inbox(delivery.fan_out(sinks, f"{base}/progress", {"all"}), f"{base}/read")
    rows.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(handle).start().awaitTermination()
    read = spark.read.option("basePath", f"{base}/read").parquet(f"{base}/read").select("event_id")
    got = delivery.batches_written(spark, f"{base}/all", rows.schema)
    return got.join(read, "event_id").groupBy("event_type").agg(F.count("event_id").alias("unread"), F.count("*").alias("handled"))
