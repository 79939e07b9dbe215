"""Queries that run as streams over all files that are there, with SQL on the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.plans.catalog import register
from tidewell.streaming import events as ev


def _stream(spark, d):
    return ev.event_stream(spark, f"{d}/events*.parquet")


@register("e1_stream_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def e1(spark, d):
    return ev.drain(ev.windowed_counts(_stream(spark, d)), "complete").withColumn("total", F.round("total", 4))


@register("e5_stream_once", "SELECT DISTINCT event_id FROM events")
def e5(spark, d):
    return ev.drain(ev.once(_stream(spark, d)).select("event_id"))


@register("e14_stream_drain", "SELECT event_id, user_id FROM events WHERE event_type = 'error'")
def e14(spark, d):
    return ev.drain(_stream(spark, d).filter("event_type = 'error'").select("event_id", "user_id"))


@register("e3_stream_breaker")
def e3(spark, d):
    return ev.drain(ev.breaker_states(_stream(spark, d)))
