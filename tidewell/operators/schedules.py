"""Cron schedules, retries and expiry."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cron_field(field: str, low: int, high: int) -> list[int]:
    """The numbers a field of a cron expression stands for: *, N, N-M, steps and lists of these."""
    out: set[int] = set()
    for part in field.split(","):
        span, _, step = part.partition("/")
        every = int(step or 1)
        if span == "*":
            first, last = low, high
        elif "-" in span:
            first, last = map(int, span.split("-"))
        else:
            first = int(span)
            last = high if step else first
        if every < 1 or not low <= first <= last <= high:
            raise ValueError(f"cron field {field!r}")
        out.update(range(first, last + 1, every))
    return sorted(out)


def cron_parse(expression: str) -> tuple[list[int], ...]:
    fields = expression.split()
    if len(fields) != 5:
        raise ValueError(f"cron expression {expression!r}")
    return tuple(cron_field(f, lo, hi) for f, (lo, hi) in zip(fields, ((0, 59), (0, 23), (1, 31), (1, 12), (0, 6)), strict=True))


def cron_next(df: DataFrame, ts: str, expression: str, days: int = 366) -> DataFrame:
    """df with ``next_run``: the first whole minute after ts at which all five fields match (day of month
    and weekday too); null beyond ``days`` days. The calendar days of the rows' span, with the next day
    that matches, are a small table that is broadcast: one row a day."""
    minutes, hours, dom, months, dow = cron_parse(expression)
    spark = df.sparkSession
    start = F.date_trunc("minute", F.col(ts)) + F.expr("INTERVAL 1 MINUTE")
    low, high = df.agg(F.min(F.to_date(start)), F.max(F.to_date(start))).first()
    rows, after = [], None
    if low is not None:
        for k in range((high - low).days + days, -1, -1):
            day = low + timedelta(days=k)
            fits = day.day in dom and day.month in months and (day.weekday() + 1) % 7 in dow
            if day <= high:
                rows.append((day, fits, after if after and (after - day).days <= days else None))
            after = day if fits else after
    calendar = spark.createDataFrame(rows, "_day date, _fits boolean, _after date")
    now, first = F.hour("_start") * 60 + F.minute("_start"), min(hours) * 60 + min(minutes)
    late = F.array_min(F.filter(F.array(*[F.lit(h * 60 + m) for h in hours for m in minutes]), lambda t: t >= now))
    at = lambda day, minute: F.timestamp_seconds(F.unix_timestamp(F.col(day).cast("timestamp")) + minute * 60)
    joined = df.withColumn("_start", start).withColumn("_day", F.to_date("_start")).join(F.broadcast(calendar), "_day", "left")
    same_day = F.when(F.col("_fits") & late.isNotNull(), at("_day", late))
    return joined.withColumn("next_run", F.coalesce(same_day, at("_after", F.lit(first)))).select(*df.columns, "next_run")


def expired(expires: Column, now: Column) -> Column:
    """Whether the moment has come; null never comes."""
    return F.coalesce(expires <= now, F.lit(False))


def retry_waits(first_ms: int, attempts: int, cap_ms: int) -> Column:
    """array<long>: the waits before each retry, doubled each time up to the cap."""
    return F.transform(F.sequence(F.lit(0), F.lit(attempts - 1)), lambda i: F.least(F.lit(cap_ms), (first_ms * F.pow(F.lit(2.0), i)).cast("long")))
