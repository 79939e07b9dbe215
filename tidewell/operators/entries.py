"""Memory entries: filters, expiry and statistics. An entry has entry_id, type, content, tags, importance,
confidence, session, tool (null without metadata), created and expires."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matches(
    now: Column,
    types: list[str] | None = None,
    importance: float = 0.0,
    confidence: float = 0.0,
    session: str = "",
    tags: list[str] | None = None,
    content: str = "",
    exact: bool = False,
    keywords: list[str] | None = None,
    tool: str = "",
    span: tuple[Column, Column] | None = None,
) -> Column:
    """All conditions that are set hold for an entry. An entry without metadata passes the tool's; the
    content is met exactly or as a part, case-folded; any keyword and any tag is enough; the span holds its ends."""
    low = F.lower("content")
    tests = [F.col("expires").isNull() | (F.col("expires") >= now)]
    if types:
        tests.append(F.col("type").isin(*types))
    if importance > 0:
        tests.append(F.col("importance") >= importance)
    if confidence > 0:
        tests.append(F.col("confidence") >= confidence)
    if session:
        tests.append(F.col("session") == session)
    if tags:
        tests.append(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    if content:
        tests.append(F.col("content") == content if exact else low.contains(content.lower()))
    if keywords:
        tests.append(reduce(lambda a, b: a | b, [low.contains(k.lower()) for k in keywords]))
    if tool:
        tests.append(F.col("tool").isNull() | (F.col("tool") == tool))
    if span:
        tests.append(F.col("created").between(*span))
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def sweep(entries: DataFrame, now: Column, default_days: int = 7) -> DataFrame:
    """entries that have not expired; without an expiry of their own they last ``default_days``."""
    ends = F.coalesce("expires", F.col("created") + F.make_dt_interval(F.lit(default_days)))
    return entries.filter(ends >= now)


def most_accessed(entries: DataFrame, k: int = 5) -> DataFrame:
    """The k entries that were read most often, the first ones of equal counts by id."""
    return entries.orderBy(F.desc("accesses"), "entry_id").limit(k)


def merged_parameters(uses: DataFrame) -> DataFrame:
    """(tool, params, uses, success): uses (tool, params map, ok) with equal maps together, whatever the
    order of their entries."""
    return uses.groupBy("tool", F.array_sort(F.map_entries("params")).alias("params")).agg(F.count("*").alias("uses"), F.avg(F.col("ok").cast("int")).alias("success"))


def exported(entries: DataFrame) -> DataFrame:
    """(entry_id, json): an entry a row, fields in the order of the columns."""
    return entries.select("entry_id", F.to_json(F.struct(*entries.columns)).alias("json"))


def imported(rows: DataFrame, schema: str) -> DataFrame:
    """The entries of exported rows; rows that do not parse are left out."""
    return rows.select(F.from_json("json", schema).alias("e")).filter("e is not null").select("e.*")
