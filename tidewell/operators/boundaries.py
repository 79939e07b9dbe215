"""Records of preserved tails, and what is wrong where a record and its tail disagree.

A message is (session, place, id, turn, uses, answers): ``uses`` names the tool call it makes, ``answers`` the
call whose result it is - null where it is no result, empty where a result has lost its name. Calls and
results meet by name; counts and firsts are aggregated, only the digest orders a session's own rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.sessions import transcript_hash

VERSION = 1
FIELDS = ["version", "messages", "turns", "tool_pairs", "first_id", "last_id", "tail_hash"]


def tails(messages: DataFrame, starts: DataFrame, by: str, order: str) -> DataFrame:
    """The messages from each session's ``start`` on."""
    return messages.join(starts.select(by, "start"), by).filter(F.col(order) >= F.col("start")).drop("start")


def _results(tail: DataFrame, by: str, order: str) -> DataFrame:
    """(by, place, answers, use): results, and where in the tail their call was made first."""
    calls = tail.filter("uses <> ''").groupBy(by, F.col("uses").alias("answers")).agg(F.min(order).alias("use"))
    return tail.filter("answers is not null").select(by, F.col(order).alias("place"), "answers").join(calls, [by, "answers"], "left")


def records(tail: DataFrame, sessions: DataFrame, by: str, order: str, hashed: list[str]) -> DataFrame:
    """(by, FIELDS..., fault) for sessions (by): what the record of each one's tail must say. An empty tail
    has no ids; ``fault`` is the first result without a name, or whose call is missing or comes later."""
    sums = tail.groupBy(by).agg(F.count("*").alias("messages"), F.count_distinct(F.nullif(F.col("turn").cast("string"), F.lit(""))).alias("turns"), F.min_by("id", order).alias("first_id"), F.max_by("id", order).alias("last_id"))
    results = _results(tail, by, order)
    wrong = F.when(F.col("answers") == "", "result without a call's name").when(F.col("use").isNull(), F.concat(F.lit("orphaned result of "), "answers")).when(F.col("use") > F.col("place"), F.concat(F.lit("result before its call "), "answers"))
    paired = F.count_if((F.col("answers") != "") & (F.col("use") <= F.col("place")))
    tools = results.withColumn("wrong", wrong).groupBy(by).agg(paired.alias("tool_pairs"), F.min(F.when(F.col("wrong").isNotNull(), F.struct("place", "wrong"))).alias("f")).select(by, "tool_pairs", F.col("f.wrong").alias("fault"))
    digest = transcript_hash(tail, by, order, hashed).withColumnRenamed("hash", "tail_hash")
    out = sessions.select(by).distinct().join(sums, by, "left").join(tools, by, "left").join(digest, by, "left")
    none = F.lit("")
    count = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select(by, F.lit(VERSION).alias("version"), count("messages"), count("turns"), count("tool_pairs"), F.coalesce("first_id", none).alias("first_id"), F.coalesce("last_id", none).alias("last_id"), F.coalesce("tail_hash", F.sha2(F.lit("[]").cast("binary"), 256)).alias("tail_hash"), "fault")


def problem(claimed: dict[str, Column], found: dict[str, Column], fault: Column) -> Column:
    """The first thing wrong with a claimed record, in the order in which records are read; else the tail's
    own fault, else null."""
    c, f = claimed, found
    said = lambda what: F.concat(F.lit(f"{what} mismatch: "), c[what].cast("string"), F.lit(" for "), f[what].cast("string"))
    out = F.when(c["version"] != VERSION, F.concat(F.lit("unknown version "), c["version"].cast("string")))
    for what in ("messages", "turns", "tool_pairs"):
        out = out.when(c[what] != f[what], said(what))
    ids = [c["first_id"], c["last_id"]]
    empty = f["messages"] == 0
    out = out.when(empty & ((ids[0] != "") | (ids[1] != "")), "ids on an empty tail").when(~empty & ((ids[0] == "") | (ids[1] == "")), "missing ids")
    for what in ("first_id", "last_id"):
        out = out.when(~empty & (c[what] != f[what]), said(what))
    return out.when(c["tail_hash"] == "", "missing tail_hash").when(c["tail_hash"] != f["tail_hash"], "tail_hash mismatch").otherwise(fault)


def problems(claimed: DataFrame, found: DataFrame, by: str) -> DataFrame:
    """(by, problem) for claimed records (by, FIELDS...) against found ones. Null fields of a claim read as
    0 or ''; a session that isn't found has no problem to tell."""
    names = [F.coalesce(F.col(c), F.lit(0) if t != "string" else F.lit("")).alias(f"_{c}") for c, t in claimed.dtypes if c in FIELDS]
    both = claimed.select(by, *names).join(found, by)
    return both.select(by, problem({c: F.col(f"_{c}") for c in FIELDS}, {c: F.col(c) for c in FIELDS}, F.col("fault")).alias("problem"))
