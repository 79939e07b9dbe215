"""Joins, upserts and message tables: relations, inboxes, sessions and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import text as tx


def touching(relations: DataFrame, names: DataFrame) -> DataFrame:
    """relations (source, target, ...) with an end among ``names`` (name). Two semi-joins, as one join
    on either end would compare every pair."""
    a = relations.join(names, F.col("source") == F.col("name"), "left_semi")
    b = relations.join(names, F.col("target") == F.col("name"), "left_semi")
    return a.unionByName(b).distinct()


#: Members of a cell, the part of a team that meets its senders at once.
CELL_MEMBERS = 1024


def fan_out(messages: DataFrame, members: DataFrame) -> DataFrame:
    """One row for each member of a message's team but its sender: messages (team, sender, ...),
    members (team, member). A team is cut into cells of CELL_MEMBERS or so by its members' own keys, and its
    messages go to each of its cells: many tasks make the rows of a large team, however few files the
    members came in, and a small team's messages are moved once. What is broadcast is at most the teams' sizes:
    Spark takes messages that were repeated for as few as they were before, so the last join is a merge."""
    parts = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = members.groupBy("team").agg(F.ceil(F.count("*") / CELL_MEMBERS).cast("int").alias("_cells"))
    # one key, which no constant team can be taken out of: the join keeps the tasks that rows are dealt to
    at = lambda df, part: df.withColumn("_part", part).withColumn("_cell", F.struct("team", "_part")).drop("_part", "_cells").repartition(parts, "_cell")
    sent = at(messages.join(cells, "team"), F.explode(F.sequence(F.lit(0), F.col("_cells") - 1)))
    cut = at(members.join(cells, "team"), F.pmod(F.xxhash64("member"), F.col("_cells")).cast("int")).drop("team")
    return sent.join(cut.hint("merge"), "_cell").filter("member <> sender").drop("_cell")


def least_loaded(candidates: DataFrame, pending: DataFrame, by: str) -> DataFrame:
    """(by, member): in each group the member with the fewest pending rows, none counting as 0; ties by id."""
    counts = pending.groupBy("member").agg(F.count("*").alias("n"))
    loaded = candidates.join(counts, "member", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return loaded.groupBy(by).agg(F.min(F.struct("n", "member")).alias("best")).select(by, F.col("best.member").alias("member"), F.col("best.n").alias("n"))


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows of new that are inserted: keys not in old, the first of each by ``order``; blank keys are skipped."""
    for k in keys:
        new = new.filter(F.trim(F.col(k).cast("string")) != "")
    first = Window.partitionBy(*keys).orderBy(order)
    fresh = new.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return fresh.join(old.select(*keys), keys, "left_anti")


def append_distinct(old: Column, new: Column) -> Column:
    """old with the values of new that it lacks, in order."""
    return F.array_distinct(F.concat(F.coalesce(old, F.array().cast("array<string>")), F.coalesce(new, F.array().cast("array<string>"))))


def keep_first(df: DataFrame, by: str, order: str) -> DataFrame:
    """df with the smallest ``order`` of each non-empty ``by``; rows without one stay."""
    first = Window.partitionBy(by).orderBy(order)
    named = df.filter(F.coalesce(F.col(by), F.lit("")) != "").withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return named.unionByName(df.filter(F.coalesce(F.col(by), F.lit("")) == ""))


def canonical(messages: DataFrame) -> DataFrame:
    """Rows of the three roles with their entry type."""
    kept = messages.filter(F.col("role").isin("user", "assistant", "system"))
    return kept.withColumn("entry", F.when(F.col("role") == "system", "system").otherwise("message"))


def session_summary(messages: DataFrame, by: str = "conv_id") -> DataFrame:
    """Messages, turns, user messages and the first line of the first user text, at most 120 characters."""
    spoken = (F.col("role") == "user") & (F.trim("text") != "")
    first = F.min_by("text", F.when(spoken, F.col("turn")))
    return messages.groupBy(by).agg(
        F.count("*").alias("messages"), F.count_distinct("turn").alias("turns"), F.count_if(F.col("role") == "user").alias("asked"),
        tx.ellipsis(F.substring_index(F.trim(first), "\n", 1), 120).alias("title"),
    )


def session_digest(messages: DataFrame, by: str = "conv_id") -> DataFrame:
    """Turns, first user text and last assistant text, 160 characters each at most."""
    said = F.trim("text") != ""
    first = F.min_by("text", F.when((F.col("role") == "user") & said, F.col("turn")))
    last = F.max_by("text", F.when((F.col("role") == "assistant") & said, F.col("turn")))
    short = lambda c: tx.ellipsis(tx.collapse_space(c), 160)
    return messages.groupBy(by).agg(F.count_distinct("turn").alias("turns"), short(first).alias("first_user"), short(last).alias("last_assistant"))


def preserved_tail(messages: DataFrame, tokens: Column, target: int, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """The newest rows of each session up to and including the one that crosses the token target."""
    newest = Window.partitionBy(by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    t = messages.withColumn("_tokens", tokens)
    return t.withColumn("_sum", F.sum("_tokens").over(newest)).filter(F.col("_sum") - F.col("_tokens") < target).drop("_tokens", "_sum")


def last_turns(messages: DataFrame, n: int, by: str = "conv_id") -> DataFrame:
    """Rows from turn max - n on; rows without a turn stay only if they are the system's."""
    last = messages.groupBy(by).agg(F.max("turn").alias("_last"))
    kept = messages.join(last, by).filter((F.col("turn") >= F.col("_last") - n) | (F.col("turn").isNull() & (F.col("role") == "system")))
    return kept.drop("_last")


def transcript(messages: DataFrame, per_message: int = 1200, most: int = 8000, by: str = "conv_id") -> DataFrame:
    """(by, transcript): the user's and the assistant's messages in order, each cut, the last ``most``
    characters kept. A session is one array; only its own messages meet in it."""
    said = F.struct("turn", F.concat(F.col("role"), F.lit(": "), F.substring("text", 1, per_message)).alias("line"))
    parts = messages.filter(F.col("role").isin("user", "assistant") & F.col("text").isNotNull()).groupBy(by).agg(F.array_sort(F.collect_list(said)).alias("said"))
    whole = F.array_join(F.transform("said", lambda s: s["line"]), "\n")
    return parts.select(by, F.right(whole, F.lit(most)).alias("transcript"))


def first_island(df: DataFrame, by: str, flag: str, order: str) -> DataFrame:
    """The first contiguous run of flagged rows of each group."""
    w = Window.partitionBy(by).orderBy(order)
    marked = df.withColumn("_start", (F.col(flag) & ~F.coalesce(F.lag(flag).over(w), F.lit(False))).cast("int"))
    marked = marked.withColumn("_island", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.filter(F.col(flag) & (F.col("_island") == 1)).drop("_start", "_island")


def importance(length: Column, tags: Column) -> Column:
    """Importance of a memory entry by the length of its text and the number of its tags, 0.1 to 1."""
    score = F.lit(0.2) + F.when(length > 100, 0.4).when(length > 50, 0.2).otherwise(0.0) + F.when(tags > 3, 0.3).when(tags > 1, 0.2).otherwise(0.0)
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), score))


def relevance(importance_: Column, confidence: Column, hours: Column, hit: Column, tag_hits: Column) -> Column:
    """Relevance of a memory entry: importance, confidence, recency of its last use, a hit in its
    content and every keyword among its tags; 1 at most. ``hours`` is null where it was never used."""
    recent = F.coalesce(F.greatest(F.lit(0.0), (24 - hours) / 24), F.lit(0.0))
    return F.least(F.lit(1.0), 0.4 * importance_ + 0.2 * confidence + 0.3 * recent + F.when(hit, 0.3).otherwise(0.0) + 0.1 * tag_hits)


def compaction_limit(window: Column, reserved: Column) -> Column:
    """Tokens at which a session is compacted: 85 hundredths of what is left, or 13000 below it."""
    left = window - reserved
    return F.least(0.85 * left, left - 13_000)
