"""Line searches, domain rules and completion over tables of texts and addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The limits of a line search.
HEAD_LIMIT, MOST_LIMIT, MOST_COLUMNS = 250, 1000, 500


def lines(docs: DataFrame) -> DataFrame:
    """(id, number, line) of (id, text), lines counted from 1."""
    split = docs.filter("text IS NOT NULL").select("id", F.posexplode(F.split("text", "\n")).alias("_at", "line"))
    return split.select("id", (F.col("_at") + 1).alias("number"), "line")


def _pattern(pattern: str, ignore_case: bool) -> str:
    return f"(?i){pattern}" if ignore_case else pattern


def grep(docs: DataFrame, pattern: str, ignore_case: bool = False, limit: int = HEAD_LIMIT, offset: int = 0) -> DataFrame:
    """The first matching lines by id and number, cut to MOST_COLUMNS characters. The limit is the
    feature: HEAD_LIMIT by default, MOST_LIMIT at most. Texts without a match are not cut into lines."""
    expression = _pattern(pattern, ignore_case)
    hits = lines(docs.filter(F.col("text").rlike(expression))).filter(F.col("line").rlike(expression))
    cut = hits.select("id", "number", F.substring("line", 1, MOST_COLUMNS).alias("line")).orderBy("id", "number")
    most = min(limit or HEAD_LIMIT, MOST_LIMIT)
    if not offset:
        return cut.limit(most)
    # offset + limit rows at most are numbered; an offset beyond the last of them is ignored
    top, every = cut.limit(offset + most), Window.partitionBy(F.lit(1))
    numbered = top.withColumns({"_nth": F.row_number().over(every.orderBy("id", "number")), "_n": F.count("*").over(every)})
    skipped = F.when(F.col("_n") > offset, F.lit(offset)).otherwise(0)
    return numbered.filter((F.col("_nth") > skipped) & (F.col("_nth") <= skipped + most)).select("id", "number", "line")


def grep_files(docs: DataFrame, pattern: str, ignore_case: bool = False) -> DataFrame:
    """The ids with a matching line."""
    expression = _pattern(pattern, ignore_case)
    return docs.filter(F.exists(F.split("text", "\n"), lambda s: s.rlike(expression))).select("id")


def grep_count(docs: DataFrame, pattern: str, ignore_case: bool = False) -> DataFrame:
    """(id, n): matching lines of each text that has one; no row is multiplied."""
    expression = _pattern(pattern, ignore_case)
    n = F.size(F.filter(F.split("text", "\n"), lambda s: s.rlike(expression))).cast("long")
    return docs.select("id", n.alias("n")).filter("n > 0")


def context_lines(docs: DataFrame, pattern: str, around: int) -> DataFrame:
    """Matching lines and ``around`` lines before and after each, once. The neighbours are named by
    number inside the text's own array of lines, so no join is needed."""
    parts = F.split("text", "\n")
    found = docs.filter(F.col("text").rlike(pattern)).select("id", parts.alias("parts"))
    hits = F.filter(F.transform("parts", lambda s, i: F.when(s.rlike(pattern), i)), lambda i: i.isNotNull())
    near = F.array_distinct(F.flatten(F.transform(hits, lambda i: F.sequence(F.greatest(i - around, F.lit(0)), F.least(i + around, F.size("parts") - 1)))))
    named = found.select("id", "parts", F.explode(near).alias("at"))
    return named.select("id", (F.col("at") + 1).alias("number"), F.get("parts", F.col("at")).alias("line"))


def domain_rules(hosts: DataFrame, domains: DataFrame, keep: bool) -> DataFrame:
    """hosts (host, ...) whose host is, or ends in a dot and, one of ``domains`` (domain); with keep
    False all the others. Every suffix of a host is looked up, so the rule is an equi-join."""
    pieces = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda i: F.array_join(F.slice(pieces, i, F.size(pieces)), "."))
    named = hosts.select("host").distinct().select("host", F.explode(suffixes).alias("domain"))
    hit = named.join(domains.select("domain").distinct(), "domain", "left_semi").select("host").distinct()
    return hosts.join(hit, "host", "left_semi" if keep else "left_anti").select(*hosts.columns)


def completion_tier(name: Column, path: Column, typed: str) -> Column:
    """0 for the very name, 1 for its beginning, 2 for the beginning of a path segment, else 3."""
    low = F.lower(name)
    segment = F.concat(F.lit("/"), F.lower(path)).contains("/" + typed.lower())
    return F.when(low == typed.lower(), 0).when(low.startswith(typed.lower()), 1).when(segment, 2).otherwise(3)
