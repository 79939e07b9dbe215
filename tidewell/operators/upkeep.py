"""Upkeep of stores and sessions: collection of expired artifacts, limits of compaction, waits of retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tokens kept free for an automatic and for a manual compaction, and the shares of a window.
AUTO_BUFFER, MANUAL_BUFFER, SUMMARY = 13_000, 3_000, 20_000
THRESHOLD, TARGET, MOST_FAILURES = 0.85, 0.5, 3


def marked_expired(items: DataFrame, now: Column, namespaces: list[str] | None = None) -> DataFrame:
    """items (key, namespace, expires) with ``expired``: of an allowed namespace (none named: of any), and with
    an end that is not after ``now``. An item without an end never expires."""
    allowed = F.lit(True) if not namespaces else F.coalesce(F.col("namespace").isin(*namespaces), F.lit(False))
    return items.withColumn("expired", allowed & F.coalesce(F.col("expires") <= now, F.lit(False)))


def collection_report(marked: DataFrame) -> DataFrame:
    """(namespace, scanned, kept, deleted) of marked items: what a collection does, or would do."""
    return marked.groupBy("namespace").agg(F.count("*").alias("scanned"), F.count_if(~F.col("expired")).alias("kept"), F.count_if("expired").alias("deleted"))


def collected(items: DataFrame, now: Column, namespaces: list[str] | None = None, dry: bool = False) -> tuple[DataFrame, DataFrame]:
    """(what is left, the report). A dry run leaves everything and reports the same."""
    marked = marked_expired(items, now, namespaces)
    return (items if dry else marked.filter(~F.col("expired")).drop("expired")), collection_report(marked)


def compaction_plan(window: Column, output: Column, summary: int = SUMMARY, auto: int = AUTO_BUFFER, manual: int = MANUAL_BUFFER) -> Column:
    """struct<effective, threshold, blocking, target> in tokens for a model's window and most output (0:
    unknown). What a summary needs is set aside; a small window counts as the least that works."""
    reserved = F.when((output > 0) & (output < summary), output).otherwise(summary)
    effective = F.greatest(window - reserved, reserved + auto).cast("long")
    part = lambda share: F.floor(effective * F.lit(share))
    return F.struct(effective.alias("effective"), F.least(part(THRESHOLD), effective - auto).alias("threshold"), (effective - manual).alias("blocking"), part(TARGET).alias("target"))


def compaction_allowed(tries: DataFrame, by: str, failed: str, order: list[str], most: int = MOST_FAILURES) -> DataFrame:
    """tries with ``allowed``: not once ``most`` in a row have failed; a session that is stopped stays so."""
    w = Window.partitionBy(by).orderBy(*order)
    last = F.min(F.col(failed).cast("int")).over(w.rowsBetween(1 - most, 0)) * (F.row_number().over(w) >= most).cast("int")
    ended = tries.withColumn("_ended", last)
    before = F.max("_ended").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return ended.withColumn("allowed", F.coalesce(before, F.lit(0)) == 0).drop("_ended")


def retry_delay(attempt: Column, base: int, most: int, chance: Column) -> Column:
    """Wait before a retry in milliseconds: doubled for each attempt after the first, up to a quarter more
    by ``chance`` (0 to 1), ``most`` at most."""
    doubled = F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), attempt - 1)).cast("long")
    return F.least(F.lit(most), doubled + (doubled * 0.25 * chance).cast("long")).cast("long")


def http_backoff(attempt: Column, initial: int, factor: float, most: int, chance: Column) -> Column:
    """Wait of the second kind: a power of the factor up to ``most``, times 0.75 to 1.25 by ``chance``, and no
    less than the first wait."""
    grown = F.least(F.lit(float(most)), F.lit(float(initial)) * F.pow(F.lit(factor), attempt - 1))
    return F.greatest(F.lit(float(initial)), grown * (0.75 + chance * 0.5)).cast("long")


def glob_base(pattern: Column) -> Column:
    """struct<folder, rest> of a glob: the folder before its first special sign; a plain path's own folder."""
    at = F.regexp_instr(pattern, F.lit(r"[*?\[{]"))
    head = F.when(at > 0, F.substring(pattern, F.lit(1), at - 1)).otherwise(pattern)
    cut = F.when(at > 0, F.length(F.regexp_extract(head, r"^(?s)(.*[/\\])", 1))).otherwise(F.length(F.regexp_extract(head, r"^(?s)(.*/)", 1)))
    folder = F.substring(pattern, F.lit(1), cut - 1)
    root = F.when(F.substring(pattern, 1, 1) == "/", "/")
    plain = F.when(folder != "", folder).otherwise(F.coalesce(root, F.lit(".")))
    special = F.when(cut == 0, "").when(folder == "", F.coalesce(root, F.lit(""))).when(folder.rlike(r"^(?s).:$"), F.concat(folder, F.lit("/"))).otherwise(folder)
    return F.struct(F.when(at > 0, special).otherwise(plain).alias("folder"), F.substring(pattern, cut + 1, F.length(pattern)).alias("rest"))


# What the texts of errors say of a model that is gone, of a region, and of a quota.
MODEL_GONE = ["model_not_found", "model not found", "model_deprecated", "model has been deprecated", "no longer supported", "model is not available", "model was deprecated"]
REGION = ["not available in your region", "access denied in this region", "geographic restriction"]
QUOTA = ["limit: 0", "exceeded your current quota"]


def error_class(error: Column, by_status: Column) -> Column:
    """Class of a failed request: by the error's text where there is one, else ``by_status``."""
    low = F.lower(error)
    some = lambda phrases: F.greatest(*(low.contains(p) for p in phrases))
    named = F.when(some(MODEL_GONE), "model_deprecated").when((low.contains("region") & low.contains("unavailable")) | some(REGION), "regionally_unavailable").when(some(QUOTA), "quota_exhausted")
    return F.when(error.isNotNull(), named.otherwise("network")).otherwise(by_status)


def tried_again(kind: Column, attempt: Column, attempts: int = 5) -> Column:
    """Whether a request of a class is sent again: no client's or key's mistakes, passing troubles up to
    ``attempts``, all others twice."""
    passing = kind.isin("rate_limit", "network", "server_overload", "server_error", "timeout")
    return (attempt < attempts) & ~kind.isin("client_error", "auth_error") & (passing | (attempt < 3))
