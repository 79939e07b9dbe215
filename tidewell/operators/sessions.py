"""Sessions: incremental sync, tails that keep tool pairs, boundaries, directives, tasks, runs and budgets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import text as tx

# Phrases of each family of directives, in the order in which they are tried, with the
# scope, the kind and the key of what they say (no key: one made of the words).
DIRECTIVES = [
    (["remember that", "remember:", "souviens-toi que", "retiens que", "n'oublie pas que", "keep in mind that", "keep in mind:", "note that", "don't forget that", "important:", "fyi:"], "project", "instruction", ""),
    (["answer in ", "respond in ", "reply in ", "write in ", "always write in ", "always respond in ", "reponds en ", "réponds en ", "en francais", "en français", "use english", "use french", "use spanish", "use german", "use portuguese"], "user", "preference", "preference:response-language"),
    (["be concise", "stay concise", "sois concis", "soyez concis", "keep it brief", "keep it short", "be brief", "brief responses", "be detailed", "be verbose", "be thorough", "be comprehensive", "detailed responses"], "user", "preference", "preference:response-style"),
    (["be formal", "be professional", "use formal", "formal tone", "be informal", "be casual", "casual tone", "speak casually"], "user", "preference", "preference:response-tone"),
    (["use markdown", "avoid markdown", "no markdown", "without markdown", "use bullet points", "use numbered lists", "plain text only", "use plain text", "format using", "format with"], "user", "preference", "preference:response-format"),
    (["do not use emoji", "don't use emoji", "without emoji", "sans emoji"], "user", "instruction", "instruction:response-no-emoji"),
    (["for this project", "dans ce projet", "in this repo", "in this codebase", "always use ", "prefer ", "instead of ", "never use ", "do not use ", "don't use ", "n'utilise pas", "utilise toujours ", "toujours utilise ", "toujours utiliser ", "evite ", "évite "], "project", "instruction", ""),
]
PREFERRED = ["prefer ", "instead of ", "préfère ", "prefere "]


def directives(messages: DataFrame, by: str) -> DataFrame:
    """(by, key, scope, kind, value): lasting wishes in the texts (by, turn, text). Texts are cut at line
    ends and . ; ! ?; the first family with a phrase in a part decides; of one key the last part stays."""
    parts = F.transform(F.split("text", r"[\r\n.;!?]"), lambda p: tx.collapse_space(p))
    said = messages.select(by, "turn", F.posexplode(parts).alias("at", "value")).filter("value <> ''")
    low = F.lower("value")
    some = lambda phrases: reduce(lambda a, b: a | b, [low.contains(p) for p in phrases])
    preferred = some(PREFERRED)
    scope, kind, key = (F.when(F.lit(False), "") for _ in range(3))
    for i, (phrases, where, what, name) in enumerate(DIRECTIVES):
        hit = some(phrases)
        own = F.when(preferred, "preference").otherwise(what) if i == len(DIRECTIVES) - 1 else F.lit(what)
        scope, kind = scope.when(hit, where), kind.when(hit, own)
        key = key.when(hit, F.lit(name) if name else F.concat(own, F.lit(":"), tx.stable_key(F.col("value"))))
    found = said.select(by, "turn", "at", "value", scope.alias("scope"), kind.alias("kind"), key.alias("key")).filter("key is not null")
    last = F.max_by(F.struct("scope", "kind", "value"), F.struct("turn", "at")).alias("last")
    return found.groupBy(by, "key").agg(last).select(by, "key", "last.*")


def synced(old: DataFrame, new: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """(by, order, value, action) of what has to be written: the rows beyond the old ones where these are
    the new ones' beginning (append), else all new rows (replace). A session without new rows is cleared."""
    o = old.select(by, order, F.col(value).alias("_old"))
    both = o.join(new.select(by, order, F.col(value).alias("_new"), F.lit(1).alias("_in")), [by, order], "full_outer")
    state = both.groupBy(by).agg(F.bool_and(F.col("_old").isNull() | F.coalesce(F.col("_old") == F.col("_new"), F.lit(False))).alias("begins"), F.count("_old").alias("held"), F.count("_in").alias("fresh"))
    rows = both.filter("_in = 1").join(state, by).filter(~F.col("begins") | F.col("_old").isNull())
    write = rows.select(by, order, F.col("_new").alias(value), F.when(F.col("begins"), "append").otherwise("replace").alias("action"))
    gone = state.filter("fresh = 0").select(by, F.lit(None).cast(dict(old.dtypes)[order]).alias(order), F.lit(None).cast(dict(new.dtypes)[value]).alias(value), F.lit("clear").alias("action"))
    return write.union(gone)


def widened_tail(messages: DataFrame, starts: DataFrame, by: str, order: str) -> DataFrame:
    """starts (by, start) moved back until no kept row (by, order, uses, answers) answers a tool whose use
    comes before it. Answers meet their uses by id; chains of any length are followed in one pass."""
    from pyspark.sql import Window

    pairs = messages.filter("answers <> ''").select(by, F.col(order).alias("_at"), F.col("answers").alias("_tool")).join(
        messages.filter("uses <> ''").select(by, F.col(order).alias("_use"), F.col("uses").alias("_tool")), [by, "_tool"]
    )
    pairs = pairs.filter("_use < _at").select(by, "_at", "_use").distinct()
    # a pair covers the turns after its use up to its answer; pairs that touch make an island, and a tail
    # that starts on one starts at its left end instead, however many links lie between
    w = Window.partitionBy(by).orderBy("_use", "_at")
    reach = F.max("_at").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = pairs.withColumn("_new", (reach.isNull() | (F.col("_use") > reach)).cast("int"))
    islands = opened.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(by, "_island").agg(F.min("_use").alias("_left"), F.max("_at").alias("_right"))
    held = starts.join(islands.select(F.col(by).alias("_by"), "_left", "_right"), (F.col(by) == F.col("_by")) & (F.col("start") > F.col("_left")) & (F.col("start") <= F.col("_right")), "left")
    return held.select(by, F.coalesce("_left", "start").alias("start"))


def transcript_hash(messages: DataFrame, by: str, order: str, fields: list[str]) -> DataFrame:
    """(by, hash): digest of each session's rows as JSON, in order, fields in the order of their names.
    Only a session's own rows meet in one array."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_at"), *sorted(fields))))
    body = F.transform(F.col("rows"), lambda r: F.struct(*[r[f].alias(f) for f in sorted(fields)]))
    return messages.groupBy(by).agg(rows.alias("rows")).select(by, F.sha2(F.to_json(body).cast("binary"), 256).alias("hash"))


def boundary_problem(found: DataFrame, claimed: DataFrame, by: str, fields: list[str]) -> DataFrame:
    """(by, problem): the first field of a boundary's record that differs from what its tail shows."""
    both = claimed.select(by, *[F.col(f).alias(f"_{f}") for f in fields]).join(found, by, "left")
    out = F.when(F.lit(False), "")
    for f in fields:
        out = out.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), f"{f} mismatch")
    return both.select(by, out.alias("problem"))


def prompt_text(sections: DataFrame, by: str, variables: dict[str, str]) -> DataFrame:
    """(by, prompt, used): the enabled sections (by, seq, priority, enabled, content) by falling priority,
    then order, with ``{{name}}`` replaced; and the names that were used, sorted."""
    line = F.struct((-F.col("priority")).alias("_p"), "seq", "content")
    parts = sections.filter("enabled").groupBy(by).agg(F.array_sort(F.collect_list(line)).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["content"]), "\n\n")
    raw = parts.select(by, text.alias("raw"))
    used = F.array_compact(F.array(*[F.when(F.col("raw").contains("{{" + k + "}}"), F.lit(k)) for k in sorted(variables)]))
    filled = reduce(lambda c, kv: F.replace(c, F.lit("{{" + kv[0] + "}}"), F.lit(kv[1])), variables.items(), F.col("raw"))
    return raw.select(by, filled.alias("prompt"), used.alias("used"))


def continuation(rows: DataFrame, by: str, order: str, total: str, budget: int, small: int, complete: float = 0.9, limit: int = 0) -> DataFrame:
    """rows with ``go``: whether a session goes on after a check of its tokens so far: not at the share
    ``complete`` of the budget, nor after two checks that both added fewer than ``small`` tokens, nor after
    ``limit`` continuations (0: any number). A session that has stopped stays so; until then every check
    continued, so the check before is the row before."""
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(order)
    delta = F.col(total) - F.coalesce(F.lag(total).over(w), F.lit(0))
    steps = rows.withColumns({"_delta": delta, "_nth": F.row_number().over(w)})
    tired = (F.col("_nth") > 2) & (F.col("_delta") < small) & (F.lag("_delta").over(w) < small)
    goes = ~tired & (F.col(total) < complete * budget)
    if limit > 0:
        goes = goes & (F.col("_nth") <= limit)
    checked = steps.withColumn("_goes", F.coalesce(goes, F.lit(False)))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    return checked.withColumn("go", F.min("_goes").over(so_far)).drop("_delta", "_nth", "_goes")


def backoff(attempt: Column, initial: int, factor: float, most: int) -> Column:
    """Wait before an attempt from 1 on, in milliseconds, without jitter."""
    return F.least(F.lit(float(most)), F.lit(float(initial)) * F.pow(F.lit(float(factor)), attempt - 1)).cast("long")


def retry_after(header: Column, now: Column) -> Column:
    """Seconds a response asks to wait: a number, or an HTTP date after now; else 0."""
    seconds = header.try_cast("int")
    until = F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(header, r"^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))) - F.unix_timestamp(now)
    return F.when(seconds > 0, seconds.cast("long")).when(until > 0, until).otherwise(F.lit(0).cast("long"))


def next_of_trigger(kind: Column, interval_s: Column, at: Column, now: Column) -> Column:
    """The next moment of an interval (positive) or of a single run that is still to come; else null."""
    return F.when((kind == "interval") & (interval_s > 0), F.timestamp_seconds(F.unix_timestamp(now) + interval_s)).when((kind == "once") & (at > now), at)


def bounded_queue(rows: DataFrame, capacity: int, drained: int, by: str, order: str) -> DataFrame:
    """(by, emitted, overflow, held): a queue that takes one row at a time and drops it when full, and from
    which every ``drained``-th arrival takes one out. Rows are sorted by Spark, two counters are carried."""
    import pyarrow as pa

    kinds = dict(rows.dtypes)

    def walk(batches):
        key, seen, kept, held, any_ = None, 0, 0, 0, False
        row = lambda: pa.RecordBatch.from_arrays([pa.array([key]), *[pa.array([v], pa.int64()) for v in (kept, seen - kept, held)]], [by, "emitted", "overflow", "held"])
        for batch in batches:
            for k in batch.column(0).to_pylist():
                if any_ and k != key:
                    yield row()
                if not any_ or k != key:
                    key, seen, kept, held, any_ = k, 0, 0, 0, True
                seen += 1
                if held < capacity:
                    held, kept = held + 1, kept + 1
                if seen % drained == 0:
                    held = max(0, held - 1)
        if any_:
            yield row()

    ordered = rows.repartition(by).sortWithinPartitions(by, order).select(by)
    return ordered.mapInArrow(walk, f"{by} {kinds[by]}, emitted long, overflow long, held long")
