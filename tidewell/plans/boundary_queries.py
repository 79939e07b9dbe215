"""Queries on preserved tails, published tables, patches and diffs of texts, with their SQL counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewell.functions import maths as ma
from tidewell.functions import text as tx
from tidewell.operators import boundaries as bo
from tidewell.operators import retrieval as rt
from tidewell.operators import rules as ru
from tidewell.plans.catalog import register
from tidewell.session import shared_dir, table
from tidewell.sources import tables

# the last two turns are kept; even turns call a tool and odd ones answer it; each kind of mistake is made
TAIL = """m AS (SELECT conv_id, turn, role, conv_id || ':' || turn || role AS id, CASE WHEN turn % 2 = 0 THEN 't' || turn ELSE '' END AS uses, CASE WHEN turn % 2 = 1 THEN CASE WHEN conv_id % 40 = 29 THEN '' ELSE 't' || (turn - 1) END END AS answers FROM conversations),
b AS (SELECT conv_id, max(turn) - 1 + CASE WHEN conv_id % 20 = 9 THEN 2 ELSE 0 END AS start FROM m GROUP BY conv_id),
t AS (SELECT m.* FROM m JOIN b ON m.conv_id = b.conv_id AND m.turn >= b.start),
u AS (SELECT conv_id, uses AS answers, min(turn) AS used FROM t WHERE uses <> '' GROUP BY ALL),
r AS (SELECT t.conv_id, t.turn, t.answers, used FROM t LEFT JOIN u ON u.conv_id = t.conv_id AND u.answers = t.answers WHERE t.answers IS NOT NULL),
p AS (SELECT conv_id, count(*) FILTER (answers <> '' AND used <= turn) AS tool_pairs, arg_min(CASE WHEN answers = '' THEN 'result without a call''s name' WHEN used IS NULL THEN 'orphaned result of ' || answers WHEN used > turn THEN 'result before its call ' || answers END, turn) AS fault FROM r GROUP BY conv_id),
s AS (SELECT conv_id, count(*) AS messages, count(DISTINCT turn) AS turns, arg_min(id, turn) AS first_id, arg_max(id, turn) AS last_id, sha256('[' || string_agg('{"role":' || to_json(role) || ',"turn":' || turn || '}', ',' ORDER BY turn, role) || ']') AS tail_hash FROM t GROUP BY conv_id),
f AS (SELECT b.conv_id, coalesce(messages, 0) AS messages, coalesce(turns, 0) AS turns, coalesce(tool_pairs, 0) AS tool_pairs, coalesce(first_id, '') AS first_id, coalesce(last_id, '') AS last_id, coalesce(tail_hash, sha256('[]')) AS tail_hash, fault
      FROM b LEFT JOIN s ON s.conv_id = b.conv_id LEFT JOIN p ON p.conv_id = b.conv_id)"""


def _tail(spark, d):
    c = table(spark, d, "conversations")
    name = lambda n: F.concat(F.lit("t"), n.cast("string"))
    odd = F.col("turn") % 2 == 1
    m = c.select("conv_id", "turn", "role", F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"), "role").alias("id"), F.when(~odd, name(F.col("turn"))).otherwise("").alias("uses"), F.when(odd, F.when(F.col("conv_id") % 40 == 29, "").otherwise(name(F.col("turn") - 1))).alias("answers"))
    starts = m.groupBy("conv_id").agg((F.max("turn") - 1).alias("start")).withColumn("start", F.col("start") + F.when(F.col("conv_id") % 20 == 9, 2).otherwise(0))
    return bo.records(bo.tails(m, starts, "conv_id", "turn"), starts, "conv_id", "turn", ["role", "turn"])


@register("q9_tail_records", f"WITH {TAIL} SELECT conv_id, 1 AS version, messages, turns, tool_pairs, first_id, last_id, tail_hash, fault FROM f")
def q9_records(spark, d):
    """What the record of each conversation's preserved tail must say."""
    return _tail(spark, d)


@register("q9_tail_problems", f"""WITH {TAIL}, k AS (SELECT *, conv_id % 10 AS k FROM f)
SELECT conv_id, CASE WHEN k = 0 THEN 'unknown version 2' WHEN k = 1 THEN 'messages mismatch: ' || (messages + 1) || ' for ' || messages WHEN k = 2 THEN 'turns mismatch: ' || (turns + 1) || ' for ' || turns
 WHEN k = 3 THEN 'tool_pairs mismatch: ' || (tool_pairs + 1) || ' for ' || tool_pairs WHEN conv_id % 40 = 9 THEN 'ids on an empty tail' WHEN k = 4 THEN 'missing ids' WHEN k = 5 THEN 'first_id mismatch: x for ' || first_id
 WHEN k = 6 THEN 'last_id mismatch: x for ' || last_id WHEN k = 7 THEN 'missing tail_hash' WHEN k = 8 THEN 'tail_hash mismatch' ELSE fault END AS problem FROM k""")
def q9_problems(spark, d):
    """Records with one mistake each, and right ones over tails that are faulty or empty."""
    found = _tail(spark, d)
    k = F.col("conv_id") % 10
    more = lambda c, i: (F.col(c) + (k == i).cast("int")).alias(c)
    first = F.when(k == 4, "").when((k == 5) | (F.col("conv_id") % 40 == 9), "x").otherwise(F.col("first_id"))
    claimed = found.select("conv_id", more("version", 0), more("messages", 1), more("turns", 2), more("tool_pairs", 3), first.alias("first_id"), F.when(k == 6, "x").otherwise(F.col("last_id")).alias("last_id"), F.when(k == 7, "").when(k == 8, "x").otherwise(F.col("tail_hash")).alias("tail_hash"))
    return bo.problems(claimed, found, "conv_id")


@register("s14_published", "SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN upper(lang) ELSE lang END AS lang, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS version FROM documents")
def s14(spark, d):
    """A table published, read, changed and published again in one step; what was staged and never
    committed is not seen."""
    path = f"{shared_dir(spark)}/indexes/{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", F.lit(1).alias("version"))
    tables.publish(docs, path)
    old = tables.read(spark, tables.current(spark, path), "rows", "id long, lang string, version int")
    tables.stage(old.withColumn("lang", F.lit("lost")), path, "rows")
    new = old.filter("id % 3 = 0").select("id", F.upper("lang").alias("lang"), F.lit(2).alias("version"))
    tables.publish(rt.upsert(old, new, ["id"]), path)
    return tables.read(spark, tables.current(spark, path), "rows", "id long, lang string, version int")


# the first line that holds a word is changed; lines before and after it are context
CHANGED = "list_position(list_transform(string_split(regexp_replace(text, '\\n$', ''), chr(10)), lambda s: contains(s, 'the')), true)"


@register("f6_text_patches", f"""WITH t AS (SELECT doc_id AS id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS ls, {CHANGED} AS k FROM documents WHERE text IS NOT NULL AND contains(text, 'the'))
SELECT id, greatest(0, k - 1 - 3)::INT + 1 AS old_start, (least(len(ls), k + 3) - greatest(0, k - 4))::INT AS old_lines,
 md5(array_to_string(list_concat(list_concat(list_transform(ls[greatest(0, k - 4) + 1:k - 1], lambda s: ' ' || s), ['-' || ls[k], '+' || replace(ls[k], 'the', 'THE')]), list_transform(ls[k + 1:least(len(ls), k + 3)], lambda s: ' ' || s)), chr(10))) AS patch FROM t""")
def f6(spark, d):
    """The patch of each text whose first line with a word is changed in it."""
    docs = table(spark, d, "documents").filter("text is not null and contains(text, 'the')").select(F.col("doc_id").alias("id"), "text")
    found = docs.select("id", "text", F.split("text", "\n").alias("ls")).withColumn("k", F.array_position(F.transform("ls", lambda s: s.contains("the")), True).cast("int"))
    changed = F.array(F.replace(F.get("ls", F.col("k") - 1), F.lit("the"), F.lit("THE")))
    new = F.array_join(F.concat(F.slice("ls", F.lit(1), F.col("k") - 1), changed, F.slice("ls", F.col("k") + 1, F.size("ls"))), "\n")
    patch = tx.bound(new, lambda n: ma.line_patch(F.col("text"), n))
    return found.select("id", patch.alias("p")).select("id", "p.old_start", "p.old_lines", F.md5(F.array_join("p.lines", "\n")).alias("patch"))


@register("f7_text_patched", """WITH t AS (SELECT doc_id AS id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)
SELECT id, md5(CASE WHEN len(ls) >= 2 THEN array_to_string(list_concat(list_concat(ls[1:f - 1], ['[' || id || ']']), ls[f + 2:]), chr(10)) END) AS digest
FROM (SELECT *, list_position(list_transform(range(1, len(ls)), lambda i: ls[i] = ls[len(ls) // 2] AND ls[i + 1] = ls[len(ls) // 2 + 1]), true) AS f FROM t)""")
def f7(spark, d):
    """Each text with the first block of its two middle lines replaced by its id."""
    docs = table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").alias("id"), "text", F.split("text", "\n").alias("ls"))
    half = F.floor(F.size("ls") / 2).cast("int")
    search = F.when(F.size("ls") >= 2, F.array_join(F.slice("ls", F.greatest(half, F.lit(1)), 2), "\n"))
    return docs.select("id", F.md5(ma.apply_patch(F.col("text"), search, F.concat(F.lit("["), F.col("id").cast("string"), F.lit("]")))).alias("digest"))


@register("p17_text_diffs", r"""WITH t AS (SELECT doc_id AS id, lang, '--- ' || lang || chr(10) || CASE doc_id % 4 WHEN 0 THEN '+++ ' || source WHEN 1 THEN '@@ -' || doc_id || ' @@' WHEN 2 THEN ' @@ -1 @@' ELSE '' END || chr(10) || coalesce(text, '') AS said FROM documents)
SELECT id, coalesce(regexp_matches(said, '(?m)^@@ -[0-9]') OR regexp_matches(said, '(?m)^--- ') AND regexp_matches(said, '(?m)^\+\+\+ '), false) AS diff FROM t""")
def p17(spark, d):
    """Texts behind heads that are those of a diff, half of one, or none."""
    i = F.col("doc_id")
    head = F.when(i % 4 == 0, F.concat(F.lit("+++ "), "source")).when(i % 4 == 1, F.concat(F.lit("@@ -"), i.cast("string"), F.lit(" @@"))).when(i % 4 == 2, F.lit(" @@ -1 @@")).otherwise("")
    said = F.concat(F.lit("--- "), "lang", F.lit("\n"), head, F.lit("\n"), F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select(i.alias("id"), ru.diff_shaped(said).alias("diff"))
