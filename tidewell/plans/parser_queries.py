"""Queries on searches over line ends, compiled expressions and shell commands, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import expressions as ex
from tidewell.functions import shell as sh
from tidewell.operators import search as se
from tidewell.operators import spans as sn
from tidewell.plans.catalog import register
from tidewell.plans.text_queries import LINES
from tidewell.session import table


def _docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


# where matches begin and end, from the stretches between them; then the lines that these places are in
SPAN = r"by\.\nTh|on\.\n[A-Z][a-z]+"
SPANS = f"""t AS (SELECT doc_id AS id, text, regexp_split_to_array(text, '(?s){SPAN}') AS gaps, regexp_extract_all(text, '(?s){SPAN}') AS hits FROM documents WHERE regexp_matches(text, '(?s){SPAN}')),
i AS (SELECT id, text, gaps, hits, unnest(range(1, len(hits) + 1)) AS i FROM t),
p AS (SELECT id, text, i, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS a, length(hits[i]) AS n FROM i),
l AS (SELECT id, text, length(left(text, a::BIGINT)) - length(replace(left(text, a::BIGINT), chr(10), '')) + 1 AS first, length(left(text, (a + n - 1)::BIGINT)) - length(replace(left(text, (a + n - 1)::BIGINT), chr(10), '')) + 1 AS last FROM p)"""


@register("p11_span_lines", f"WITH {SPANS} SELECT DISTINCT id, number::INT AS number, left(string_split(text, chr(10))[number], 500) AS line FROM (SELECT id, text, unnest(range(first, last + 1)) AS number FROM l)")
def p11_span(spark, d):
    """Lines that matches over line ends touch."""
    return sn.span_lines(_docs(spark, d), SPAN).select("id", "number", "line")


@register("p11_span_context", f"""WITH {SPANS}, h AS (SELECT DISTINCT id, unnest(range(first, last + 1)) AS number FROM l),
c AS (SELECT DISTINCT id, number + o AS number FROM h, (SELECT unnest([-1, 0, 1]) AS o))
SELECT c.id, c.number::INT AS number, md5(left(string_split(text, chr(10))[c.number], 500)) AS digest, EXISTS (SELECT 1 FROM h WHERE h.id = c.id AND h.number = c.number) AS hit
FROM c JOIN documents ON doc_id = c.id WHERE c.number BETWEEN 1 AND len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) THEN 1 ELSE 0 END""")
def p11_span_context(spark, d):
    """The same with a line before and after, those of neighbours merged."""
    return sn.span_lines(_docs(spark, d), SPAN, around=1).select("id", "number", F.md5("line").alias("digest"), "hit")


@register("p11_span_counts", f"SELECT doc_id AS id, len(regexp_extract_all(text, '(?s){SPAN}')) AS n FROM documents WHERE regexp_matches(text, '(?s){SPAN}')")
def p11_span_count(spark, d):
    return sn.span_counts(_docs(spark, d), SPAN)


def _hits(spark, d):
    return se.lines(_docs(spark, d)).filter(F.col("line").rlike("tion")).select("id", "number")


@register("p12_page", f"SELECT id, number::INT AS number FROM {LINES} WHERE regexp_matches(line, 'tion') ORDER BY id, number LIMIT 100 OFFSET 40")
def p12(spark, d):
    """The 41st to the 140th matching line."""
    return sn.page(_hits(spark, d), ["id", "number"], 100, 40)


@register("p12_page_beyond", f"SELECT id, number::INT AS number FROM {LINES} WHERE regexp_matches(line, 'tion') ORDER BY id, number LIMIT 100")
def p12_beyond(spark, d):
    """An offset beyond the last matching line is ignored."""
    return sn.page(_hits(spark, d), ["id", "number"], 100, 10**7)


@register("m3_compiled", """SELECT p_partkey, round(pow(p_size, pow(2, 0.5)), 6) AS tower, round(-pow(p_size, 2), 6) AS signed, CASE WHEN p_size > 25 AND p_retailprice < 1500 THEN p_size * 2 ELSE -p_size END::DOUBLE AS chosen,
  CASE WHEN p_size <> 7 THEN round(100.0::DOUBLE / (p_size - 7), 6) END AS holed, CASE WHEN p_size < 10 THEN round(sqrt(9 - p_size), 6) WHEN p_size = 10 THEN 0.0 ELSE 1.0 END AS guarded, CASE WHEN p_size < 20 THEN round(ln(20 - p_size), 6) END AS logs,
  round(((p_size * 7) % 5 - 3) * 2.0 - 6.0::DOUBLE / 4 / 3, 6) AS mixed, CASE WHEN p_size <= 12 THEN factorial(p_size::INT)::DOUBLE ELSE 0.0 END AS product, CASE WHEN NOT (p_size = 3 OR p_size >= 40) THEN 1 ELSE 0 END::DOUBLE AS truth,
  round(sin(pi() / p_size) + 2.718281828459045::DOUBLE * abs(3 - p_size), 6) AS waves, CASE WHEN p_size > 30 THEN 3 WHEN p_size > 10 THEN 2 ELSE 1 END::DOUBLE AS steps, round(log10(p_retailprice) + exp(1.0::DOUBLE / p_size), 6) AS curved FROM part""")
def m3(spark, d):
    """A dozen expressions, each compiled to a column."""
    asked = {
        "tower": "n ** 2 ** 0.5", "signed": "-n ** 2", "chosen": "n > 25 && price < 1500 ? n * 2 : -n", "holed": "100 / (n - 7)", "guarded": "n < 10 ? sqrt(9 - n) : n == 10 ? 0 : 1", "logs": "ln(20 - n)",
        "mixed": "(n * 7 % 5 - 3) * 2 - 6 / 4 / 3", "product": "n <= 12 ? n! : 0", "truth": "!(n == 3 || n >= 40) ? 1 : 0", "waves": "sin(pi / n) + e * abs(3 - n)", "steps": "n > 30 ? 3 : n > 10 ? 2 : 1", "curved": "log(price) + exp(1 / n)",
    }
    names = {"n": F.col("p_size"), "price": F.col("p_retailprice")}
    return table(spark, d, "part").select("p_partkey", *(F.round(ex.compile_expression(t, names), 6).alias(k) for k, t in asked.items()))


@register("p18_commands", r"""WITH c AS (SELECT event_id, event_type AS t, user_id AS u, event_id % 4 AS k FROM events)
SELECT event_id, CASE k WHEN 0 THEN 'command:K=' || u || ' grep "a|' || t || '" f' || u || '.log#pipe:wc -l#redirection:out.txt' WHEN 1 THEN 'command:git log --since ' || u || '#logical:echo ''x;' || t || '''#sequential:rm -f t'
 WHEN 2 THEN 'command:' || t || ' `date; pwd`#logical:cat#redirection:in' ELSE 'command:A=1 B=2 mv ' || t || ' \; done' END AS parts,
 CASE k WHEN 0 THEN 'search' WHEN 1 THEN 'version_control' WHEN 2 THEN 'unknown' ELSE 'write' END AS kind, CASE k WHEN 0 THEN 'K=' || u WHEN 3 THEN 'A=1,B=2' ELSE '' END AS env, k IN (0, 2) AS redirected, k <> 3 AS compound FROM c""")
def p18(spark, d):
    """Commands of the events' own values: variables, quotes, pipes, redirections and backticks."""
    t, u, k = F.col("event_type"), F.col("user_id").cast("string"), F.col("event_id") % 4
    said = F.when(k == 0, F.concat(F.lit("K="), u, F.lit(' grep "a|'), t, F.lit('" f'), u, F.lit(".log | wc -l > out.txt")))
    said = said.when(k == 1, F.concat(F.lit("git log --since "), u, F.lit(" && echo 'x;"), t, F.lit("' ; rm -f t"))).when(k == 2, F.concat(t, F.lit(" `date; pwd` || cat < in")))
    said = said.otherwise(F.concat(F.lit("A=1 B=2 mv "), t, F.lit(r" \; done")))
    cut = table(spark, d, "events").select("event_id", said.alias("c")).select("event_id", "c", sh.segments(F.col("c")).alias("s"), sh.environment(F.col("c"))["env"].alias("e"))
    parts = F.array_join(F.transform("s", lambda x: F.concat(x["kind"], F.lit(":"), x["text"])), "#")
    env = F.array_join(F.array_sort(F.transform(F.map_entries("e"), lambda x: F.concat(x["key"], F.lit("="), x["value"]))), ",")
    marks = [F.exists("s", lambda x: x["kind"] == "redirection").alias("redirected"), F.exists("s", lambda x: x["operator"] != "").alias("compound")]
    return cut.select("event_id", parts.alias("parts"), sh.command_kind(F.col("c")).alias("kind"), env.alias("env"), *marks)
