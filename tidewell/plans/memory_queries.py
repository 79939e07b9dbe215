"""Queries on memory entries, rules, hosts and records, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import text as tx
from tidewell.operators import entries as en
from tidewell.operators import rules as ru
from tidewell.plans.catalog import register
from tidewell.session import table

NOW = "2024-01-20 00:00:00"

#: Entries made of the documents: a day of January for each, tags and a tool from the id.
ENTRIES = """entries AS (SELECT doc_id AS entry_id, lang AS type, text AS content, source AS session,
  CASE doc_id % 3 WHEN 0 THEN ['a', 'b'] WHEN 1 THEN ['b'] ELSE [] END AS tags, (doc_id % 10) / 10.0::DOUBLE AS importance, (doc_id % 7) / 7.0::DOUBLE AS confidence,
  CASE WHEN doc_id % 4 <> 0 THEN 'tool' || (doc_id % 4) END AS tool, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 30 AS INT)) AS created,
  CASE WHEN doc_id % 5 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 30 + doc_id % 9 AS INT)) END AS expires FROM documents)"""


def _entries(spark, d):
    i, day = F.col("doc_id"), lambda n: F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(n.cast("int"))
    tags = F.when(i % 3 == 0, F.array(F.lit("a"), F.lit("b"))).when(i % 3 == 1, F.array(F.lit("b"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "documents").select(
        i.alias("entry_id"), F.col("lang").alias("type"), F.col("text").alias("content"), F.col("source").alias("session"), tags.alias("tags"), (i % 10 / 10.0).alias("importance"), (i % 7 / 7.0).alias("confidence"),
        F.when(i % 4 != 0, F.concat(F.lit("tool"), (i % 4).cast("string"))).alias("tool"), day(i % 30).alias("created"), F.when(i % 5 != 0, day(i % 30 + i % 9)).alias("expires"),
    )


@register("p1_entry_filter", f"""WITH {ENTRIES} SELECT entry_id FROM entries WHERE (expires IS NULL OR expires >= TIMESTAMP '{NOW}') AND type IN ('en', 'de') AND importance >= 0.3 AND confidence >= 0.2
AND list_has_any(tags, ['a', 'z']) AND created BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-28 00:00:00'""")
def p1(spark, d):
    at = lambda s: F.lit(s).cast("timestamp")
    return _entries(spark, d).filter(en.matches(at(NOW), ["en", "de"], 0.3, 0.2, tags=["a", "z"], span=(at("2024-01-05"), at("2024-01-28")))).select("entry_id")


@register("p2_content_and_keywords", f"""WITH {ENTRIES} SELECT entry_id FROM entries WHERE (expires IS NULL OR expires >= TIMESTAMP '{NOW}') AND contains(lower(content), 'tion') AND (contains(lower(content), 'stream') OR contains(lower(content), 'ing'))""")
def p2(spark, d):
    return _entries(spark, d).filter(en.matches(F.lit(NOW).cast("timestamp"), content="TION", keywords=["Stream", "ing"])).select("entry_id")


@register("p3_tool_filter", f"WITH {ENTRIES} SELECT entry_id FROM entries WHERE (expires IS NULL OR expires >= TIMESTAMP '{NOW}') AND (tool IS NULL OR tool = 'tool2')")
def p3(spark, d):
    return _entries(spark, d).filter(en.matches(F.lit(NOW).cast("timestamp"), tool="tool2")).select("entry_id")


@register("e6_sweep", f"WITH {ENTRIES} SELECT entry_id FROM entries WHERE coalesce(expires, created + INTERVAL 7 DAY) >= TIMESTAMP '{NOW}'")
def e6(spark, d):
    return en.sweep(_entries(spark, d), F.lit(NOW).cast("timestamp")).select("entry_id")


@register("a17_most_accessed", "SELECT user_id AS entry_id, count(*) AS accesses FROM events GROUP BY user_id ORDER BY accesses DESC, entry_id LIMIT 5")
def a17(spark, d):
    return en.most_accessed(table(spark, d, "events").groupBy(F.col("user_id").alias("entry_id")).agg(F.count("*").alias("accesses")))


@register("a16_merged_parameters", """SELECT source AS tool, lang || ',' || (doc_id % 2) AS params, count(*) AS uses, round(avg((doc_id % 4 <> 0)::INT), 6) AS success FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY ALL""")
def a16(spark, d):
    i = F.col("doc_id")
    pair = [F.lit("lang"), F.col("lang"), F.lit("odd"), (i % 2).cast("string")]
    # two orders of the same entries are one map
    params = F.when(i % 3 == 0, F.create_map(*pair)).otherwise(F.create_map(*pair[2:], *pair[:2]))
    uses = table(spark, d, "documents").filter("lang is not null and source is not null").select(F.col("source").alias("tool"), params.alias("params"), (i % 4 != 0).alias("ok"))
    return en.merged_parameters(uses).select("tool", F.concat_ws(",", F.transform("params", lambda e: e["value"])).alias("params"), "uses", F.round("success", 6).alias("success"))


@register("s14_export_import", f"WITH {ENTRIES} SELECT entry_id, type, len(tags)::INT AS n_tags, created FROM entries")
def s14(spark, d):
    slim = _entries(spark, d).select("entry_id", "type", "tags", "created")
    return en.imported(en.exported(slim), "entry_id long, type string, tags array<string>, created timestamp").select("entry_id", "type", F.size("tags").alias("n_tags"), "created")


RULES = [(0, 0, 5, "allow", "0", ""), (1, 1, 9, "allow", "1", "http://*"), (2, 2, 7, "allow", "1", "https://m.*"), (3, 3, 7, "deny", "1", ""), (4, 4, 1, "allow", "2", r"https://\*"), (5, 5, 3, "allow", "2", "https:*"), (6, 6, 3, "allow", "2", "*com*")]


@register("p8_rule_fit", r"""SELECT page_id, starts_with(url, 'http://') AS http, regexp_matches(url, '^https://m\..*$') AS mobile, (url = 'https' OR starts_with(url, 'https ')) AS legacy FROM pages""")
def p8(spark, d):
    fit = lambda r: ru.rule_fits(F.lit(r), F.col("url"))
    return table(spark, d, "pages").select("page_id", fit("http://*").alias("http"), fit("https://m.*").alias("mobile"), fit("https:*").alias("legacy"))


@register("p9_first_rule", r"""
WITH c AS (SELECT page_id AS call_id, page_id % 3 AS tool, url FROM pages)
SELECT call_id, CASE WHEN tool = 0 THEN 0 WHEN tool = 1 AND regexp_matches(url, '^http://.*$') THEN 1 WHEN tool = 1 AND regexp_matches(url, '^https://m\..*$') THEN 2 WHEN tool = 2 AND regexp_matches(url, '^.*com.*$') THEN 6 END::INT AS rule_id
FROM c WHERE tool = 0 OR (tool = 1 AND (regexp_matches(url, '^http://.*$') OR regexp_matches(url, '^https://m\..*$'))) OR (tool = 2 AND regexp_matches(url, '^.*com.*$'))""")
def p9(spark, d):
    rules = spark.createDataFrame(RULES, "rule_id int, seq int, priority int, behaviour string, tool string, content string")
    calls = table(spark, d, "pages").select(F.col("page_id").alias("call_id"), (F.col("page_id") % 3).cast("string").alias("tool"), F.col("url").alias("candidate"))
    return ru.first_rule(calls, rules, "allow")


@register("p10_name_patterns", "SELECT p_partkey FROM part WHERE p_name LIKE 'a%' OR p_name LIKE '%e' OR p_name = 'blue'")
def p10(spark, d):
    return table(spark, d, "part").filter(ru.name_fits(F.col("p_name"), ["a*", "*e", "blue"])).select("p_partkey")


HOST = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '^www\.', '')"
PATH = r"regexp_extract(url, '^[A-Za-z]+://[^/?#]+(/[^?#]*)?', 1)"


@register("p6_approved", f"""
WITH p AS (SELECT page_id AS id, {HOST} AS host, {PATH} AS path FROM pages), h AS (SELECT DISTINCT host FROM p WHERE id % 7 = 0), x AS (SELECT DISTINCT host, regexp_extract(path, '^/[^/]*', 0) AS prefix FROM p WHERE id % 2 = 0)
SELECT DISTINCT id FROM p WHERE host IN (SELECT host FROM h) OR EXISTS (SELECT 1 FROM x WHERE x.host = p.host AND (p.path = x.prefix OR starts_with(p.path, x.prefix || '/')))""")
def p6(spark, d):
    places = table(spark, d, "pages").select(F.col("page_id").alias("id"), tx.host_of(F.col("url")).alias("host"), F.regexp_extract("url", "^[A-Za-z]+://[^/?#]+(/[^?#]*)?", 1).alias("path"))
    prefixes = places.filter("id % 2 = 0").select("host", F.regexp_extract("path", "^/[^/]*", 0).alias("prefix")).distinct()
    return ru.approved(places, places.filter("id % 7 = 0").select("host"), prefixes)


@register("p14_base_folders", """SELECT * FROM (VALUES ('src/**/*.py', 'src', '**/*.py'), ('*.md', '', '*.md'), ('/*.txt', '/', '*.txt'), ('a/b/c.txt', 'a/b', 'c.txt'), ('C:/*.txt', 'C:/', '*.txt'), ('a/b{1,2}/c', 'a', 'b{1,2}/c')) t(pattern, folder, rest)""")
def p14(spark, d):
    globs = ["src/**/*.py", "*.md", "/*.txt", "a/b/c.txt", "C:/*.txt", "a/b{1,2}/c"]
    return spark.createDataFrame([(g, *ru.base_folder(g)) for g in globs], "pattern string, folder string, rest string")


MESSAGE = "CASE event_id % 8 WHEN 0 THEN 'Permission denied' WHEN 1 THEN 'no such FILE' WHEN 2 THEN 'Timeout after 3 s' WHEN 3 THEN 'connection error' WHEN 4 THEN 'invalid key' WHEN 5 THEN 'it failed' WHEN 6 THEN 'user not found, invalid' ELSE 'odd' END"


@register("p15_error_classes", f"""WITH m AS (SELECT event_id, lower({MESSAGE}) AS m FROM events),
k AS (SELECT event_id, CASE WHEN contains(m, 'permission denied') THEN 'permission' WHEN contains(m, 'not found') OR contains(m, 'no such file') THEN 'not_found' WHEN contains(m, 'timeout') THEN 'timeout' WHEN contains(m, 'connection') THEN 'connection'
  WHEN contains(m, 'invalid') THEN 'invalid' WHEN contains(m, 'failed') OR contains(m, 'error') THEN 'generic' ELSE 'unknown' END AS kind FROM m)
SELECT event_id, kind, CASE kind WHEN 'permission' THEN 'Check file permissions or run with appropriate access' WHEN 'not_found' THEN 'Verify the file path exists before operation' WHEN 'timeout' THEN 'Check network connectivity or increase timeout'
  WHEN 'connection' THEN 'Verify the service is running and accessible' WHEN 'invalid' THEN 'Check input format and parameters' ELSE 'Review error details and try again' END AS advice FROM k""")
def p15(spark, d):
    kind = ru.error_class(F.expr(MESSAGE))
    return table(spark, d, "events").select("event_id", kind.alias("kind"), ru.suggestion(kind).alias("advice"))


@register("p16_retry_classes", """WITH s AS (SELECT event_id, CAST(400 + event_id % 130 AS INT) AS s FROM events)
SELECT event_id, s IN (408, 409, 429, 500, 502, 503, 504) AS retry, CASE WHEN s = 429 THEN 'rate_limit' WHEN s IN (503, 504) THEN 'server_overload' WHEN s = 408 THEN 'timeout' WHEN s = 404 THEN 'model_deprecated' WHEN s IN (401, 403) THEN 'auth_error'
  WHEN s >= 500 THEN 'server_error' ELSE 'client_error' END AS kind FROM s""")
def p16(spark, d):
    s = (400 + F.col("event_id") % 130).cast("int")
    return table(spark, d, "events").select("event_id", s.isin(*ru.RETRYABLE).alias("retry"), ru.retry_class(s).alias("kind"))


@register("p19_record_problems", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'missing k' WHEN event_id % 5 = 1 THEN 'k: expected number' WHEN event_type NOT IN ('view', 'click') THEN 'type: not allowed' END AS problem FROM events""")
def p19(spark, d):
    e = table(spark, d, "events")
    record = F.when(F.col("event_id") % 5 == 0, F.to_json(F.struct(F.col("event_type").alias("type")))).when(F.col("event_id") % 5 == 1, F.to_json(F.struct(F.lit("x").alias("k"), F.col("event_type").alias("type")))).otherwise(F.to_json(F.struct(F.lit(3).alias("k"), F.col("event_type").alias("type"), F.lit(True).alias("more"))))
    return e.select("event_id", ru.record_problem(record, {"k": "number", "type": "string"}, ["k"], {"type": ["view", "click"]}).alias("problem"))


@register("p18_shell_segments", """SELECT event_id, 4 AS n, 'ls -l#grep ' || event_type || '#echo "a;b"#cat x' AS parts FROM events""")
def p18(spark, d):
    command = F.concat(F.lit("ls -l | grep "), F.col("event_type"), F.lit(' && echo "a;b"; cat x'))
    parts = ru.shell_segments(command)
    return table(spark, d, "events").select("event_id", F.size(parts).alias("n"), F.array_join(parts, "#").alias("parts"))


@register("p17_diff_shapes", """SELECT doc_id AS id, doc_id % 3 < 2 AS diff FROM documents""")
def p17(spark, d):
    i = F.col("doc_id")
    text = F.when(i % 3 == 0, F.lit("x\n@@ -1,2 +1,2 @@\n-a\n+b")).when(i % 3 == 1, F.lit("--- a/x\n+++ b/x\n")).otherwise(F.lit("--- a rule\n@@ no hunk"))
    return table(spark, d, "documents").select(i.alias("id"), ru.diff_shaped(text).alias("diff"))
