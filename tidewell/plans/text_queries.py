"""Queries on texts, paths, addresses and line searches, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import text as tx
from tidewell.operators import search as se
from tidewell.plans.catalog import register
from tidewell.session import table


def _docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def _pages(spark, d):
    return table(spark, d, "pages")


@register("s12_namespace_slug", "SELECT page_id, coalesce(nullif(left(regexp_replace(url, '[^A-Za-z0-9-]', '_', 'g'), 200), ''), 'default') AS slug FROM pages")
def s12(spark, d):
    return _pages(spark, d).select("page_id", tx.namespace_slug(F.col("url")).alias("slug"))


@register("s13_stable_id", """
WITH h AS (SELECT vec_id, sha256(label::VARCHAR || chr(0) || vec_id::VARCHAR) AS s FROM embeddings)
SELECT vec_id, ('0x' || s[15:16] || s[13:14] || s[11:12] || s[9:10] || s[7:8] || s[5:6] || s[3:4] || s[1:2])::UBIGINT::VARCHAR AS stable_id FROM h""")
def s13(spark, d):
    v = table(spark, d, "embeddings")
    return v.select("vec_id", tx.stable_id(F.col("label").cast("string"), F.col("vec_id").cast("string")).alias("stable_id"))


@register("s11_object_key", "SELECT doc_id AS id, 'rag/' || regexp_replace(source, '[^A-Za-z0-9._-]', '_', 'g') || '/' || doc_id || '.txt' AS key FROM documents WHERE source IS NOT NULL")
def s11(spark, d):
    docs = table(spark, d, "documents").filter("source IS NOT NULL")
    return docs.select(F.col("doc_id").alias("id"), tx.object_key("rag", F.col("source"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("key"))


@register("q6_stable_key", "SELECT page_id, left(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 96) AS key FROM pages")
def q6(spark, d):
    return _pages(spark, d).select("page_id", tx.stable_key(F.col("url")).alias("key"))


@register("q7_collapsed", r"""SELECT page_id, CASE WHEN length(t) > 80 THEN left(t, 79) || '…' ELSE t END AS text FROM (SELECT page_id, trim(regexp_replace(html, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS t FROM pages)""")
def q7(spark, d):
    return _pages(spark, d).select("page_id", tx.ellipsis(tx.collapse_space(F.col("html")), 80).alias("text"))


@register("p4_hosts", r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '^www\.', '') AS host FROM pages")
def p4(spark, d):
    return _pages(spark, d).select("page_id", tx.host_of(F.col("url")).alias("host"))


@register("p5_domain_rules", r"""
WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '^www\.', '') AS host FROM pages)
SELECT page_id, host FROM h WHERE host <> '' AND NOT (host = 'com' OR host LIKE '%.com')""")
def p5(spark, d):
    hosts = _pages(spark, d).select("page_id", tx.host_of(F.col("url")).alias("host")).filter("host <> ''")
    blocked = spark.createDataFrame([("com",)], "domain string")
    return se.domain_rules(hosts, blocked, keep=False)


@register("p7_wildcard", "SELECT page_id FROM pages WHERE regexp_matches(url, '(?is)^.*a.*e..*$')")
def p7(spark, d):
    return _pages(spark, d).filter(F.col("url").rlike(tx.wildcard_pattern("*A*e?*"))).select("page_id")


@register("p13_glob", "SELECT page_id FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/([^?]*)', 1) AS path FROM pages) WHERE regexp_matches(path, '^(?:[^/]+/)*[^/]*1[^/]*$')")
def p13(spark, d):
    path = F.regexp_extract("url", "^[a-z]+://[^/]+/([^?]*)", 1)
    return _pages(spark, d).filter(path.rlike(tx.glob_pattern("**/*1*"))).select("page_id")


LINES = "(SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS number FROM documents WHERE text IS NOT NULL)"


@register("p11_grep_content", f"SELECT id, number::INT AS number, left(line, 500) AS line FROM {LINES} WHERE regexp_matches(line, '(?i)TION') ORDER BY id, number LIMIT 250")
def p11(spark, d):
    return se.grep(_docs(spark, d), "TION", ignore_case=True)


@register("p11_grep_files", f"SELECT DISTINCT id FROM {LINES} WHERE regexp_matches(line, 'tion')")
def p11_files(spark, d):
    return se.grep_files(_docs(spark, d), "tion")


@register("p11_grep_count", f"SELECT id, count(*) AS n FROM {LINES} WHERE regexp_matches(line, 'tion') GROUP BY id")
def p11_count(spark, d):
    return se.grep_count(_docs(spark, d), "tion")


@register("jn6_context_lines", f"SELECT DISTINCT l.id, l.number::INT AS number, l.line FROM {LINES} l JOIN {LINES} m ON l.id = m.id AND abs(l.number - m.number) <= 2 WHERE regexp_matches(m.line, 'token')")
def jn6(spark, d):
    return se.context_lines(_docs(spark, d), "token", 2)


@register("p20_snipped", "SELECT doc_id AS id, md5(CASE WHEN length(text) > 1000 THEN left(text, 500) || ' [...] ' || right(text, 500) ELSE text END) AS digest FROM documents")
def p20(spark, d):
    return _docs(spark, d).select("id", F.md5(tx.snip(F.col("text"), 1000).cast("binary")).alias("digest"))


@register("p21_sizes", """SELECT id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', floor(n / 1024.0 * 10 + 0.5) / 10) ELSE printf('%.1f MB', floor(n / 1048576.0 * 10 + 0.5) / 10) END AS size
FROM (SELECT doc_id AS id, octet_length(encode(coalesce(text, ''))) AS n FROM documents)""")
def p21(spark, d):
    return _docs(spark, d).select("id", tx.human_size(F.octet_length(F.coalesce("text", F.lit("")))).alias("size"))


@register("p22_lines", "SELECT doc_id AS id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS n FROM documents")
def p22(spark, d):
    return _docs(spark, d).select("id", tx.line_count(F.col("text")).alias("n"))


@register("p23_untagged", """SELECT page_id, md5(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')) AS digest FROM pages""")
def p23(spark, d):
    return _pages(spark, d).select("page_id", F.md5(tx.strip_tags(F.col("html")).cast("binary")).alias("digest"))


@register("p24_token_estimates", "SELECT doc_id AS id, greatest(length(coalesce(text, '')) // 4, 1) AS tokens, octet_length(encode(coalesce(text, ''))) // 4 AS byte_tokens FROM documents")
def p24(spark, d):
    return _docs(spark, d).select("id", tx.token_estimate(F.col("text")).alias("tokens"), tx.byte_token_estimate(F.col("text")).alias("byte_tokens"))


@register("p25_secret_fields", "SELECT doc_id AS id FROM documents WHERE regexp_matches(text, '(?i)(password|secret|token|api_?key)')")
def p25(spark, d):
    return _docs(spark, d).filter(F.col("text").rlike("(?i)(password|secret|token|api_?key)")).select("id")


@register("p17_diffs", "SELECT doc_id AS id, regexp_matches(text, '(?m)^@@|^--- |^\\+\\+\\+ ') AS is_diff FROM documents WHERE text IS NOT NULL".replace("\\\\", "\\"))
def p17(spark, d):
    return _docs(spark, d).filter("text IS NOT NULL").select("id", F.col("text").rlike(r"(?m)^@@|^--- |^\+\+\+ ").alias("is_diff"))


@register("h7_normal_urls", r"SELECT page_id, regexp_replace(url, '^http://', 'https://') AS url FROM pages WHERE regexp_matches(url, '^https?://[^/]') AND NOT regexp_matches(url, '^https?://(localhost|127\.|10\.|192\.168\.|\[::1\])')")
def h7(spark, d):
    return _pages(spark, d).select("page_id", tx.normal_url(F.col("url")).alias("url")).filter("url IS NOT NULL")


@register("h11_min_score", "SELECT event_id FROM events WHERE value = 0 OR value >= 50")
def h11(spark, d):
    return table(spark, d, "events").filter((F.col("value") == 0) | (F.col("value") >= 50)).select("event_id")


@register("h14_cache_keys", "SELECT p_partkey, lower(trim(p_name)) || '|' || array_to_string(list_sort([p_brand, p_type]), ',') AS key FROM part")
def h14(spark, d):
    key = F.concat_ws("|", F.lower(F.trim("p_name")), F.array_join(F.array_sort(F.array("p_brand", "p_type")), ","))
    return table(spark, d, "part").select("p_partkey", key.alias("key"))


@register("f3_json_keys", "SELECT event_id, len(json_keys(props))::INT AS n FROM events WHERE props IS NOT NULL")
def f3(spark, d):
    return table(spark, d, "events").filter("props IS NOT NULL").select("event_id", F.size(F.json_object_keys("props")).alias("n"))


@register("f8_folded_quotes", """SELECT doc_id AS id, md5(translate(replace(text, chr(13) || chr(10), chr(10)), '‘’“”', '''''""')) AS digest FROM documents""")
def f8(spark, d):
    return _docs(spark, d).select("id", F.md5(tx.fold_quotes(F.col("text")).cast("binary")).alias("digest"))


@register("b3_exact_names", "SELECT n_nationkey FROM nation WHERE lower(n_name) IN (SELECT lower(n_name) FROM nation WHERE n_nationkey < 3)")
def b3(spark, d):
    nation = table(spark, d, "nation")
    asked = nation.filter("n_nationkey < 3").select(F.lower("n_name").alias("name"))
    return nation.join(F.broadcast(asked), F.lower("n_name") == F.col("name"), "left_semi").select("n_nationkey")


@register("b4_search_text", "SELECT p_partkey, concat_ws(' ', p_name, replace(p_name, '_', ' '), p_brand, p_type) AS text FROM part")
def b4(spark, d):
    return table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.replace("p_name", F.lit("_"), F.lit(" ")), "p_brand", "p_type").alias("text"))


@register("b8_completion_tiers", """SELECT p_partkey, CASE WHEN lower(p_name) = 'part' THEN 0 WHEN starts_with(lower(p_name), 'part') THEN 1 WHEN contains('/' || lower(p_type), '/part') THEN 2 ELSE 3 END AS tier FROM part""")
def b8(spark, d):
    return table(spark, d, "part").select("p_partkey", se.completion_tier(F.col("p_name"), F.col("p_type"), "part").alias("tier"))
