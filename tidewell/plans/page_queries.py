"""Queries on web pages, their slices and search answers, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import pages as pg
from tidewell.plans.catalog import register
from tidewell.session import table


def _pages(spark, d):
    return table(spark, d, "pages")


@register("h1_markdown")
def h1(spark, d):
    return _pages(spark, d).select("page_id", pg.page_markdown("html").alias("markdown"))


SPACED = r"replace(replace(html, '><', '>' || chr(13) || chr(10) || '   <'), '. ', '. ' || chr(10) || chr(10) || chr(10) || ' ')"


@register("h4_clean_whitespace", rf"""SELECT page_id, md5(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(replace({SPACED}, chr(13) || chr(10), chr(10)), chr(10)), lambda s: trim(s, ' ' || chr(9) || chr(11) || chr(12) || chr(13))), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM pages""")
def h4(spark, d):
    spaced = F.replace(F.replace("html", F.lit("><"), F.lit(">\r\n   <")), F.lit(". "), F.lit(". \n\n\n "))
    return _pages(spark, d).select("page_id", F.md5(pg.clean_whitespace(spaced).cast("binary")).alias("digest"))


@register("h5_normal_text", r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&'), '[ \t\n\x0B\f\r\x{00A0}]+', ' ', 'g'))) AS digest FROM pages""")
def h5(spark, d):
    return _pages(spark, d).select("page_id", F.md5(pg.normal_text(F.col("html")).cast("binary")).alias("digest"))


@register("h6_needs_browser", """WITH p AS (SELECT page_id, lower(CASE page_id % 4 WHEN 0 THEN html || 'Enable JavaScript' WHEN 1 THEN html || repeat('<script>', 8) || '<div id="root">' WHEN 2 THEN html || repeat('<script>', 2) || '<div id="root">' ELSE html END) AS h FROM pages)
SELECT page_id, contains(h, 'enable javascript') OR contains(h, 'javascript is required') OR contains(h, 'please enable javascript') OR contains(h, '<meta http-equiv="refresh"')
 OR ((length(h) - length(replace(h, '<script', ''))) // 7 >= 8 AND (contains(h, 'id="__next"') OR contains(h, 'id="root"') OR contains(h, 'id="app"') OR contains(h, 'data-reactroot') OR contains(h, 'window.__next_data__')
  OR contains(h, 'window.__apollo_state__') OR contains(h, '__nuxt') OR contains(h, 'ng-version'))) AS browser FROM p""")
def h6(spark, d):
    i, h = F.col("page_id") % 4, F.col("html")
    page = F.when(i == 0, F.concat(h, F.lit("Enable JavaScript"))).when(i == 1, F.concat(h, F.lit("<script>" * 8 + '<div id="root">'))).when(i == 2, F.concat(h, F.lit("<script>" * 2 + '<div id="root">'))).otherwise(h)
    return _pages(spark, d).select("page_id", pg.needs_browser(page).alias("browser"))


@register("h8_result_links", """SELECT page_id, 'Title ' || page_id AS title, url, 'About ' || page_id AS content FROM pages WHERE url LIKE 'http%'""")
def h8(spark, d):
    n = F.col("page_id").cast("string")
    result = F.concat(F.lit('<div class="result"><a href="#x">no</a></div><article class="result x"><h3><a href="'), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit('">Title <b>'), n, F.lit('</b></a></h3><p class="content">About\n '), n, F.lit("</p></article>"))
    return _pages(spark, d).select("page_id", F.inline(pg.result_links(result)))


@register("h9_json_hits", """SELECT page_id, CASE page_id % 3 WHEN 1 THEN url ELSE 'T' || page_id END AS title, url, CASE page_id % 3 WHEN 2 THEN 'short' ELSE '' END AS description, '' AS source FROM pages""")
def h9(spark, d):
    i, u = F.col("page_id") % 3, F.col("url")
    name = F.concat(F.lit("T"), F.col("page_id").cast("string"))
    gone = F.struct(F.lit("x").alias("title"), F.lit(" ").alias("url"))
    flat = F.to_json(F.struct(F.array(F.struct(name.alias("title"), u.alias("url")), gone).alias("results")))
    deep = F.to_json(F.struct(F.struct(F.array(F.struct(F.lit(" ").alias("title"), u.alias("url"))).alias("items")).alias("data")))
    bare = F.to_json(F.array(F.struct(name.alias("headline"), u.alias("link"), F.lit(" short ").alias("snippet"))))
    payload = F.when(i == 0, flat).when(i == 1, deep).otherwise(bare)
    return _pages(spark, d).select("page_id", F.inline(pg.json_hits(payload)))


#: Texts of documents as markdown: every seventh line a heading, others of the second level.
MARKED = "list_transform(string_split(text, chr(10)), lambda x, i: CASE (i - 1) % 7 WHEN 0 THEN '# ' || x WHEN 3 THEN '## ' || x ELSE x END)"


def _marked(spark, d):
    lines = F.transform(F.split("text", "\n"), lambda s, i: F.when(i % 7 == 0, F.concat(F.lit("# "), s)).when(i % 7 == 3, F.concat(F.lit("## "), s)).otherwise(s))
    return table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").alias("id"), F.array_join(lines, "\n").alias("text"))


@register("h12_headings", f"SELECT doc_id AS id, array_to_string(list_filter({MARKED}, lambda s: regexp_matches(s, '^#{{1,6}} ')), chr(10)) AS found FROM documents WHERE text IS NOT NULL")
def h12(spark, d):
    return _marked(spark, d).select("id", pg.headings(F.col("text")).alias("found"))


@register("h12_sections", f"""
WITH l AS (SELECT doc_id AS id, unnest({MARKED}) AS line, generate_subscripts({MARKED}, 1) AS n FROM documents WHERE text IS NOT NULL),
v AS (SELECT *, length(regexp_extract(line, '^#*')) AS level FROM l),
s AS (SELECT id, min(n) AS n0, arg_min(level, n) AS level0 FROM v WHERE level > 0 AND contains(lower(line), 'tion') GROUP BY id),
e AS (SELECT s.id, min(v.n) AS n1 FROM s JOIN v ON v.id = s.id AND v.n > s.n0 AND v.level BETWEEN 1 AND s.level0 GROUP BY s.id)
SELECT d.doc_id AS id, coalesce(md5(string_agg(v.line, chr(10) ORDER BY v.n)), md5('')) AS digest FROM documents d LEFT JOIN s ON s.id = d.doc_id LEFT JOIN e ON e.id = d.doc_id
LEFT JOIN v ON v.id = d.doc_id AND v.n >= s.n0 AND (e.n1 IS NULL OR v.n < e.n1) WHERE d.text IS NOT NULL GROUP BY d.doc_id""")
def h12_sections(spark, d):
    return _marked(spark, d).select("id", F.md5(pg.section(F.col("text"), "Tion").cast("binary")).alias("digest"))


@register("h13_sliced", r"""SELECT doc_id AS id, CASE WHEN len(string_split(text, chr(10))) < 2 THEN 'Paragraph range "2-3" is invalid or out of bounds.' ELSE
  substr(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '')[2:3], chr(10) || chr(10)), 6, 40) END AS part FROM documents
WHERE text IS NOT NULL AND len(list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '')) = len(string_split(text, chr(10)))""")
def h13(spark, d):
    docs = table(spark, d, "documents").filter(F.col("text").isNotNull() & F.forall(F.split("text", "\n"), lambda s: F.trim(s) != ""))
    return docs.select(F.col("doc_id").alias("id"), pg.sliced(F.replace("text", F.lit("\n"), F.lit("\n\n")), span="2-3", start=5, most=40).alias("part"))


@register("h15_provider_chain", """WITH a AS (SELECT user_id AS qid, event_type AS provider, CASE event_type WHEN 'view' THEN 10 WHEN 'click' THEN 20 WHEN 'purchase' THEN 40 ELSE 100 END AS priority, event_type = 'error' AS failed, count(*) % 3 AS hits FROM events GROUP BY ALL),
last AS (SELECT qid, max(priority) AS p FROM a GROUP BY qid)
SELECT qid, arg_min(provider, (priority, provider)) AS provider FROM a JOIN last USING (qid) WHERE NOT failed AND NOT (provider = 'purchase' AND hits = 0 AND priority < p) GROUP BY qid""")
def h15(spark, d):
    """The answer of the first provider that did not fail; the self-hosted one is passed over when it
    found nothing and another follows."""
    answers = table(spark, d, "events").groupBy(F.col("user_id").alias("qid"), F.col("event_type").alias("provider")).agg((F.count("*") % 3).alias("hits"))
    name = F.col("provider")
    answers = answers.withColumn("priority", F.when(name == "view", 10).when(name == "click", 20).when(name == "purchase", 40).otherwise(100))
    last = answers.groupBy("qid").agg(F.max("priority").alias("last"))
    usable = answers.join(last, "qid").filter("provider <> 'error' AND NOT (provider = 'purchase' AND hits = 0 AND priority < last)")
    return usable.groupBy("qid").agg(F.min_by("provider", F.struct("priority", "provider")).alias("provider"))
