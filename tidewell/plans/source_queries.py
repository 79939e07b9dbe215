"""Queries on file contents, logs, approximate search and answers, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import records as rc
from tidewell.operators import retrieval as rt
from tidewell.plans.catalog import register
from tidewell.plans.retrieval_queries import COS, Q0, _first, _vectors
from tidewell.session import table
from tidewell.sources import files as fs


@register("s3_file_kinds", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'png' WHEN 2 THEN 'binary' WHEN 3 THEN 'binary' WHEN 4 THEN 'text' ELSE 'notebook' END AS kind FROM events""")
def s3(spark, d):
    i = F.col("event_id") % 6
    path = F.when(i == 1, "a/b.PNG").when(i == 5, "x.ipynb").otherwise("a/file")
    content = F.when(i == 0, F.unhex(F.lit("255044462D312E37"))).when(i == 2, F.unhex(F.lit("616200"))).when(i == 3, F.unhex(F.lit("61C3A9C3A9"))).otherwise(F.unhex(F.lit("61626364C3A9616263640A")))
    return table(spark, d, "events").select("event_id", fs.file_kind(path, content).alias("kind"))


@register("s4_text_slices", "SELECT doc_id AS id, n + 2 AS number, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))[3:5]) AS line, generate_subscripts(string_split(text, chr(10))[3:5], 1) AS n FROM documents)")
def s4(spark, d):
    kept = F.slice(F.split("text", "\n"), 3, 3)
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.posexplode(kept).alias("at", "line")).select("id", (F.col("at") + 3).alias("number"), "line")


@register("s5_notebook_cells", """SELECT p_partkey::VARCHAR AS path, 0 AS position, 'code' AS kind, 'x = ' || p_size AS source, p_size::VARCHAR AS outputs FROM part UNION ALL SELECT p_partkey::VARCHAR, 1, 'markdown', '# ' || p_name, '' FROM part""")
def s5(spark, d):
    n = F.col("p_size").cast("string")
    code = F.struct(F.lit("code").alias("cell_type"), F.array(F.lit("x = "), n).alias("source"), F.array(F.struct(F.lit("stream").alias("output_type"), F.array(n).alias("text"))).alias("outputs"))
    cells = F.concat(F.lit('{"cells":['), F.to_json(code), F.lit(","), F.to_json(F.struct(F.lit("markdown").alias("cell_type"), F.array(F.concat(F.lit("# "), "p_name")).alias("source"))), F.lit("]}"))
    return fs.notebook_cells(table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), cells.alias("text")))


@register("s6_conversions", """SELECT p_partkey AS id, CASE WHEN p_partkey % 3 < 2 THEN '# ' || p_name END AS markdown, CASE WHEN p_partkey % 3 < 2 THEN 2 END AS pages, CASE WHEN p_partkey % 3 < 2 THEN 'image_0001.png,image_0003.jpg' END AS images, CASE WHEN p_partkey % 3 = 2 THEN 'bad; worse' END AS problem FROM part""")
def s6(spark, d):
    image = lambda uri: f'{{"image":{{"uri":"{uri}"}}}}'
    body = F.concat(F.lit('{"status":"'), F.when(F.col("p_partkey") % 3 == 0, "success").when(F.col("p_partkey") % 3 == 1, "partial_success").otherwise("failure"), F.lit('","errors":["bad","worse"],"document":{"md_content":"# '), F.col("p_name"), F.lit('","pages":{"1":"a","2":"b"},"pictures":[' + ",".join([image("data:image/png;base64,AAA"), image("http://x"), image("data:image/jpeg;base64,BBB")]) + "]}}"))
    out = fs.converted_documents(table(spark, d, "part").select(F.col("p_partkey").alias("id"), body.alias("text")))
    return out.select("id", "markdown", "pages", F.array_join("images", ",").alias("images"), "problem")


@register("s8_log_tail", """SELECT event_id AS "offset", '{"api_key":"[REDACTED]","k":"' || event_type || '"}' AS line FROM events ORDER BY event_id DESC LIMIT 25""")
def s8(spark, d):
    line = F.to_json(F.struct(F.lit("s3").alias("api_key"), F.col("event_type").alias("k")))
    return fs.log_tail(table(spark, d, "events").select(F.col("event_id").alias("offset"), line.alias("line")), 25)


@register("s9_artifacts")
def s9(spark, d):
    """The supplied files themselves, by name: sorted before any limit, as an order of the folder is none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(d).select("path", F.col("length").alias("size"))
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "size").orderBy("name")


@register("v5_near_top_k", f"SELECT key, score FROM (SELECT vec_id AS key, label, round({COS}, 6) AS score FROM embeddings e, {Q0} ORDER BY {COS} DESC, vec_id LIMIT 20) WHERE label = 1")
def v5(spark, d):
    """All buckets, so the rows are those of an exact search; the filter comes after the top k."""
    return rt.near_top_k(_vectors(spark, d), _first(spark, d), 20, F.col("namespace") == 1, bits=6, radius=6).select("key", F.round("score", 6).alias("score"))


@register("v8_term_rank", r"""WITH w AS (SELECT doc_id AS id, regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{Nd}]+') AS ts FROM documents),
n AS (SELECT id, len(list_filter(ts, lambda t: t = 'the')) AS a, len(list_filter(ts, lambda t: t = 'of')) AS b FROM w)
SELECT id, round((coalesce(list_sum(list_transform(range(1, a + 1), lambda i: 0.1::DOUBLE / (i * i))), 0) + coalesce(list_sum(list_transform(range(1, b + 1), lambda i: 0.1::DOUBLE / (i * i))), 0)) / 1.64493406685 / 2, 6) AS rank FROM n""")
def v8(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.round(rt.term_rank(F.col("text"), "the of"), 6).alias("rank"))


@register("v17_reranked", f"""WITH h AS (SELECT vec_id AS key, (row_number() OVER (ORDER BY {COS} DESC, vec_id) - 1) AS position FROM embeddings e, {Q0} ORDER BY position LIMIT 20) SELECT key, position FROM h WHERE position IN (1, 4, 7) ORDER BY position DESC LIMIT 2""")
def v17(spark, d):
    from pyspark.sql import Window

    top = rt.top_k(_vectors(spark, d), _first(spark, d), 20)
    # the 20 rows of the top k are numbered
    hits = top.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "key")) - 1).select("key", "position")
    ranks = spark.createDataFrame([(1, 0.1), (4, 0.2), (7, 0.9), (99, 1.0)], "index int, rank double")
    return rt.reranked(hits, ranks, 2).select("key", "position")


@register("v18_clamped_weights", "SELECT event_id, greatest(0.0, least(1.0, value / 50 - 0.5)) AS weight, CASE WHEN event_id % 4 < 1 THEN 5 ELSE event_id % 4 END::BIGINT AS k FROM events")
def v18(spark, d):
    k = F.col("event_id") % 4
    return table(spark, d, "events").select("event_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") / 50 - 0.5)).alias("weight"), F.when(k < 1, F.lit(5)).otherwise(k).cast("long").alias("k"))


@register("v19_rendered", """SELECT 'Corpus: parts — 3 result(s)' || chr(10) || chr(10) || string_agg('[' || p_partkey || '] score=' || printf('%.4f', p_size / 10.0) || '  file=' || p_brand || chr(10) || p_name, chr(10) || chr(10) ORDER BY p_partkey) AS text FROM part WHERE p_partkey BETWEEN 1 AND 3""")
def v19(spark, d):
    hits = table(spark, d, "part").filter("p_partkey between 1 and 3").select((F.col("p_partkey") - 1).cast("int").alias("position"), (F.col("p_size") / 10.0).alias("score"), F.col("p_brand").alias("filename"), F.lit("").alias("chunk"), F.col("p_name").alias("text"))
    return rt.rendered(hits, "parts")


@register("c9_embedded", "SELECT doc_id AS id, 64 AS dim FROM documents")
def c9(spark, d):
    e = rt.embed(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
    return e.select("id", F.size("embedding").alias("dim"))


@register("c10_providers", "SELECT page_id, CASE WHEN contains(url, 'example.com') THEN 'com' WHEN contains(url, 'example.net') THEN 'net' ELSE 'other' END AS provider FROM pages")
def c10(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", F.when(u.contains("example.com"), "com").when(u.contains("example.net"), "net").otherwise("other").alias("provider"))


@register("j3_appended_in_order", """WITH o AS (SELECT p_brand AS name, list(p_size ORDER BY p_partkey) FILTER (p_partkey % 2 = 0) AS a, list(p_size ORDER BY p_partkey) FILTER (p_partkey % 2 = 1) AS b FROM part GROUP BY p_brand),
c AS (SELECT name, list_concat(coalesce(a, []), coalesce(b, [])) AS l FROM o)
SELECT name, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS observations FROM c""")
def j3(spark, d):
    ordered = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("p_partkey") % 2 == k, F.struct("p_partkey", F.col("p_size").cast("string").alias("v"))))), lambda s: s["v"])
    o = table(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg(ordered(0).alias("a"), ordered(1).alias("b"))
    return o.select("name", F.array_join(rc.append_distinct(F.col("a"), F.col("b")), ",").alias("observations"))


@register("k1_observations_search", "SELECT n_regionkey FROM nation GROUP BY n_regionkey HAVING lower(to_json(list(n_name ORDER BY n_nationkey))::VARCHAR) LIKE '%a_i%'")
def k1(spark, d):
    obs = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: s["n_name"])
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.to_json(obs).alias("json")).filter(F.lower("json").like("%a_i%")).select("n_regionkey")


@register("b6_snapshot_rank", r"""SELECT page_id, 5 * ((length(lower(regexp_extract(html, '<title>([^<]*)', 1))) - length(replace(lower(regexp_extract(html, '<title>([^<]*)', 1)), 'on', ''))) // 2) + 3 * ((length(lower(url)) - length(replace(lower(url), 'on', ''))) // 2)
 + (length(lower(html)) - length(replace(lower(html), 'on', ''))) // 2 AS score FROM pages ORDER BY score DESC, page_id DESC LIMIT 20""")
def b6(spark, d):
    """Occurrences by weight in title, address and text; the newest of equal ones first."""
    from tidewell.functions import text as tx

    low = lambda c: tx.occurrences(F.lower(c), "on")
    score = 5 * low(F.regexp_extract("html", "<title>([^<]*)", 1)) + 3 * low(F.col("url")) + low(F.col("html"))
    return table(spark, d, "pages").select("page_id", score.cast("long").alias("score")).orderBy(F.desc("score"), F.desc("page_id")).limit(20)
