"""Queries on search, ranking and chunking, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions import text as tx
from tidewell.functions import vectors as vx
from tidewell.operators import chunks as ch
from tidewell.operators import retrieval as rt
from tidewell.plans.catalog import register
from tidewell.session import table

QUERY = "the stream of orders with worthless data tion that heed"


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("label").alias("namespace"), "embedding")


def _first(spark, d) -> list[float]:
    """The vector with id 0: the query of the examples."""
    return list(table(spark, d, "embeddings").filter("vec_id = 0").first()["embedding"])


def _docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang")).alias("metadata"))


COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
Q0 = "(SELECT embedding FROM embeddings WHERE vec_id = 0) q"
# the SQL has a list of its own
STOPS = """'a', 'an', 'and', 'are', 'as', 'at', 'be', 'by', 'do', 'for', 'from', 'has', 'have', 'he', 'in', 'is', 'it', 'its', 'of', 'on', 'or', 'that', 'the', 'this', 'to', 'was', 'were', 'will', 'with'"""
TOKENS = f"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{Nd}}]+'), lambda t: octet_length(encode(t)) >= 2 AND t NOT IN ({STOPS}))"


@register("v1_cosine", f"SELECT vec_id AS key, round({COS}, 6) AS score FROM embeddings e, {Q0}")
def v1(spark, d):
    return _vectors(spark, d).select("key", F.round(vx.cosine(F.col("embedding"), vx.literal(_first(spark, d))), 6).alias("score"))


@register("v2_top_k", f"SELECT vec_id AS key, round({COS}, 6) AS score FROM embeddings e, {Q0} WHERE label = 1 ORDER BY {COS} DESC, vec_id LIMIT 5")
def v2(spark, d):
    return rt.top_k(_vectors(spark, d), _first(spark, d), where=F.col("namespace") == 1).select("key", F.round("score", 6).alias("score"))


@register("v3_batched_top_k", f"""
SELECT qid, key, round(score, 6) AS score, rank FROM (
  SELECT q.vec_id AS qid, e.vec_id AS key, {COS} AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS} DESC, e.vec_id) AS rank
  FROM embeddings q JOIN embeddings e ON q.label = e.label WHERE q.vec_id % 100 = 0) WHERE rank <= 5""")
def v3(spark, d):
    v = _vectors(spark, d)
    asked = v.filter("key % 100 = 0").select(F.col("key").alias("qid"), "namespace", F.col("embedding").alias("q"))
    return rt.batched_top_k(v, asked).select("qid", "key", F.round("score", 6).alias("score"), "rank")


@register("v4_metadata_filter", "SELECT doc_id AS id FROM documents WHERE coalesce(source, '') = 'src3' AND coalesce(lang, '') IN ('de', 'fr')")
def v4(spark, d):
    return _docs(spark, d).filter(rt.metadata_filter({"source": "src3", "lang": ["de", "fr"]})).select("id")


BM25 = f"""
tok AS (SELECT doc_id AS id, {TOKENS} AS ts FROM documents),
st AS (SELECT count(*) AS n, avg(len(ts)) AS al FROM tok),
asked AS (SELECT term, count(*) AS times FROM (SELECT unnest({TOKENS.replace("coalesce(text, '')", f"'{QUERY}'")}) AS term) GROUP BY term),
tf AS (SELECT id, len(ts) AS l, term, times, count(*) AS tf FROM (SELECT id, ts, unnest(ts) AS term FROM tok) JOIN asked USING (term) GROUP BY id, ts, term, times),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT id, sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * l / al))) AS score
       FROM tf JOIN df USING (term), st GROUP BY id HAVING score > 0)"""


@register("b1_bm25", f"WITH {BM25} SELECT id, round(score, 6) AS score FROM bm")
def b1(spark, d):
    return rt.bm25(_docs(spark, d), QUERY).select("id", F.round("score", 6).alias("score"))


@register("b1_bm25_top_k", f"WITH {BM25} SELECT id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, id LIMIT 10")
def b1_top(spark, d):
    return rt.bm25(_docs(spark, d), QUERY).orderBy(F.desc("score"), "id").limit(10).select("id", F.round("score", 6).alias("score"))


@register("b2_token_counts", f"SELECT doc_id AS id, len({TOKENS})::INT AS n_tokens FROM documents")
def b2(spark, d):
    return _docs(spark, d).select("id", F.size(tx.lexical_tokens(F.col("text"))).alias("n_tokens"))


@register("v6_hybrid", f"""
WITH {BM25}, s AS (SELECT e.vec_id AS key, {COS} AS cos, coalesce(bm.score / (SELECT max(score) FROM bm), 0) AS lex
  FROM embeddings e LEFT JOIN bm ON bm.id = e.vec_id, {Q0})
SELECT key, round(0.3 * cos + 0.7 * lex, 6) AS score FROM s ORDER BY 0.3 * cos + 0.7 * lex DESC, key LIMIT 10""")
def v6(spark, d):
    return rt.hybrid(_vectors(spark, d), rt.bm25(_docs(spark, d), QUERY), _first(spark, d), 0.7, 10).select("key", F.round("score", 6).alias("score"))


@register("v7_keyword_share", """SELECT doc_id AS id, round((contains(lower(text), 'the')::INT + contains(lower(text), 'stream')::INT + contains(lower(text), 'tion')::INT) / 3, 6) AS share FROM documents""")
def v7(spark, d):
    return _docs(spark, d).select("id", F.round(rt.keyword_share(F.col("text"), "The stream tion"), 6).alias("share"))


@register("v9_query_terms", """SELECT doc_id AS id, trim(translate(text, '"()*^-+', '       ')) AS q FROM documents""")
def v9(spark, d):
    return _docs(spark, d).select("id", tx.query_terms(F.col("text")).alias("q"))


@register("v10_half_distance", f"SELECT vec_id AS key, round((2 - (1 - {COS})) / 2, 6) AS score FROM embeddings e, {Q0}")
def v10(spark, d):
    near = vx.cosine(F.col("embedding"), vx.literal(_first(spark, d)))
    return _vectors(spark, d).select("key", F.round((2 - (1 - near)) / 2, 6).alias("score"))


@register("v13_get_by_keys", "SELECT vec_id AS key, label AS namespace FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE source = 'src3')")
def v13(spark, d):
    keys = table(spark, d, "documents").filter("source = 'src3'").select(F.col("doc_id").alias("key"))
    return _vectors(spark, d).join(keys, "key", "left_semi").drop("embedding")


@register("v14_namespace_counts", "SELECT label AS namespace, count(*) AS n FROM embeddings GROUP BY label")
def v14(spark, d):
    return _vectors(spark, d).groupBy("namespace").agg(F.count("*").alias("n"))


@register("v15_delete", "SELECT vec_id AS key FROM embeddings WHERE label IS DISTINCT FROM 2 AND vec_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src3')")
def v15(spark, d):
    gone = table(spark, d, "documents").filter("source = 'src3'").select(F.col("doc_id").alias("key"))
    return _vectors(spark, d).filter(~F.col("namespace").eqNullSafe(2)).join(gone, "key", "left_anti").select("key")


@register("v16_rerank", f"""
WITH c AS (SELECT e.vec_id AS key, {COS} AS cos FROM embeddings e, {Q0} ORDER BY {COS} DESC, e.vec_id LIMIT 30)
SELECT key, round(share, 6) AS score FROM (SELECT key, cos, (contains(lower(text), 'the')::INT + contains(lower(text), 'und')::INT) / 2 AS share FROM c JOIN documents ON doc_id = key)
ORDER BY share DESC, cos DESC, key LIMIT 10""")
def v16(spark, d):
    found = rt.top_k(_vectors(spark, d), _first(spark, d), k=30).join(_docs(spark, d), F.col("key") == F.col("id"))
    share = rt.keyword_share(F.col("text"), "the und")
    return found.withColumn("share", share).orderBy(F.desc("share"), F.desc("score"), "key").limit(10).select("key", F.round("share", 6).alias("score"))


@register("b5_web_hits", """
SELECT page_id, host, score FROM (
SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
  5 * contains(lower(regexp_extract(html, '<title>(.*?)</title>', 1)), 'the')::INT + contains(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), 'the')::INT
  + 5 * contains(lower(regexp_extract(html, '<title>(.*?)</title>', 1)), 'site')::INT + contains(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), 'site')::INT
  + (url <> '')::INT AS score, url FROM pages) ORDER BY score DESC, url, page_id LIMIT 50""")
def b5(spark, d):
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    title = F.lower(F.regexp_extract("html", "<title>(.*?)</title>", 1))
    points = sum((5 * title.contains(t).cast("int") + F.lower(host).contains(t).cast("int") for t in ("the", "site")), F.lit(0))
    scored = table(spark, d, "pages").select("page_id", host.alias("host"), (points + (F.col("url") != "").cast("int")).alias("score"), "url")
    return scored.orderBy(F.desc("score"), "url", "page_id").limit(50).drop("url")


@register("b6_occurrences", """SELECT doc_id AS id, CAST((length(lower(text)) - length(replace(lower(text), 'tion', ''))) // 4 AS BIGINT) AS hits FROM documents""")
def b6(spark, d):
    return _docs(spark, d).select("id", tx.occurrences(F.lower("text"), "tion").alias("hits"))


@register("b7_snippet", """
SELECT id, CASE WHEN s > 1 THEN '...' ELSE '' END || substring(text, s, 220) || CASE WHEN s + 219 < length(text) THEN '...' ELSE '' END AS snippet FROM (
  SELECT doc_id AS id, text, greatest(1, instr(lower(text), 'tion') - 73) AS s FROM documents WHERE instr(lower(text), 'tion') > 0)""")
def b7(spark, d):
    at = F.greatest(F.lit(1), F.instr(F.lower("text"), "tion") - 73)
    found = _docs(spark, d).filter(F.instr(F.lower("text"), "tion") > 0).withColumn("s", at)
    cut = F.concat(F.when(F.col("s") > 1, "...").otherwise(""), F.substring("text", F.col("s"), F.lit(220)), F.when(F.col("s") + 219 < F.length("text"), "...").otherwise(""))
    return found.select("id", cut.alias("snippet"))


@register("b9_keywords", r"""SELECT doc_id AS id, len(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n,.]+'), lambda t: octet_length(encode(t)) > 3))::INT AS n FROM documents""")
def b9(spark, d):
    return _docs(spark, d).select("id", F.size(tx.keywords(F.col("text"))).alias("n"))


@register("b10_inverted_index", r"""
SELECT term, count(*) AS n_docs, min(id) AS first_id FROM (SELECT DISTINCT doc_id AS id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n,.]+'), lambda t: octet_length(encode(t)) > 3)) AS term FROM documents) GROUP BY term""")
def b10(spark, d):
    posts = _docs(spark, d).select("id", F.explode(F.array_distinct(tx.keywords(F.col("text")))).alias("term"))
    return posts.groupBy("term").agg(F.count("*").alias("n_docs"), F.min("id").alias("first_id"))


PARTS = r"list_filter(list_transform(string_split(replace(replace(text, chr(10), chr(10) || chr(10)), chr(13) || chr(10), chr(10)), chr(10) || chr(10)), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '')"


def _paragraphs(spark, d):
    docs = _docs(spark, d).select("id", "text")
    return rt.paragraphs(docs, F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")))


@register("c1_paragraphs", f"SELECT id, (i - 1)::INT AS position, p[i] AS chunk FROM (SELECT doc_id AS id, {PARTS} AS p FROM documents), unnest(range(1, len(p) + 1)) t(i)")
def c1(spark, d):
    return _paragraphs(spark, d).select("id", "position", "chunk")


@register("c1_capped_paragraphs")
def c1_capped(spark, d):
    docs = _docs(spark, d).select("id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return rt.capped_paragraphs(docs)


# the ends of sentences marked by a sign that no text has, in the order in which they are looked for
SENTENCES = r"""m AS (SELECT doc_id AS id, regexp_replace(regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), '([.!?]) ', '\1' || chr(1), 'g'), '([.!?])\n', '\1' || chr(1) || chr(10), 'g'), '\n\n', chr(1), 'g') AS t FROM documents),
k AS (SELECT id, list_filter(list_transform(string_split(t, chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: octet_length(encode(regexp_replace(s, '[\pP\s]', '', 'g'))) >= 3) AS ss FROM m),
s AS (SELECT id, generate_subscripts(ss, 1) - 1 AS position, unnest(ss) AS sentence FROM k)"""


@register("c2_sentences", f"WITH {SENTENCES} SELECT id, position::INT AS position, sentence FROM s")
def c2(spark, d):
    return rt.sentences(_docs(spark, d))


def _by_lengths(rows):
    """Embeddings that SQL can follow: how many words of each length, modulo eight."""
    codes = F.transform(F.filter(F.split("sentence", r"\s+"), lambda w: w != ""), lambda w: F.length(w) % 8)
    counts = tx.bound(codes, lambda c: F.array(*[(F.size(c) - F.size(F.array_remove(c, i))).cast("float") for i in range(8)]))
    return rows.withColumn("embedding", counts)


@register("c3_grouped", f"""WITH RECURSIVE {SENTENCES},
w AS (SELECT id, position, sentence, octet_length(encode(sentence)) AS n, list_filter(regexp_split_to_array(sentence, '\\s+'), lambda x: x <> '') AS ws FROM s),
e AS (SELECT id, position, sentence, n, [{", ".join(f"len(list_filter(ws, lambda x: length(x) % 8 = {i}))::DOUBLE" for i in range(8))}] AS v FROM w),
g AS (SELECT id, position, n, CASE WHEN list_inner_product(v, v) = 0 OR p IS NULL OR list_inner_product(p, p) = 0 THEN 0 ELSE list_cosine_similarity(v, p) END AS near
      FROM (SELECT *, lag(v) OVER (PARTITION BY id ORDER BY position) AS p FROM e)),
f AS (SELECT id, position, n AS size, 0 AS nth FROM g WHERE position = 0
      UNION ALL SELECT g.id, g.position, CASE WHEN g.near < 0.6 AND f.size >= 60 OR f.size + g.n > 300 THEN g.n ELSE f.size + g.n + 1 END, f.nth + CASE WHEN g.near < 0.6 AND f.size >= 60 OR f.size + g.n > 300 THEN 1 ELSE 0 END
      FROM f JOIN g ON g.id = f.id AND g.position = f.position + 1),
c AS (SELECT f.id, nth, string_agg(sentence, ' ' ORDER BY f.position) AS chunk FROM f JOIN e ON e.id = f.id AND e.position = f.position GROUP BY f.id, nth),
t AS (SELECT id, count(*) AS total, (SELECT count(*) FROM s WHERE s.id = c.id) AS said FROM c GROUP BY id),
o AS (SELECT c.id, nth, total, list_filter(regexp_split_to_array(chunk, '\\s+'), lambda x: x <> '') AS ws FROM c JOIN t ON t.id = c.id WHERE octet_length(encode(chunk)) > 300 AND said > 1),
r AS (SELECT id, nth, total, ws, 1 AS i, octet_length(encode(ws[1])) AS size, 0 AS piece FROM o
      UNION ALL SELECT id, nth, total, ws, i + 1, CASE WHEN size + octet_length(encode(ws[i + 1])) + 1 > 300 THEN 0 ELSE size + 1 END + octet_length(encode(ws[i + 1])), piece + CASE WHEN size + octet_length(encode(ws[i + 1])) + 1 > 300 THEN 1 ELSE 0 END
      FROM r WHERE i < len(ws)),
z AS (SELECT id, nth, total, piece, string_agg(ws[i], ' ' ORDER BY i) AS chunk FROM r GROUP BY id, nth, total, piece)
SELECT c.id, nth::INT AS position, md5(chunk) AS digest FROM c JOIN t ON t.id = c.id WHERE octet_length(encode(chunk)) <= 300 OR said = 1
UNION ALL SELECT id, (total + row_number() OVER (PARTITION BY id ORDER BY nth, piece) - 1)::INT, md5(chunk) FROM z""")
def c3_grouped(spark, d):
    """Chunks by meaning; oversized ones in pieces."""
    return ch.semantic_chunks(_docs(spark, d).select("id", "text"), _by_lengths, 60, 300, 0.6).select("id", "position", F.md5("chunk").alias("digest"))


@register("c3_semantic_chunks")
def c3(spark, d):
    s = rt.sentences(_docs(spark, d))
    # a hashing embedder of eight buckets stands in for a model
    codes = F.transform(F.split(F.lower("sentence"), " "), lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(8)))
    e = tx.bound(codes, lambda c: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.size(F.filter(c, lambda x: x == i)).cast("float")))
    return rt.semantic_chunks(s.withColumn("embedding", e))


@register("c6_chunk_bytes", f"SELECT doc_id AS id, (list_sum(list_transform({PARTS}, lambda p: octet_length(encode(p)))) + len({PARTS}) - 1)::BIGINT AS bytes FROM documents WHERE len({PARTS}) > 0")
def c6(spark, d):
    return _paragraphs(spark, d).groupBy("id").agg((F.sum(F.octet_length("chunk")) + F.count("*") - 1).cast("long").alias("bytes"))


@register("c7_ingest_keys", f"""SELECT 'rag/' || source || '/' || doc_id || '#chunk-' || (i - 1) AS key, source AS corpus, (i - 1)::INT AS position, octet_length(encode(p[i]))::INT AS bytes
FROM (SELECT doc_id, source, {PARTS} AS p FROM documents), unnest(range(1, len(p) + 1)) t(i)""")
def c7(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    chunks = rt.paragraphs(docs, F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")))
    key = F.concat(F.lit("rag/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("#chunk-"), F.col("position").cast("string"))
    return chunks.select(key.alias("key"), F.col("source").alias("corpus"), "position", F.octet_length("chunk").alias("bytes"))


@register("c8_stale_chunks", f"""WITH n AS (SELECT doc_id AS id, len({PARTS}) AS n FROM documents)
SELECT id, i::INT AS position FROM n, unnest(range(0, n)) t(i) WHERE i < n // 2""")
def c8(spark, d):
    """A second ingest keeps the first half of the chunks; the keys from there on are gone."""
    old = _paragraphs(spark, d).select("id", "position")
    counts = old.groupBy("id").agg(F.count("*").alias("n"))
    gone = counts.select("id", F.explode(F.sequence(F.floor(F.col("n") / 2).cast("int"), F.col("n").cast("int"))).alias("position"))
    return old.join(gone, ["id", "position"], "left_anti")


@register("j1_upsert", "SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'changed' ELSE source END AS source, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS version FROM documents")
def j1(spark, d):
    old = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", F.lit(1).alias("version"))
    new = old.filter("id % 3 = 0").select("id", F.lit("changed").alias("source"), F.lit(2).alias("version"))
    return rt.upsert(old, new, ["id"])


@register("h10_first_url", """SELECT page_id, url FROM (SELECT page_id, regexp_replace(url, '\\?.*$', '') AS url, row_number() OVER (PARTITION BY regexp_replace(url, '\\?.*$', '') ORDER BY page_id) AS n FROM pages) WHERE n = 1""".replace("\\\\", "\\"))
def h10(spark, d):
    url = F.regexp_replace("url", r"\?.*$", "")
    first = Window.partitionBy("url").orderBy("page_id")
    return table(spark, d, "pages").select("page_id", url.alias("url")).withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")
