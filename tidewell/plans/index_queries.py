"""Queries on stored indexes of vectors and of words, with their SQL counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewell.operators import lexical_index as li
from tidewell.operators import retrieval as rt
from tidewell.operators import vector_index as vi
from tidewell.plans.catalog import register
from tidewell.plans.retrieval_queries import BM25, QUERY, _first, _vectors
from tidewell.session import shared_dir, table

EF = 200
COS = "list_cosine_similarity({}::DOUBLE[], {}::DOUBLE[])"

# every 25th vector is a centre, so SQL can follow the lists
LISTS = f"""
c AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS list, embedding AS centre FROM {{table}} WHERE vec_id % 25 = 0),
l AS (SELECT key, namespace, embedding, list FROM (
  SELECT e.vec_id AS key, e.label AS namespace, e.embedding, list, row_number() OVER (PARTITION BY e.vec_id ORDER BY {COS.format("e.embedding", "centre")} DESC, list) AS nth
  FROM {{table}} e, c) WHERE nth = 1),
sizes AS (SELECT list, count(*) AS n FROM l GROUP BY list)"""
SEARCH = f"""
p AS (SELECT q.vec_id AS qid, q.embedding AS q, c.list, n, {COS.format("q.embedding", "centre")} AS near FROM embeddings q, c JOIN sizes USING (list) WHERE q.vec_id % 100 = 0),
taken AS (SELECT qid, q, list FROM (SELECT *, sum(n) OVER (PARTITION BY qid ORDER BY near DESC, list) - n AS before FROM p) WHERE before < {EF}),
s AS (SELECT qid, key, namespace, {COS.format("embedding", "q")} AS score FROM taken JOIN l USING (list)),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS rank FROM s)"""


def _place(spark) -> str:
    return f"{shared_dir(spark)}/indexes/{uuid.uuid4().hex}"


def _listed(spark, d) -> str:
    path, vectors = _place(spark), _vectors(spark, d)
    vi.build(vectors, path, rounds=0, seeds=vectors.filter("key % 25 = 0"))
    return path


def _asked(spark, d):
    return _vectors(spark, d).filter("key % 100 = 0").select(F.col("key").alias("qid"), F.col("embedding").alias("q"))


@register("v5_list_search", f"WITH {LISTS.format(table='embeddings')}, {SEARCH} SELECT qid, key, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 10 AND namespace IN (1, 2, 3)")
def v5_lists(spark, d):
    """A stored index searched for every 100th vector at once; the filter comes after the ten best."""
    found = vi.search(spark, _listed(spark, d), _asked(spark, d), 10, EF, F.col("namespace").isin(1, 2, 3))
    return found.select("qid", "key", F.round("score", 6).alias("score"), "rank")


CHANGED = "(SELECT vec_id, label, CASE WHEN vec_id % 10 = 3 THEN list_transform(embedding, lambda x: -x) ELSE embedding END AS embedding FROM embeddings WHERE vec_id % 10 <> 7)"


@register("v5_list_search_changed", f"""WITH e0 AS {CHANGED}, {LISTS.format(table='embeddings').replace("FROM embeddings e, c", "FROM e0 e, c")},
{SEARCH} SELECT qid, key, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 10""".replace("sizes AS (SELECT list, count(*) AS n FROM l GROUP BY list)", f"""o AS (SELECT list FROM (
  SELECT list, row_number() OVER (PARTITION BY e.vec_id ORDER BY {COS.format("e.embedding", "centre")} DESC, list) AS nth FROM embeddings e, c WHERE e.vec_id % 10 IN (3, 7)) WHERE nth = 1),
sizes AS (SELECT list, count(*) AS n FROM (SELECT list FROM l UNION ALL SELECT list FROM o) GROUP BY list)"""))
def v5_changed(spark, d):
    """The same after a tenth of the vectors was turned round and another tenth removed. Rows that are gone
    still count as read until the index is built again."""
    path, vectors = _listed(spark, d), _vectors(spark, d)
    vi.upsert(spark, path, vectors.filter("key % 10 = 3").withColumn("embedding", F.transform("embedding", lambda x: -x)))
    vi.remove(spark, path, vectors.filter("key % 10 = 7").select("key"))
    found = vi.search(spark, path, _asked(spark, d), 10, EF)
    return found.select("qid", "key", F.round("score", 6).alias("score"), "rank")


@register("v12_list_sizes", f"WITH {LISTS.format(table='embeddings')} SELECT list::INT AS list, n FROM sizes")
def v12(spark, d):
    """How many rows the index has in each list."""
    from tidewell.sources import tables

    return tables.read(spark, tables.current(spark, _listed(spark, d)), "sizes", "list int, n long")


def _texts(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


TOP = "SELECT id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, id LIMIT 10"


@register("b1_index_top_k", f"WITH {BM25} {TOP}")
def b1_index(spark, d):
    """The ten best documents from a stored index of words."""
    path = _place(spark)
    li.upsert(_texts(spark, d), path)
    return li.search(spark, path, QUERY, 10).select("id", F.round("score", 6).alias("score"))


# after the changes: every 7th document has the text of the one before it, every 11th is gone
EDITED = "(SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN coalesce((SELECT text FROM documents p WHERE p.doc_id = d.doc_id - 1), '') ELSE text END AS text FROM documents d WHERE doc_id % 11 <> 5)"


@register("b1_index_changed", f"WITH {BM25.replace('FROM documents', f'FROM {EDITED}')} {TOP}")
def b1_changed(spark, d):
    """The ten best after an upsert and a delete: documents, lengths and postings have moved with them."""
    path, docs = _place(spark), _texts(spark, d)
    li.upsert(docs, path)
    before = docs.select((F.col("id") + 1).alias("id"), F.col("text").alias("new"))
    li.upsert(docs.filter("id % 7 = 3").select("id").join(before, "id", "left").select("id", F.coalesce("new", F.lit("")).alias("text")), path)
    li.delete(docs.filter("id % 11 = 5").select("id"), path)
    return li.search(spark, path, QUERY, 10).select("id", F.round("score", 6).alias("score"))


@register("v6_hybrid_indexed", f"""
WITH {BM25}, s AS (SELECT e.vec_id AS key, {COS.format("e.embedding", "q.embedding")} AS cos, coalesce(bm.score / (SELECT max(score) FROM bm), 0) AS lex
  FROM embeddings e LEFT JOIN bm ON bm.id = e.vec_id, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)
SELECT key, round(0.3 * cos + 0.7 * lex, 6) AS score FROM s ORDER BY 0.3 * cos + 0.7 * lex DESC, key LIMIT 10""")
def v6_indexed(spark, d):
    """Vectors blended with scores that come from the stored index."""
    path = _place(spark)
    li.upsert(_texts(spark, d), path)
    return rt.hybrid(_vectors(spark, d), li.scores(spark, path, QUERY), _first(spark, d), 0.7, 10).select("key", F.round("score", 6).alias("score"))
