"""Mixing sources to target weights by hierarchical budgeting.

The tree is domain, language, source. A budget of tokens flows from the root by the nodes' weights.
A node cannot hold more than ``max_epochs`` times its tokens; what it lacks goes to its siblings in
proportion to their weights, and only what all siblings cannot hold goes to the level above. Each leaf
then reads seeded epochs (one permutation of its documents after another) and keeps the token-prefix
that its budget pays for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import set_aside, settle

#: Production parameters. Sources fall into domains by their number modulo 3; weights are relative integers.
DOMAINS = {"web": 5, "books": 3, "forums": 2}
LANGUAGES = {"en": 4, "de": 2, "fr": 2, "es": 2}
OTHER_WEIGHT = 1
SEED = "mix-1"
MAX_EPOCHS = 2
#: The budget: this share of all tokens, in thousandths.
BUDGET_PER_MILLE = 600
WORD = r"[^\x20\x09-\x0D]+"


def domain_of(source: Column) -> Column:
    """Domain of a source such as src7, by its number modulo 3; sources without a number are web."""
    n = F.coalesce(F.regexp_extract(source, r"([0-9]{1,9})$", 1).try_cast("int"), F.lit(0)) % 3
    return F.when(n == 0, "web").when(n == 1, "books").otherwise("forums")


def weight_of(name: Column, weights: dict[str, int], other: int) -> Column:
    return reduce(lambda c, kv: c.when(name == kv[0], kv[1]), weights.items(), F.when(F.lit(False), 0)).otherwise(other).cast("long")


def fill(nodes: DataFrame, parent: list[str], order: str) -> DataFrame:
    """Share each parent's ``grant`` among its children (cap, weight): a child gets its weight's share
    or all it can hold. Children sorted by cap / weight are full up to the first that its share does
    not fill; the rest share what is left. One row per child in and out, with ``budget``."""
    by = Window.partitionBy(*parent)
    ranked = by.orderBy(F.col("cap") / F.col("weight"), order)
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("grant") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(ranked.rowsBetween(0, Window.unboundedFollowing))
    n = nodes.withColumn("_level", level)
    n = n.withColumn("_full", F.col("cap") <= F.col("weight") * F.col("_level"))
    n = n.withColumn("_open", F.max(F.when(~F.col("_full"), F.col("_level"))).over(by))
    # the open level is the first one: the later ones subtract more than a full share
    return n.withColumn("budget", F.when(F.col("_full"), F.col("cap")).otherwise(F.floor(F.col("weight") * F.col("_open")))).drop("_level", "_full", "_open")


def leaf_budgets(leaves: DataFrame, budget: int | None, max_epochs: int) -> DataFrame:
    """leaves(domain, lang, source, tokens, domain_weight, lang_weight, source_weight) with budget long.

    The number of leaves is the number of distinct (language, source) pairs, not of rows.
    """
    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    domains = leaves.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"), F.max("domain_weight").alias("weight"))
    total = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    grant = F.lit(budget) if budget is not None else F.floor(total * BUDGET_PER_MILLE / 1000)
    top = fill(domains.withColumn("grant", F.least(grant, F.sum("cap").over(Window.partitionBy(F.lit(1))))).withColumn("_root", F.lit(1)), ["_root"], "domain")
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"), F.max("lang_weight").alias("weight"))
    mid = fill(langs.join(top.select("domain", F.col("budget").alias("grant")), "domain"), ["domain"], "lang")
    low = leaves.withColumn("weight", F.col("source_weight")).join(mid.select("domain", "lang", F.col("budget").alias("grant")), ["domain", "lang"])
    return fill(low, ["domain", "lang"], "source").select("domain", "lang", "source", "tokens", F.col("budget").cast("long").alias("budget"))


def mix(docs: DataFrame, budget: int | None = None, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """Selected documents with domain, tokens, leaf_budget and copies (epochs that read the document).

    Null languages and sources are the leaves ``und`` and ``none``; null and wordless texts have no
    tokens, cost nothing and come along in every epoch that reaches them. Repeated rows are separate
    documents; two rows with the same id are taken in the order of their texts' hashes. A leaf
    without tokens gets no budget and nothing is taken from it. No rows in, no rows out. Columns of the
    input named as the four are replaced, others come along whatever their names.
    """
    docs, back = set_aside(docs.drop("domain", "tokens", "leaf_budget", "copies"), "doc_id", "text", "lang", "source")
    names = docs.columns
    lang, source = F.coalesce("lang", F.lit("und")), F.coalesce("source", F.lit("none"))
    base = docs.select(*names).withColumns({
        "tokens": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"),
        "_lang": lang, "_source": source, "domain": domain_of(source), "_tie": F.xxhash64("text"),
    })
    leaves = base.groupBy("domain", F.col("_lang").alias("lang"), F.col("_source").alias("source")).agg(F.sum("tokens").alias("tokens"))
    leaves = leaves.withColumns({
        "domain_weight": weight_of(F.col("domain"), DOMAINS, OTHER_WEIGHT),
        "lang_weight": weight_of(F.col("lang"), LANGUAGES, OTHER_WEIGHT),
        "source_weight": F.lit(1).cast("long"),
    })
    paid = leaf_budgets(leaves.filter("tokens > 0"), budget, max_epochs).select(
        F.col("domain").alias("_d"), F.col("lang").alias("_l"), F.col("source").alias("_s"), F.col("budget").alias("leaf_budget"),
        F.floor(F.col("budget") / F.col("tokens")).cast("long").alias("_epochs"), (F.col("budget") % F.col("tokens")).alias("_rest"),
    )
    # One row for each leaf. Spark broadcasts it below its own threshold; where there are more leaves, it
    # shuffles both sides and splits hot leaves.
    paid = settle(paid)
    read = base.join(paid, (F.col("domain") == F.col("_d")) & (F.col("_lang") == F.col("_l")) & (F.col("_source") == F.col("_s")))
    # The order of the epoch that is read in part. Its first three digits deal a leaf, hot or not, into 4096 cells.
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("_epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    read = read.withColumns({"_key": key, "_cell": F.substring(key, 1, 3)})
    slim = read.select("_d", "_l", "_s", "_cell", "tokens")
    cells = slim.groupBy("_d", "_l", "_s", "_cell").agg(F.sum("tokens").alias("_sum"))
    start = F.sum("_sum").over(Window.partitionBy("_d", "_l", "_s").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select(F.col("_d").alias("_cd"), F.col("_l").alias("_cl"), F.col("_s").alias("_cs"), F.col("_cell").alias("_cc"), F.coalesce(start, F.lit(0)).alias("_start"))
    inside = F.sum("tokens").over(Window.partitionBy("_d", "_l", "_s", "_cell").orderBy("_key", "_tie").rowsBetween(Window.unboundedPreceding, 0))
    ranked = read.withColumn("_inside", inside)
    ranked = ranked.join(cells, (F.col("_d") == F.col("_cd")) & (F.col("_l") == F.col("_cl")) & (F.col("_s") == F.col("_cs")) & (F.col("_cell") == F.col("_cc")))
    copies = F.col("_epochs") + (F.col("_start") + F.col("_inside") <= F.col("_rest")).cast("long")
    return back(ranked.withColumn("copies", copies).filter("copies > 0").select(*names, "domain", "tokens", "leaf_budget", "copies"))


def op8_hierarchical_mix(spark, sf_dir: str) -> DataFrame:
    """The mixture of all documents: one row per selected document with its leaf and its copies."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return mix(docs).select("doc_id", "domain", "lang", "source", "tokens", "leaf_budget", "copies")


OP8_SQL = r"""
WITH base AS (
  SELECT doc_id, lang, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens,
         coalesce(lang, 'und') AS l, coalesce(source, 'none') AS s,
         CASE coalesce(try_cast(regexp_extract(coalesce(source, 'none'), '([0-9]{1,9})$', 1) AS INT), 0) % 3
              WHEN 0 THEN 'web' WHEN 1 THEN 'books' ELSE 'forums' END AS domain
  FROM documents),
leaves AS (
  SELECT domain, l, s, sum(tokens)::BIGINT AS tokens, 2 * sum(tokens)::BIGINT AS cap,
         CASE domain WHEN 'web' THEN 5 WHEN 'books' THEN 3 ELSE 2 END AS dw,
         CASE l WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END AS lw
  FROM base GROUP BY ALL HAVING sum(tokens) > 0),
root AS (SELECT least(floor(sum(tokens) * 600 / 1000), sum(cap)) AS grant_ FROM leaves),
d0 AS (SELECT domain, sum(cap) AS cap, max(dw) AS w FROM leaves GROUP BY domain),
d1 AS (SELECT domain, cap, w, (grant_ - coalesce(sum(cap) OVER (ORDER BY cap / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM d0, root),
d2 AS (SELECT domain, CASE WHEN cap <= w * lev THEN cap ELSE floor(w * max(CASE WHEN cap > w * lev THEN lev END) OVER ()) END AS b FROM d1),
l0 AS (SELECT domain, l, sum(cap) AS cap, max(lw) AS w FROM leaves GROUP BY ALL),
l1 AS (SELECT domain, l, cap, w, (b - coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap / w, l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (PARTITION BY domain ORDER BY cap / w, l ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM l0 JOIN d2 USING (domain)),
l2 AS (SELECT domain, l, CASE WHEN cap <= w * lev THEN cap ELSE floor(w * max(CASE WHEN cap > w * lev THEN lev END) OVER (PARTITION BY domain)) END AS b FROM l1),
s1 AS (SELECT domain, l, s, tokens, cap, (b - coalesce(sum(cap) OVER (PARTITION BY domain, l ORDER BY cap, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(1) OVER (PARTITION BY domain, l ORDER BY cap, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM leaves JOIN l2 USING (domain, l)),
s2 AS (SELECT domain, l, s, tokens AS all_tokens, CAST(CASE WHEN cap <= lev THEN cap ELSE floor(max(CASE WHEN cap > lev THEN lev END) OVER (PARTITION BY domain, l)) END AS BIGINT) AS leaf_budget FROM s1),
r AS (
  SELECT base.*, leaf_budget, leaf_budget // all_tokens AS epochs, leaf_budget % all_tokens AS rest,
         md5('mix-1:' || (leaf_budget // all_tokens)::VARCHAR || ':' || coalesce(doc_id::VARCHAR, 'null')) AS k
  FROM base JOIN s2 USING (domain, l, s)),
c AS (
  SELECT doc_id, domain, lang, source, tokens, leaf_budget,
         epochs + CASE WHEN sum(tokens) OVER (PARTITION BY domain, l, s ORDER BY k ROWS UNBOUNDED PRECEDING) <= rest THEN 1 ELSE 0 END AS copies
  FROM r)
SELECT * FROM c WHERE copies > 0
"""
