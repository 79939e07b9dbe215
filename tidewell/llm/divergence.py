"""Source divergence audit: which terms set a source apart from its language and from its siblings.

Plain relational steps over grouped counts:

1. every text is cut into terms, which are exploded in sorted order, so that a term's first row in its
   document tells itself from the repeats; one aggregation then gives occurrences and documents of each
   (lang, source, term), combined before the shuffle;
2. a language keeps the terms of enough of its documents; groups meet the kept terms of their language,
   in salted cells, and union with the counts makes their zeros explicit;
3. rates are whole numbers of a billionth; a self-join on (lang, term) sums the divergence of each pair of
   sources, a join with the language's own rates the terms of each source, and windows rank both.

Rates come from long division in three steps of a thousand: exact to 9e15 occurrences and terms.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import settle, shuffle_partitions

#: Terms are runs of Latin letters and of anything beyond ASCII, so they are what these signs part.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_DOCUMENTS = 3
MOST_TERMS = 200
#: Rows that a task of the pair join is meant to read.
TASK_ROWS = 4_000_000


class Audit(NamedTuple):
    """pairs: lang, source, other, value, rank. terms: lang, source, term, n, p, q, value, rank."""

    pairs: DataFrame
    terms: DataFrame


def _words(text: Column) -> Column:
    """The terms of a text, with an empty string where it starts or ends between terms. Splitting is
    linear in the text, where extracting all matches copies the text for each."""
    return F.split(F.translate(text, UPPER, LOWER), BETWEEN, -1)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents of each term of each group.

    Null texts, languages and sources read as ''. A group with no term at all in some text has a row with
    the term '' and no documents, which stands for the group. Repeated rows are documents of their own;
    columns other than the three are not read.
    """
    text, lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "lang", "source"))
    words = docs.select(lang.alias("lang"), source.alias("source"), F.sort_array(_words(text)).alias("w"))
    # each term beside the one before it; the first has an empty one, which no term is
    before = F.concat(F.array(F.lit("")), F.col("w"))
    rows = words.select("lang", "source", F.explode(F.arrays_zip(F.col("w").alias("term"), F.slice(before, 1, F.size("w")).alias("last"))).alias("x"))
    rows = rows.select("lang", "source", F.col("x.term").alias("term"), (F.col("x.term") != F.col("x.last")).cast("long").alias("first"))
    return rows.groupBy("lang", "source", "term").agg(F.count("*").alias("n"), F.sum("first").alias("docs"))


def _rate(count: str, total: str) -> str:
    """SQL of 1 + floor(1e9 * (count + 1) / total), a thousandth at a time so that no product overflows."""
    one = f"(({count} + 1) * 1000)"
    two = f"(({one} % {total}) * 1000)"
    three = f"(({two} % {total}) * 1000)"
    return f"1 + ({one} div {total}) * 1000000 + ({two} div {total}) * 1000 + ({three} div {total})"


GAP = "((p - q) * (p - q)) div q"


def audit(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, most_terms: int = MOST_TERMS) -> Audit:
    """Pairs of sources of a language by divergence, and each source's own terms.

    Every occurring (lang, source) takes part, even without terms; a language without kept terms gives
    its pairs the value 0 and no terms. Ties are ranked by the item's UTF-8 bytes. No documents, no rows.
    """
    spark = docs.sparkSession
    counts = settle(term_counts(docs))
    groups = settle(counts.select("lang", "source").distinct())
    vocab = counts.filter("term != ''").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("d")).filter(F.col("d") >= least_documents).drop("d")
    vocab = settle(vocab)
    kept = settle(counts.join(vocab, ["lang", "term"]))
    langs = vocab.groupBy("lang").agg((F.sum("lang_n") + F.count("*")).alias("lang_total"), F.count("*").alias("v"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    # one row a group: N + V of the group and of its language
    totals = settle(groups.join(langs, "lang").join(sums, ["lang", "source"], "left").selectExpr("lang", "source", "coalesce(group_n, 0) + v as total", "lang_total", "v"))

    # the densified table is sized by the groups' vocabularies, known before it is made
    dense_rows = totals.agg(F.coalesce(F.sum("v"), F.lit(0))).first()[0]
    cells = max(shuffle_partitions(spark), -(-dense_rows // TASK_ROWS))
    salted_groups = totals.select("lang", "source", "total", "lang_total", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"))
    salted_vocab = vocab.select("lang", "term", "lang_n", F.pmod(F.xxhash64("term"), F.lit(cells)).cast("int").alias("cell"))
    zeros = salted_vocab.join(salted_groups, ["lang", "cell"]).selectExpr("lang", "term", "source", "cast(0 as long) as n", "total", "lang_n", "lang_total")
    known = kept.selectExpr("lang", "term", "source", "n", "cast(null as long) as total", "cast(null as long) as lang_n", "cast(null as long) as lang_total")
    dense = zeros.union(known).repartition(cells, "lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), *(F.max(c).alias(c) for c in ("total", "lang_n", "lang_total")))
    rates = settle(dense.selectExpr("lang", "term", "source", "n", f"{_rate('n', 'total')} as p", f"{_rate('lang_n', 'lang_total')} as q"))

    dealt = rates.select("lang", "term", "source", "p").repartition(cells, "lang", "term")
    other = dealt.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("q"))
    back = GAP.replace("p", "x").replace("q", "p").replace("x", "q")
    # a pair is met once and summed both ways
    met = dealt.join(other, ["lang", "term"]).filter("source < other").groupBy("lang", "source", "other").agg(F.expr(f"sum({GAP})").alias("forth"), F.expr(f"sum({back})").alias("back"))
    ways = F.array(F.struct("source", "other", F.col("forth").alias("value")), F.struct(F.col("other").alias("source"), F.col("source").alias("other"), F.col("back").alias("value")))
    gaps = met.select("lang", F.explode(ways).alias("x")).select("lang", "x.*")
    siblings = groups.join(groups.select("lang", F.col("source").alias("other")), "lang").filter("source != other")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "other")
    pairs = siblings.join(gaps, ["lang", "source", "other"], "left").withColumn("value", F.coalesce("value", F.lit(0).cast("long"))).withColumn("rank", F.row_number().over(by_value))

    own = rates.filter("n > 0 and p > q").withColumn("value", F.expr(GAP))
    by_gap = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    # a rank with a limit: Spark keeps each task's best before the shuffle
    terms = own.withColumn("rank", F.row_number().over(by_gap)).filter(F.col("rank") <= most_terms)
    return Audit(pairs, terms)


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    """All documents: every pair of sources of a language, and the 200 terms that mark each source."""
    found = audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))
    pairs = found.pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value", "rank")
    return pairs.union(found.terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
vocab AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
langs AS (SELECT lang, sum(n)::HUGEINT + count(*) AS total FROM vocab GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t GROUP BY ALL),
dense AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0)::HUGEINT AS n, v.n AS lang_n
          FROM g JOIN vocab v ON g.lang = v.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
totals AS (SELECT lang, source, sum(n)::HUGEINT + count(*) AS total FROM dense GROUP BY ALL),
rates AS (SELECT dense.lang, dense.source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // totals.total AS p, 1 + (1000000000::HUGEINT * (lang_n + 1)) // langs.total AS q
          FROM dense JOIN totals ON dense.lang = totals.lang AND dense.source = totals.source JOIN langs ON dense.lang = langs.lang),
gaps AS (SELECT a.lang, a.source, b.source AS other, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
         FROM rates a JOIN rates b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(gaps.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN gaps ON gaps.lang = a.lang AND gaps.source = a.source AND gaps.other = b.source),
own AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM rates WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM own))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
