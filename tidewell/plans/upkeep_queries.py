"""Queries on upkeep, over the supplied tables, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import rules as ru
from tidewell.operators import upkeep as up
from tidewell.plans.catalog import register
from tidewell.session import table

END = "TIMESTAMP '2024-01-20 00:00:00'"


@register("e7_collection", f"""WITH i AS (SELECT event_type AS namespace, event_type IN ('view', 'click') AND coalesce(CASE WHEN event_id % 5 <> 0 THEN ts + to_days((event_id % 9)::INT) END <= {END}, false) AS gone FROM events)
SELECT namespace, count(*) AS scanned, count(*) FILTER (NOT gone) AS kept, count(*) FILTER (gone) AS deleted, (SELECT count(*) FROM i l WHERE l.namespace = i.namespace AND NOT gone) AS left_over FROM i GROUP BY namespace""")
def e7(spark, d):
    """A collection in two of the namespaces: its report, and what is left of each."""
    e = table(spark, d, "events")
    ends = F.when(F.col("event_id") % 5 != 0, F.col("ts") + F.make_dt_interval((F.col("event_id") % 9).cast("int")))
    items = e.select(F.col("event_id").alias("key"), F.col("event_type").alias("namespace"), ends.alias("expires"))
    left, report = up.collected(items, F.lit("2024-01-20").cast("timestamp"), ["view", "click"])
    return report.join(left.groupBy("namespace").agg(F.count("*").alias("left_over")), "namespace", "left").withColumn("left_over", F.coalesce("left_over", F.lit(0)))


@register("e12_compaction_plan", """WITH w AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS w, CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 8000 ELSE 64000 END AS o FROM orders),
r AS (SELECT *, CASE WHEN o > 0 AND o < 20000 THEN o ELSE 20000 END AS reserved FROM w), f AS (SELECT *, greatest(w - reserved, reserved + 13000)::BIGINT AS effective FROM r)
SELECT o_orderkey, effective, least(floor(effective * 0.85::DOUBLE), effective - 13000)::BIGINT AS threshold, effective - 3000 AS blocking, floor(effective * 0.5::DOUBLE)::BIGINT AS target FROM f""")
def e12(spark, d):
    """Limits of compaction for windows of the orders' sizes."""
    k = F.col("o_orderkey") % 3
    plan = up.compaction_plan(F.floor("o_totalprice"), F.when(k == 0, 0).when(k == 1, 8000).otherwise(64_000))
    return table(spark, d, "orders").select("o_orderkey", plan.alias("p")).select("o_orderkey", "p.*")


@register("e12_compaction_stops", """WITH e AS (SELECT user_id, event_id, event_type IN ('error', 'view') AS failed, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
s AS (SELECT a.user_id, min(a.n) AS stop FROM e a JOIN e b ON b.user_id = a.user_id AND b.n = a.n - 1 JOIN e c ON c.user_id = a.user_id AND c.n = a.n - 2 WHERE a.failed AND b.failed AND c.failed GROUP BY a.user_id)
SELECT event_id, coalesce(n <= stop, true) AS allowed FROM e LEFT JOIN s ON s.user_id = e.user_id""")
def e12_stops(spark, d):
    """Which compactions are still tried: none after three failures in a row."""
    tries = table(spark, d, "events").select("user_id", "event_id", F.col("event_type").isin("error", "view").alias("failed"))
    return up.compaction_allowed(tries, "user_id", "failed", ["event_id"]).select("event_id", "allowed")


@register("e11_event_waits", """WITH e AS (SELECT event_id, 1 + event_id % 10 AS a, (user_id % 1000) / 1000.0::DOUBLE AS c FROM events),
g AS (SELECT *, least(30000.0::DOUBLE, 500 * pow(2, a - 1))::BIGINT AS d, least(20000.0::DOUBLE, 400 * pow(1.7, a - 1)) AS h FROM e)
SELECT event_id, least(30000, d + trunc(d * 0.25::DOUBLE * c)::BIGINT) AS delay_ms, trunc(greatest(400.0::DOUBLE, h * (0.75::DOUBLE + c * 0.5::DOUBLE)))::BIGINT AS backoff_ms FROM g""")
def e11(spark, d):
    """Both kinds of waits for each event's attempt, with chances from its user."""
    attempt, chance = 1 + F.col("event_id") % 10, F.col("user_id") % 1000 / F.lit(1000.0)
    return table(spark, d, "events").select("event_id", up.retry_delay(attempt, 500, 30_000, chance).alias("delay_ms"), up.http_backoff(attempt, 400, 1.7, 20_000, chance).alias("backoff_ms"))


@register("p14_page_globs", r"""WITH g AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN regexp_replace(url, '[0-9]+', '*') WHEN 1 THEN url WHEN 2 THEN '/' || page_id || '*' WHEN 3 THEN '*.md' ELSE 'C:/{' || page_id || '}' END AS g FROM pages),
h AS (SELECT *, regexp_extract(g, '^([^*?\[{]*)[*?\[{]', 1) AS head, regexp_matches(g, '[*?\[{]') AS special FROM g),
c AS (SELECT *, CASE WHEN special THEN length(regexp_extract(head, '^(.*[/\\])', 1)) ELSE length(regexp_extract(g, '^(.*/)', 1)) END AS cut FROM h), f AS (SELECT *, left(g, greatest(cut - 1, 0)) AS f FROM c)
SELECT page_id, CASE WHEN special THEN CASE WHEN cut = 0 THEN '' WHEN f = '' THEN '/' WHEN f = 'C:' THEN 'C:/' ELSE f END ELSE CASE WHEN f <> '' THEN f WHEN left(g, 1) = '/' THEN '/' ELSE '.' END END AS folder, substr(g, cut + 1) AS rest FROM f""")
def p14(spark, d):
    """Base folders of globs made of the pages' addresses."""
    k, n = F.col("page_id") % 5, F.col("page_id").cast("string")
    glob = F.when(k == 0, F.concat(F.regexp_extract("url", "^([^0-9]*)", 1), F.when(F.col("url").rlike("[0-9]"), "*").otherwise(""), F.regexp_extract("url", "^[^0-9]*[0-9]+(.*)$", 1)))
    glob = glob.when(k == 1, F.col("url")).when(k == 2, F.concat(F.lit("/"), n, F.lit("*"))).when(k == 3, "*.md").otherwise(F.concat(F.lit("C:/{"), n, F.lit("}")))
    return table(spark, d, "pages").select("page_id", up.glob_base(glob).alias("b")).select("page_id", "b.folder", "b.rest")


SAID = """CASE event_id % 8 WHEN 0 THEN 'Model_Not_Found: ' || event_type WHEN 1 THEN 'the Region is ' || event_type || ' and UNAVAILABLE' WHEN 2 THEN 'you exceeded your current quota' WHEN 3 THEN event_type || ' reset by peer'
  WHEN 4 THEN 'geographic restriction' END"""


@register("p16_error_classes", f"""WITH e AS (SELECT event_id, {SAID} AS said, (400 + event_id % 130)::INT AS s, 1 + user_id % 6 AS a FROM events),
k AS (SELECT *, CASE WHEN said IS NULL THEN CASE WHEN s = 429 THEN 'rate_limit' WHEN s IN (503, 504) THEN 'server_overload' WHEN s = 408 THEN 'timeout' WHEN s = 404 THEN 'model_deprecated' WHEN s IN (401, 403) THEN 'auth_error' WHEN s >= 500 THEN 'server_error' ELSE 'client_error' END
  WHEN event_id % 8 = 0 THEN 'model_deprecated' WHEN event_id % 8 IN (1, 4) THEN 'regionally_unavailable' WHEN event_id % 8 = 2 THEN 'quota_exhausted' ELSE 'network' END AS kind FROM e)
SELECT event_id, kind, CASE WHEN a >= 5 OR kind IN ('client_error', 'auth_error') THEN false WHEN kind IN ('rate_limit', 'network', 'server_overload', 'server_error', 'timeout') THEN true ELSE a < 3 END AS again FROM k""")
def p16(spark, d):
    """Classes of failures by error text or status, and whether each is tried again."""
    status, attempt = (400 + F.col("event_id") % 130).cast("int"), 1 + F.col("user_id") % 6
    kind = up.error_class(F.expr(SAID), ru.retry_class(status))
    return table(spark, d, "events").select("event_id", kind.alias("kind"), up.tried_again(kind, attempt).alias("again"))
