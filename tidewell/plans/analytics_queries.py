"""Queries on statistics, metrics, finance and schedules, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions import numeric as nm
from tidewell.operators import metrics as mt
from tidewell.operators import schedules as sc
from tidewell.plans.catalog import register
from tidewell.session import table

NUMBERS = {"mean": 6, "std_dev": 6, "variance": 4}


def _events(spark, d):
    return table(spark, d, "events")


def _failures(spark, d):
    return _events(spark, d).withColumn("failed", F.col("event_type") == "error")


@register("a1_mean", "SELECT l_returnflag, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY l_returnflag")
def a1(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg("l_quantity"), 6).alias("mean"))


@register("a3_modes", """
WITH c AS (SELECT o_orderpriority, year(o_orderdate) AS y, count(*) AS frequency FROM orders GROUP BY ALL),
b AS (SELECT o_orderpriority, max(frequency) AS frequency FROM c GROUP BY ALL)
SELECT o_orderpriority, frequency, array_to_string(list_sort(list(y)), ',') AS modes FROM c JOIN b USING (o_orderpriority, frequency) GROUP BY ALL""")
def a3(spark, d):
    rows = table(spark, d, "orders").select("o_orderpriority", F.year("o_orderdate").alias("y"))
    return nm.modes(rows, ["o_orderpriority"], "y").select("o_orderpriority", "frequency", F.concat_ws(",", F.col("values").cast("array<string>")).alias("modes"))


@register("a5_percentiles", """SELECT l_returnflag, quantile_disc(l_extendedprice, 0.25) AS p25, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.75) AS p75,
quantile_disc(l_extendedprice, 0.9) AS p90, quantile_disc(l_extendedprice, 0.95) AS p95, quantile_disc(l_extendedprice, 0.99) AS p99 FROM lineitem GROUP BY l_returnflag""")
def a5(spark, d):
    return nm.quantiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {f"p{p}": p / 100 for p in (25, 50, 75, 90, 95, 99)})


@register("a6_summary", """SELECT o_orderpriority, count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, quantile_disc(o_totalprice, 0.5) AS median, round(stddev_samp(o_totalprice), 4) AS std_dev,
round(var_samp(o_totalprice), 0) AS variance, round(max(o_totalprice) - min(o_totalprice), 4) AS value_range, min(o_totalprice) AS low, max(o_totalprice) AS high,
quantile_disc(o_totalprice, 0.25) AS p25, quantile_disc(o_totalprice, 0.75) AS p75 FROM orders GROUP BY o_orderpriority""")
def a6(spark, d):
    s = nm.summary(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice")
    return s.withColumns({"mean": F.round("mean", 4), "std_dev": F.round("std_dev", 4), "variance": F.round("variance", 0), "value_range": F.round("value_range", 4)})


BUCKET = "CASE " + " ".join(f"WHEN value <= {b} THEN {i}" for i, b in enumerate(mt.TIMER_BOUNDS)) + f" ELSE {len(mt.TIMER_BOUNDS)} END"


@register("a8_histogram", f"SELECT event_type, {BUCKET} AS bucket, count(*) AS n FROM events GROUP BY ALL")
def a8(spark, d):
    return mt.histogram(_events(spark, d), "event_type", "value")


@register("a9_histogram_percentile", f"""
WITH h AS (SELECT event_type, {BUCKET} AS bucket, count(*) AS n FROM events GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY bucket) AS running, greatest(1, floor(sum(n) OVER (PARTITION BY event_type) * 95 / 100)) AS need FROM h)
SELECT event_type, ([{", ".join(f"{b}.0" for b in mt.TIMER_BOUNDS)}]::DOUBLE[])[least(min(bucket) + 1, {len(mt.TIMER_BOUNDS)})] AS bound FROM r WHERE running >= need GROUP BY event_type""")
def a9(spark, d):
    return mt.histogram_percentile(mt.histogram(_events(spark, d), "event_type", "value"), "event_type", 95)


@register("a11_counter_gauge", "SELECT event_type, round(sum(value), 4) AS total, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY event_type")
def a11(spark, d):
    return _events(spark, d).groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("total"), F.max_by("value", F.struct("ts", "event_id")).alias("last_value"))


@register("a13_tool_stats", """
WITH RECURSIVE e AS (SELECT user_id, event_type <> 'error' AS ok, CAST(trunc(value) AS BIGINT) AS took, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, n, took AS mean_ms FROM e WHERE n = 1 UNION ALL
      SELECT e.user_id, e.n, (f.mean_ms * f.n + e.took) // e.n FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT user_id, count(*) AS attempts, count(*) FILTER (ok) AS successes, count(*) FILTER (NOT ok) AS failures, max(m) AS mean_ms
FROM e JOIN (SELECT user_id, arg_max(mean_ms, n) AS m FROM f GROUP BY user_id) USING (user_id) GROUP BY user_id""")
def a13(spark, d):
    return mt.tool_stats(_events(spark, d).withColumn("ok", F.col("event_type") != "error"), "user_id", "ok", "value", ["ts", "event_id"])


@register("a14_learned_patterns", """WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER w AS n, sum((event_type <> 'error')::INT) OVER w AS good FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
x AS (SELECT user_id, event_id, n, row_number() OVER (PARTITION BY user_id ORDER BY n) AS k FROM r WHERE event_type = 'error' AND n >= 3 AND good < 0.5 * n)
SELECT user_id, count(*) AS attempts, round(avg((event_type <> 'error')::INT), 6) AS success_rate,
  (SELECT coalesce(string_agg('event ' || event_id, ';' ORDER BY n), '') FROM x WHERE x.user_id = r.user_id AND k <= 5) AS examples
FROM r GROUP BY user_id HAVING count(*) >= 3""")
def a14(spark, d):
    e = _events(spark, d).withColumns({"ok": F.col("event_type") != "error", "message": F.concat(F.lit("event "), F.col("event_id").cast("string"))})
    p = mt.learned_patterns(e, "user_id", "ok", "message", "ts", "event_id")
    return p.select("user_id", "attempts", F.round("success_rate", 6).alias("success_rate"), F.array_join("examples", ";").alias("examples"))


@register("a15_error_patterns", "SELECT event_type, count(*) AS frequency, round(count(*) / (count(*) + 1.0), 6) AS confidence, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY event_type HAVING count(*) >= 2")
def a15(spark, d):
    n = F.count("*")
    return _events(spark, d).groupBy("event_type").agg(n.alias("frequency"), F.round(n / (n + 1), 6).alias("confidence"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")).filter("frequency >= 2")


@register("a17_catalog_stats", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS average, min(ts) AS oldest, max(ts) AS newest FROM events GROUP BY event_type")
def a17(spark, d):
    return _events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("average"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"))


@register("a22_hook_metrics", "SELECT event_type, count(*) AS n, CAST(sum(trunc(value)) AS BIGINT) AS total, CAST(min(trunc(value)) AS BIGINT) AS low, CAST(max(trunc(value)) AS BIGINT) AS high, CAST(sum(trunc(value)) AS BIGINT) // count(*) AS mean FROM events GROUP BY event_type")
def a22(spark, d):
    v = F.col("value").cast("long")
    return _events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.sum(v).alias("total"), F.min(v).alias("low"), F.max(v).alias("high")).withColumn("mean", F.expr("total DIV n"))


@register("w6_failure_streaks", """
WITH i AS (SELECT *, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events)
SELECT event_id, CAST(sum((event_type = 'error')::INT) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS BIGINT) AS streak FROM i""")
def w6(spark, d):
    return mt.failure_streaks(_failures(spark, d), "user_id", "failed", ["ts", "event_id"]).select("event_id", "streak")


@register("e16_denial_streaks", """
WITH g AS (SELECT *, coalesce(floor(epoch(ts)) - floor(epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) > 300, false) AS gap FROM events),
i AS (SELECT *, sum((event_type <> 'error' OR gap)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM g)
SELECT event_id, CAST(sum((event_type = 'error')::INT) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS BIGINT) AS streak FROM i""")
def e16(spark, d):
    return mt.denial_streaks(_failures(spark, d), "user_id", "failed", "ts", ["ts", "event_id"]).select("event_id", "streak")


@register("e3_circuit_breaker")
def e3(spark, d):
    return mt.circuit_breaker(_failures(spark, d), "user_id", "failed", "ts", ["ts", "event_id"]).select("event_id", "state")


@register("m5_compound", "SELECT o_orderkey, round(o_totalprice * pow(1 + 0.05 / 12, 3 * 12), 4) AS amount, round(pow(1 + 0.05 / 12, 12) - 1, 8) AS effective FROM orders")
def m5(spark, d):
    rate, years = F.lit(0.05), F.lit(3)
    return table(spark, d, "orders").select("o_orderkey", F.round(nm.compound(F.col("o_totalprice"), rate, years), 4).alias("amount"), F.round(nm.effective_rate(rate), 8).alias("effective"))


@register("m6_simple_interest", "SELECT o_orderkey, round(o_totalprice * 0.04 * 2, 4) AS interest FROM orders")
def m6(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(nm.simple_interest(F.col("o_totalprice"), F.lit(0.04), F.lit(2)), 4).alias("interest"))


@register("m7_loan", "SELECT o_orderkey, round(o_totalprice * (0.06 / 12) * pow(1 + 0.06 / 12, 60) / (pow(1 + 0.06 / 12, 60) - 1), 4) AS payment FROM orders")
def m7(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(nm.loan_payment(F.col("o_totalprice"), F.lit(0.06), F.lit(5)), 4).alias("payment"))


@register("m8_roi", "SELECT p_partkey, round((p_retailprice * 1.2 - p_retailprice) / p_retailprice * 100, 6) AS roi, round((pow(p_retailprice * 1.2 / p_retailprice, 1.0 / p_size) - 1) * 100, 6) AS annual FROM part")
def m8(spark, d):
    gain, cost = F.col("p_retailprice") * 1.2, F.col("p_retailprice")
    return table(spark, d, "part").select("p_partkey", F.round(nm.roi(gain, cost), 6).alias("roi"), F.round(nm.annual_roi(gain, cost, F.col("p_size")), 6).alias("annual"))


@register("m9_present_future", "SELECT o_orderkey, round(o_totalprice / pow(1.03, 4), 4) AS pv, round(o_totalprice * pow(1.03, 4), 4) AS fv FROM orders")
def m9(spark, d):
    v = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", F.round(nm.present_value(v, F.lit(0.03), F.lit(4)), 4).alias("pv"), F.round(nm.future_value(v, F.lit(0.03), F.lit(4)), 4).alias("fv"))


@register("m10_npv", "SELECT o_orderkey, round(-o_totalprice + o_totalprice * 0.5 / 1.08 + o_totalprice * 0.4 / pow(1.08, 2) + o_totalprice * 0.3 / pow(1.08, 3), 4) AS npv FROM orders")
def m10(spark, d):
    v = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", F.round(nm.npv(F.array(-v, v * 0.5, v * 0.4, v * 0.3), F.lit(0.08)), 4).alias("npv"))


@register("m11_irr", """
WITH RECURSIVE f AS (SELECT p_partkey, p_retailprice AS v, 0.4::DOUBLE AS b, 0.01 * p_size AS c FROM part),
n AS (SELECT p_partkey, v, c, 0 AS k, 0.1::DOUBLE AS r, NULL::DOUBLE AS last FROM f UNION ALL
  SELECT p_partkey, v, c, k + 1, r - (-v + 0.5 * v / (1 + r) + 0.4 * v / pow(1 + r, 2) + c * v / pow(1 + r, 3)) / (-0.5 * v / pow(1 + r, 2) - 0.8 * v / pow(1 + r, 3) - 3 * c * v / pow(1 + r, 4)), r
  FROM n WHERE k < 100 AND (last IS NULL OR abs(r - last) >= 1e-6))
SELECT p_partkey, round(arg_max(r, k), 5) AS irr FROM n GROUP BY p_partkey""")
def m11(spark, d):
    v = F.col("p_retailprice")
    return table(spark, d, "part").select("p_partkey", nm.irr(F.array(-v, v * 0.5, v * 0.4, v * 0.01 * F.col("p_size"))).alias("irr")).withColumn("irr", F.round("irr", 5))


@register("m12_units", "SELECT p_partkey, round(p_size * 1609.344 / 0.3048, 6) AS feet, round(p_size * 453.592 / 1.0, 6) AS grams, round(p_size * 3.78541 / 1.0, 6) AS litres FROM part")
def m12(spark, d):
    v = F.col("p_size").cast("double")
    return table(spark, d, "part").select("p_partkey", *[F.round(nm.convert(v, *x), 6).alias(n) for n, x in (("feet", ("length", "mi", "ft")), ("grams", ("weight", "lb", "g")), ("litres", ("volume", "gal", "l")))])


@register("m13_temperature", "SELECT p_partkey, round((p_size - 32) * 5 / 9.0, 6) AS c, CASE WHEN (p_size - 300) + 273.15::DOUBLE >= 0 THEN round((p_size - 300) + 273.15::DOUBLE, 6) END AS k FROM part")
def m13(spark, d):
    v = F.col("p_size").cast("double")
    return table(spark, d, "part").select("p_partkey", F.round(nm.convert_temperature(v, "F", "C"), 6).alias("c"), F.round(nm.convert_temperature(v - 300, "C", "K"), 6).alias("k"))


@register("d2_cron_next", """
WITH e AS (SELECT event_id, date_trunc('minute', ts) + INTERVAL 1 MINUTE AS s FROM events),
c AS (SELECT event_id, s, (date_trunc('day', s) + to_days(CAST(k AS INT)) + to_minutes(t)) AS cand FROM e, range(0, 367) r(k), (SELECT h * 60 + m AS t FROM (VALUES (9), (17)) a(h), (VALUES (0), (30)) b(m)))
SELECT event_id, min(cand) AS next_run FROM c WHERE cand >= s AND dayofweek(cand) BETWEEN 1 AND 5 AND day(cand) BETWEEN 1 AND 15 GROUP BY event_id""")
def d2(spark, d):
    return sc.cron_next(_events(spark, d).select("event_id", "ts"), "ts", "0,30 9,17 1-15 * 1-5").select("event_id", "next_run")


@register("d4_expiry", "SELECT event_id, ts + INTERVAL 7 DAY <= TIMESTAMP '2024-02-01 00:00:00' AS expired FROM events")
def d4(spark, d):
    return _events(spark, d).select("event_id", sc.expired(F.col("ts") + F.expr("INTERVAL 7 DAYS"), F.lit("2024-02-01").cast("timestamp")).alias("expired"))


@register("e10_retry_waits", "SELECT i::INT AS attempt, least(5000, CAST(100 * pow(2, i) AS BIGINT)) AS wait_ms FROM range(0, 8) t(i)")
def e10(spark, d):
    return spark.range(1).select(F.posexplode(sc.retry_waits(100, 8, 5000)).alias("attempt", "wait_ms"))


@register("t4_recent_first", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def t4(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey")


@register("w8_ring_log", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 25")
def w8(spark, d):
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return _events(spark, d).withColumn("n", F.row_number().over(newest)).filter("n <= 25").select("event_id")
