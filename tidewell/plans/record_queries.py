"""Queries on relations, inboxes, conversations and memory entries, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import numeric as nm
from tidewell.functions import text as tx
from tidewell.operators import records as rc
from tidewell.plans.catalog import register
from tidewell.session import table


def _talk(spark, d):
    return table(spark, d, "conversations")


@register("jn2_one_hop", """
WITH s AS (SELECT c_custkey FROM customer WHERE c_nationkey = 3)
SELECT DISTINCT o_custkey AS source, o_orderkey AS target FROM orders WHERE o_custkey IN (SELECT * FROM s) OR o_orderkey IN (SELECT * FROM s)""")
def jn2(spark, d):
    relations = table(spark, d, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("target"))
    names = table(spark, d, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("name"))
    return rc.touching(relations, names)


@register("jn4_fan_out", """
SELECT m.c_custkey AS sender, c.c_custkey AS member FROM customer m JOIN customer c ON m.c_nationkey = c.c_nationkey AND m.c_custkey <> c.c_custkey WHERE m.c_acctbal > 9000""")
def jn4(spark, d):
    people = table(spark, d, "customer")
    sent = people.filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("team"), F.col("c_custkey").alias("sender"))
    members = people.select(F.col("c_nationkey").alias("team"), F.col("c_custkey").alias("member"))
    return rc.fan_out(sent, members).select("sender", "member")


@register("jn5_least_loaded", """
WITH l AS (SELECT c_nationkey AS team, c_custkey AS member, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
SELECT team, member, n FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY n, member) AS r FROM l) WHERE r = 1""")
def jn5(spark, d):
    people = table(spark, d, "customer").select(F.col("c_nationkey").alias("team"), F.col("c_custkey").alias("member"))
    return rc.least_loaded(people, table(spark, d, "orders").select(F.col("o_custkey").alias("member")), "team")


@register("jn7_pairs", "SELECT a.conv_id, a.turn AS asked, b.turn AS answered FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'")
def jn7(spark, d):
    t = _talk(spark, d)
    asked = t.filter("role = 'user'").select("conv_id", F.col("turn").alias("asked"), (F.col("turn") + 1).alias("answered"))
    answers = t.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("answered"))
    return asked.join(answers, ["conv_id", "answered"]).select("conv_id", "asked", "answered")


@register("j2_insert_or_ignore", """
SELECT name, id FROM (SELECT c_mktsegment || c_nationkey AS name, c_custkey AS id, row_number() OVER (PARTITION BY c_mktsegment || c_nationkey ORDER BY c_custkey) AS n FROM customer WHERE c_custkey > 100)
WHERE n = 1 AND name NOT IN (SELECT c_mktsegment || c_nationkey FROM customer WHERE c_custkey <= 100)""")
def j2(spark, d):
    rows = table(spark, d, "customer").select(F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("name"), F.col("c_custkey").alias("id"))
    return rc.insert_or_ignore(rows.filter("id <= 100"), rows.filter("id > 100"), ["name"], "id")


@register("j3_append_distinct", """
WITH o AS (SELECT p_brand AS name, list(DISTINCT p_type) FILTER (p_partkey % 2 = 0) AS a, list(DISTINCT p_type) AS b FROM part GROUP BY p_brand)
SELECT name, len(list_distinct(list_concat(coalesce(a, []), b)))::INT AS n, (len(b) - len(coalesce(a, [])))::INT AS added FROM o""")
def j3(spark, d):
    half = F.collect_set(F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")))
    o = table(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg(half.alias("a"), F.collect_set("p_type").alias("b"))
    return o.select("name", F.size(rc.append_distinct(F.col("a"), F.col("b"))).alias("n"), F.size(F.array_except("b", "a")).alias("added"))


@register("j4_first_of_each", "SELECT doc_id AS id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n = 1 OR coalesce(source, '') = ''")
def j4(spark, d):
    return rc.keep_first(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source"), "source", "id").select("id")


@register("j5_cascade", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def j5(spark, d):
    gone = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").join(gone, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber")


@register("j6_mark_read", "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN true ELSE event_type = 'view' END AS read FROM events")
def j6(spark, d):
    return table(spark, d, "events").select("event_id", F.when(F.col("user_id") % 2 == 0, True).otherwise(F.col("event_type") == "view").alias("read"))


@register("j7_task_edges", """
WITH e AS (SELECT DISTINCT l_orderkey AS a, l_partkey AS b FROM lineitem)
SELECT 'o' || a AS node, count(*) AS n FROM e GROUP BY a UNION ALL SELECT 'p' || b, count(*) FROM e GROUP BY b""")
def j7(spark, d):
    e = table(spark, d, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("a"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("b")).distinct()
    ends = e.select(F.explode(F.array("a", "b")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("n"))


@register("j8_merged_config", "SELECT s_suppkey, coalesce(nullif(CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END, ''), 'base') AS name FROM supplier")
def j8(spark, d):
    own = F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.col("s_name"))
    return table(spark, d, "supplier").select("s_suppkey", F.coalesce(F.nullif(own, F.lit("")), F.lit("base")).alias("name"))


@register("a16_parameter_patterns", "SELECT source, lang, count(*) AS uses, round(avg((doc_id % 4 <> 0)::INT), 6) AS success FROM documents GROUP BY ALL")
def a16(spark, d):
    docs = table(spark, d, "documents")
    return docs.groupBy("source", "lang").agg(F.count("*").alias("uses"), F.round(F.avg((F.col("doc_id") % 4 != 0).cast("int")), 6).alias("success"))


@register("a18_unread", "SELECT user_id, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY user_id")
def a18(spark, d):
    return table(spark, d, "events").filter("event_type <> 'view'").groupBy("user_id").agg(F.count("*").alias("n"))


@register("a19_next_position", "SELECT l_orderkey, (coalesce(max(l_linenumber), 0) + 1)::BIGINT AS position FROM lineitem GROUP BY l_orderkey")
def a19(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg((F.coalesce(F.max("l_linenumber"), F.lit(0)) + 1).cast("long").alias("position"))


@register("a21_recipients", "SELECT DISTINCT user_id FROM events")
def a21(spark, d):
    return table(spark, d, "events").select("user_id").distinct()


@register("a23_conversation_counts", "SELECT conv_id, count(DISTINCT turn) AS turns, count(*) FILTER (role = 'assistant') AS answers, count(*) FILTER (role = 'system') AS systems FROM conversations GROUP BY conv_id")
def a23(spark, d):
    n = lambda r: F.count_if(F.col("role") == r)
    return _talk(spark, d).groupBy("conv_id").agg(F.count_distinct("turn").alias("turns"), n("assistant").alias("answers"), n("system").alias("systems"))


@register("a24_usage_cost", """
SELECT role, sum(length(coalesce(text, '')) // 4)::BIGINT AS tokens, round(sum(length(coalesce(text, '')) // 4) * (CASE role WHEN 'assistant' THEN 15 ELSE 3 END) / 1e6, 8) AS cost FROM conversations GROUP BY role""")
def a24(spark, d):
    tokens = F.sum(F.floor(F.length(F.coalesce("text", F.lit(""))) / 4))
    used = _talk(spark, d).groupBy("role").agg(tokens.alias("tokens"))
    return used.withColumn("cost", F.round(F.col("tokens") * F.when(F.col("role") == "assistant", 15).otherwise(3) / 1e6, 8))


@register("q1_canonical", "SELECT conv_id, turn, CASE role WHEN 'system' THEN 'system' ELSE 'message' END AS entry FROM conversations WHERE role IN ('user', 'assistant', 'system')")
def q1(spark, d):
    return rc.canonical(_talk(spark, d)).select("conv_id", "turn", "entry")


SPOKEN = "role = 'user' AND trim(text) <> ''"


@register("q3_session_summary", f"""
SELECT conv_id, count(*) AS messages, count(DISTINCT turn) AS turns, count(*) FILTER (role = 'user') AS asked,
  CASE WHEN length(string_split(trim(arg_min(text, turn) FILTER ({SPOKEN})), chr(10))[1]) > 120 THEN left(string_split(trim(arg_min(text, turn) FILTER ({SPOKEN})), chr(10))[1], 119) || '…'
       ELSE string_split(trim(arg_min(text, turn) FILTER ({SPOKEN})), chr(10))[1] END AS title FROM conversations GROUP BY conv_id""")
def q3(spark, d):
    return rc.session_summary(_talk(spark, d))


@register("q4_session_digest", rf"""
WITH s AS (SELECT conv_id, count(DISTINCT turn) AS turns, trim(regexp_replace(arg_min(text, turn) FILTER ({SPOKEN}), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS f,
  trim(regexp_replace(arg_max(text, turn) FILTER (role = 'assistant' AND trim(text) <> ''), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS l FROM conversations GROUP BY conv_id)
SELECT conv_id, turns, CASE WHEN length(f) > 160 THEN left(f, 159) || '…' ELSE f END AS first_user, CASE WHEN length(l) > 160 THEN left(l, 159) || '…' ELSE l END AS last_assistant FROM s""")
def q4(spark, d):
    return rc.session_digest(_talk(spark, d))


@register("q8_first_island", """
WITH m AS (SELECT conv_id, turn, role = 'user' AS f, coalesce(lag(role = 'user') OVER (PARTITION BY conv_id ORDER BY turn), false) AS p FROM conversations),
i AS (SELECT *, sum((f AND NOT p)::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM m)
SELECT conv_id, turn FROM i WHERE f AND island = 1""")
def q8(spark, d):
    flagged = _talk(spark, d).withColumn("flag", F.col("role") == "user")
    return rc.first_island(flagged, "conv_id", "flag", "turn").select("conv_id", "turn")


@register("w2_preserved_tail", """
WITH t AS (SELECT conv_id, turn, length(coalesce(text, '')) // 4 AS n FROM conversations),
s AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS total FROM t)
SELECT conv_id, turn FROM s WHERE total - n < 200""")
def w2(spark, d):
    tokens = F.floor(F.length(F.coalesce("text", F.lit(""))) / 4)
    return rc.preserved_tail(_talk(spark, d), tokens, 200).select("conv_id", "turn")


@register("w4_last_turns", "SELECT conv_id, turn FROM conversations JOIN (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id) USING (conv_id) WHERE turn >= last - 2 OR (turn IS NULL AND role = 'system')")
def w4(spark, d):
    return rc.last_turns(_talk(spark, d), 2).select("conv_id", "turn")


@register("k5_transcript", """
SELECT conv_id, md5(right(string_agg(role || ': ' || left(text, 1200), chr(10) ORDER BY turn, role || ': ' || left(text, 1200)), 8000)) AS digest FROM conversations
WHERE role IN ('user', 'assistant') AND text IS NOT NULL GROUP BY conv_id""")
def k5(spark, d):
    return rc.transcript(_talk(spark, d)).select("conv_id", F.md5(F.col("transcript").cast("binary")).alias("digest"))


@register("k6_eligible", "SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'user') >= 3")
def k6(spark, d):
    return _talk(spark, d).groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("n")).filter("n >= 3").select("conv_id")


@register("k1_like_search", "SELECT n_nationkey FROM nation WHERE lower(n_name) LIKE '%a_i%'")
def k1(spark, d):
    return table(spark, d, "nation").filter(F.lower("n_name").like("%a_i%")).select("n_nationkey")


@register("t2_relevance", """
SELECT event_id, round(least(1.0, 0.4 * (value / 100) + 0.2 * 0.5 + 0.3 * greatest(0.0, (24 - (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts)) / 3.6e9) / 24) + CASE WHEN event_type = 'error' THEN 0.3 ELSE 0 END + 0.1 * (user_id % 3)), 6) AS score FROM events""")
def t2(spark, d):
    e = table(spark, d, "events")
    hours = (F.unix_micros(F.lit("2024-01-31").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 3.6e9
    score = rc.relevance(F.col("value") / 100, F.lit(0.5), hours, F.col("event_type") == "error", F.col("user_id") % 3)
    return e.select("event_id", F.round(score, 6).alias("score"))


@register("t3_importance", """
SELECT doc_id AS id, round(greatest(0.1, least(1.0, 0.2::DOUBLE + CASE WHEN length(text) > 100 THEN 0.4 WHEN length(text) > 50 THEN 0.2 ELSE 0 END + CASE WHEN doc_id % 6 > 3 THEN 0.3 WHEN doc_id % 6 > 1 THEN 0.2 ELSE 0 END)), 6) AS importance FROM documents""")
def t3(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.round(rc.importance(F.length("text"), F.col("doc_id") % 6), 6).alias("importance"))


@register("t5_oldest_unread", "SELECT event_id FROM events WHERE event_type <> 'view' ORDER BY ts, event_id LIMIT 50")
def t5(spark, d):
    return table(spark, d, "events").filter("event_type <> 'view'").orderBy("ts", "event_id").limit(50).select("event_id")


@register("t9_usage_order", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 20")
def t9(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(20)


@register("e4_cache", """
WITH m AS (SELECT max(ts) AS now FROM events), live AS (SELECT event_id, ts FROM events, m WHERE ts + INTERVAL 15 DAY > now)
SELECT event_id FROM live ORDER BY ts DESC, event_id DESC LIMIT 100""")
def e4(spark, d):
    e = table(spark, d, "events")
    live = e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now")))).filter(F.col("ts") + F.expr("INTERVAL 15 DAYS") > F.col("now"))
    return live.orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id")


@register("e7_collected", "SELECT event_type, count(*) AS seen, count(*) FILTER (ts + INTERVAL 7 DAY <= TIMESTAMP '2024-02-01 00:00:00') AS expired FROM events GROUP BY event_type")
def e7(spark, d):
    gone = F.col("ts") + F.expr("INTERVAL 7 DAYS") <= F.lit("2024-02-01").cast("timestamp")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("seen"), F.count_if(gone).alias("expired"))


@register("e12_compaction", "SELECT o_orderkey, round(least(0.85 * (o_totalprice - 1000), o_totalprice - 1000 - 13000), 4) AS tokens FROM orders")
def e12(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(rc.compaction_limit(F.col("o_totalprice"), F.lit(1000)), 4).alias("tokens"))


@register("e15_decay", "SELECT event_id, round(greatest(0.1, value / 100 * 0.9), 6) AS importance FROM events")
def e15(spark, d):
    return table(spark, d, "events").select("event_id", F.round(F.greatest(F.lit(0.1), F.col("value") / 100 * 0.9), 6).alias("importance"))


@register("d6_unix_time", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events")
def d6(spark, d):
    return table(spark, d, "events").select("event_id", F.unix_timestamp("ts").alias("seconds"))


@register("m4_variables", r"""SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(url, '\b[a-zA-Z_][a-zA-Z0-9_]*\b'),
lambda x: x NOT IN ('pi', 'PI', 'e', 'E', 'sin', 'cos', 'tan', 'asin', 'acos', 'atan', 'log', 'ln', 'abs', 'sqrt', 'pow', 'exp', 'factorial')))), ',') AS names FROM pages""")
def m4(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(tx.variables(F.col("url")), ",").alias("names"))


@register("m14_batch_conversion", "SELECT p_partkey, round(p_size * 0.0254::DOUBLE / 0.001, 6) AS millimetres, round(p_size * 453.592::DOUBLE / 1000, 6) AS kilograms FROM part")
def m14(spark, d):
    v = F.col("p_size").cast("double")
    return table(spark, d, "part").select("p_partkey", F.round(nm.convert(v, "length", "in", "mm"), 6).alias("millimetres"), F.round(nm.convert(v, "weight", "lb", "kg"), 6).alias("kilograms"))
