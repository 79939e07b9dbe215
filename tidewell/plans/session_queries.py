"""Queries on arithmetic, patches, sessions, graphs and schedules, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions import maths as ma
from tidewell.operators import metrics as mt
from tidewell.operators import records as rc
from tidewell.operators import sessions as se
from tidewell.plans.catalog import register
from tidewell.session import table


def _part(spark, d):
    return table(spark, d, "part")


@register("m1_arithmetic", """SELECT p_partkey, round(p_retailprice + p_size + 0.25, 2) AS added, round(p_retailprice - p_size - 0.25, 2) AS taken, round(p_size * 3 * 0.5::DOUBLE, 1) AS times, CASE WHEN p_size % 5 <> 0 THEN round(p_retailprice / (p_size % 5), 2) END AS parts FROM part""")
def m1(spark, d):
    v, n = F.col("p_retailprice"), F.col("p_size")
    return _part(spark, d).select("p_partkey", ma.arithmetic("add", [v, n, F.lit(0.25)], 2).alias("added"), ma.arithmetic("subtract", [v, n, F.lit(0.25)], 2).alias("taken"), ma.arithmetic("multiply", [n, F.lit(3), F.lit(0.5)], 1).alias("times"), ma.arithmetic("divide", [v, n % 5], 2).alias("parts"))


@register("m2_functions", """WITH x AS (SELECT p_partkey, (p_size - 25) / 20.0::DOUBLE AS x, p_size AS n FROM part)
SELECT p_partkey, round(sin(radians(n)), 6) AS sine, CASE WHEN x BETWEEN -1 AND 1 THEN round(degrees(asin(x)), 6) END AS arc, CASE WHEN x > 0 THEN round(log10(x), 6) END AS tens, CASE WHEN x >= 0 THEN round(sqrt(x), 6) END AS root, round(exp(x), 6) AS grown,
 CASE WHEN x >= 0 THEN round(pow(x, 1.5), 6) END AS power, CASE WHEN n <= 20 THEN factorial(n)::DOUBLE END AS product FROM x""")
def m2(spark, d):
    x, n = (F.col("p_size") - 25) / 20.0, F.col("p_size")
    r = lambda c: F.round(c, 6)
    return _part(spark, d).select(
        "p_partkey", r(ma.function("sin", n.cast("double"), degrees=True)).alias("sine"), r(ma.function("asin", x, degrees=True)).alias("arc"), r(ma.function("log", x)).alias("tens"), r(ma.function("sqrt", x)).alias("root"),
        r(ma.function("exp", x)).alias("grown"), r(ma.function("pow", x, F.lit(1.5))).alias("power"), F.when(n <= 20, ma.function("factorial", n.cast("double"))).alias("product"),
    )


@register("m3_expressions", "SELECT p_partkey, round(2 * pi() * p_size + pow(p_size + 1, 2) / sqrt(p_retailprice) - abs(3 - p_size), 6) AS value FROM part")
def m3(spark, d):
    return _part(spark, d).select("p_partkey", F.round(ma.evaluate("2 * pi * n + (n + 1)^2 / sqrt(price) - abs(3 - n)", {"n": "p_size", "price": "p_retailprice"}), 6).alias("value"))


@register("f1_sets", "SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_linenumber % 3))), ',') AS kinds, bool_or(l_linenumber % 3 = 2) AS has_two FROM lineitem GROUP BY l_orderkey")
def f1(spark, d):
    kinds = F.array_sort(F.array_distinct(F.collect_list(F.col("l_linenumber") % 3)))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(kinds.alias("k")).select("l_orderkey", F.array_join(F.col("k").cast("array<string>"), ",").alias("kinds"), F.array_contains("k", 2).alias("has_two"))


@register("f2_equal_maps", "SELECT doc_id AS id, doc_id % 3 <> 2 AS equal FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def f2(spark, d):
    a = F.create_map(F.lit("l"), F.col("lang"), F.lit("s"), F.col("source"))
    b = F.create_map(F.lit("s"), F.col("source"), F.lit("l"), F.when(F.col("doc_id") % 3 == 2, "other").otherwise(F.col("lang")))
    same = F.array_sort(F.map_entries(a)) == F.array_sort(F.map_entries(b))
    return table(spark, d, "documents").filter("lang is not null and source is not null").select(F.col("doc_id").alias("id"), same.alias("equal"))


@register("f4_transcript_hash", """SELECT conv_id, sha256('[' || string_agg('{"role":' || to_json(role) || ',"turn":' || turn || '}', ',' ORDER BY turn, role) || ']') AS hash FROM conversations GROUP BY conv_id""")
def f4(spark, d):
    return se.transcript_hash(table(spark, d, "conversations"), "conv_id", "turn", ["turn", "role"])


@register("f5_root_hash", """WITH RECURSIVE h AS (SELECT page_id, url, 0 AS i, 2166136261::UBIGINT AS v FROM pages UNION ALL
SELECT page_id, url, i + 1, (xor(v, ascii(substr(url, i + 1, 1))::UBIGINT) * 16777619) & 4294967295 FROM h WHERE i < length(url))
SELECT page_id, arg_max(v, i)::BIGINT AS hash FROM h GROUP BY page_id""")
def f5(spark, d):
    return table(spark, d, "pages").select("page_id", ma.fnv32(F.col("url")).alias("hash"))


@register("f6_line_patches", "SELECT doc_id AS id, 2 AS old_start, 7 AS old_lines, 7 AS new_lines, ' l1| l2| l3|-old|+new ' || doc_id || '| l5| l6| l7' AS patch FROM documents")
def f6(spark, d):
    old = F.lit("l0\nl1\nl2\nl3\nold\nl5\nl6\nl7\nl8\n")
    new = F.replace(old, F.lit("old"), F.concat(F.lit("new "), F.col("doc_id").cast("string")))
    patch = ma.line_patch(old, new)
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), patch["old_start"].alias("old_start"), patch["old_lines"].alias("old_lines"), patch["new_lines"].alias("new_lines"), F.array_join(patch["lines"], "|").alias("patch"))


@register("f7_patched", "SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'a' || chr(10) || 'X' || doc_id || chr(10) || 'd' END AS text FROM documents")
def f7(spark, d):
    i = F.col("doc_id")
    search = F.when(i % 2 == 0, F.lit("b\nc")).otherwise(F.lit("b\nd"))
    return table(spark, d, "documents").select(i.alias("id"), ma.apply_patch(F.lit("a\nb\nc\nd"), search, F.concat(F.lit("X"), i.cast("string"))).alias("text"))


@register("q2_synced", """WITH o AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 1 AND turn = 0 THEN 'x' ELSE role END AS v FROM conversations WHERE turn < 2),
n AS (SELECT conv_id, turn, role AS v FROM conversations WHERE conv_id % 5 <> 4), b AS (SELECT conv_id, bool_and(coalesce(o.v = n.v, false)) AS begins FROM o LEFT JOIN n USING (conv_id, turn) GROUP BY conv_id)
SELECT n.conv_id, n.turn, n.v, CASE WHEN coalesce(b.begins, true) THEN 'append' ELSE 'replace' END AS action FROM n LEFT JOIN b USING (conv_id) WHERE NOT coalesce(b.begins, true) OR n.turn >= 2
UNION ALL SELECT DISTINCT conv_id, NULL, NULL, 'clear' FROM o WHERE conv_id % 5 = 4""")
def q2(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("v"))
    old = t.filter("turn < 2").withColumn("v", F.when((F.col("conv_id") % 3 == 1) & (F.col("turn") == 0), "x").otherwise(F.col("v")))
    return se.synced(old, t.filter("conv_id % 5 <> 4"), "conv_id", "turn", "v")


SAID = "CASE turn % 4 WHEN 0 THEN 'Please remember that x' || conv_id || '. Be brief! ok' WHEN 1 THEN 'Answer in french; nothing' WHEN 2 THEN 'We prefer tabs?' || chr(10) || 'hm' ELSE text END"


@register("q5_directives", f"""
WITH t AS (SELECT conv_id, turn, {SAID} AS text FROM conversations WHERE turn % 4 < 3),
p AS (SELECT conv_id, turn, unnest(regexp_split_to_array(text, '[\\r\\n.;!?]')) AS raw, generate_subscripts(regexp_split_to_array(text, '[\\r\\n.;!?]'), 1) AS n FROM t),
k AS (SELECT conv_id, turn, n, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS value FROM p),
f AS (SELECT *, CASE WHEN contains(lower(value), 'remember that') THEN 'instruction:' || trim(regexp_replace(lower(value), '[^a-z0-9]+', '-', 'g'), '-') WHEN contains(lower(value), 'answer in ') THEN 'preference:response-language'
 WHEN contains(lower(value), 'be brief') THEN 'preference:response-style' WHEN contains(lower(value), 'prefer ') THEN 'preference:' || trim(regexp_replace(lower(value), '[^a-z0-9]+', '-', 'g'), '-') END AS key FROM k)
SELECT conv_id, key, CASE WHEN key LIKE 'preference:response%' THEN 'user' ELSE 'project' END AS scope, split_part(key, ':', 1) AS kind, arg_max(value, (turn, n)) AS value FROM f WHERE key IS NOT NULL GROUP BY conv_id, key""")
def q5(spark, d):
    return se.directives(table(spark, d, "conversations").filter("turn % 4 < 3").select("conv_id", "turn", F.expr(SAID).alias("text")), "conv_id")


@register("q9_boundaries", """WITH f AS (SELECT conv_id, count(*) AS n, count(DISTINCT turn) AS turns FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'messages mismatch' WHEN conv_id % 3 = 1 THEN 'turns mismatch' END AS problem FROM f""")
def q9(spark, d):
    found = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("messages"), F.count_distinct("turn").alias("turns"))
    i = F.col("conv_id") % 3
    claimed = found.select("conv_id", (F.col("messages") + (i == 0).cast("int")).alias("messages"), (F.col("turns") + (i == 1).cast("int")).alias("turns"))
    return se.boundary_problem(found, claimed, "conv_id", ["messages", "turns"])


@register("q10_context", """WITH s AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id), r AS (SELECT *, conv_id % 4 AS project, row_number() OVER (PARTITION BY conv_id % 4 ORDER BY conv_id DESC) AS k FROM s)
SELECT project, '## Recent sessions' || chr(10) || string_agg('- ' || conv_id || ': ' || n || ' messages', chr(10) ORDER BY conv_id DESC) AS context FROM r WHERE k <= 3 GROUP BY project""")
def q10(spark, d):
    """The last three sessions of each project as a section of its context."""
    s = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("project", F.col("conv_id") % 4)
    top = s.withColumn("k", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("conv_id")))).filter("k <= 3")
    line = F.concat(F.lit("- "), F.col("conv_id").cast("string"), F.lit(": "), F.col("n").cast("string"), F.lit(" messages"))
    lists = top.groupBy("project").agg(F.sort_array(F.collect_list(F.struct("k", line.alias("line")))).alias("rows"))
    return lists.select("project", F.concat(F.lit("## Recent sessions\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("context"))


@register("q11_project_history", "SELECT conv_id, turn FROM conversations WHERE conv_id % 4 = 1 AND role = 'user'")
def q11(spark, d):
    return table(spark, d, "conversations").filter("conv_id % 4 = 1 AND role = 'user'").select("conv_id", "turn")


@register("q12_prompts", """SELECT n_regionkey AS pid, string_agg(replace('Hi {{who}} ' || n_name, '{{who}}', 'you'), chr(10) || chr(10) ORDER BY n_nationkey % 3 DESC, n_nationkey) AS prompt, 'who' AS used FROM nation WHERE n_nationkey % 4 <> 0 GROUP BY n_regionkey""")
def q12(spark, d):
    n = F.col("n_nationkey")
    sections = table(spark, d, "nation").select(F.col("n_regionkey").alias("pid"), n.alias("seq"), (n % 3).alias("priority"), (n % 4 != 0).alias("enabled"), F.concat(F.lit("Hi {{who}} "), F.col("n_name")).alias("content"))
    return se.prompt_text(sections, "pid", {"who": "you", "when": "now"}).select("pid", "prompt", F.array_join("used", ",").alias("used"))


@register("w3_widened_tail", """WITH m AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id) SELECT conv_id, CASE WHEN last - 1 <= 0 THEN least(0, last - 1) WHEN (last - 1) % 2 = 1 THEN last - 2 ELSE last - 1 END AS start FROM m""")
def w3(spark, d):
    """Odd turns answer the tool that the turn before them used."""
    t = table(spark, d, "conversations").select("conv_id", "turn").distinct()
    name = lambda c: F.concat(F.lit("t"), c.cast("string"))
    rows = t.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, name(F.col("turn"))).otherwise("").alias("uses"), F.when(F.col("turn") % 2 == 1, name(F.col("turn") - 1)).otherwise("").alias("answers"))
    starts = t.groupBy("conv_id").agg((F.max("turn") - 1).alias("start"))
    return se.widened_tail(rows, starts, "conv_id", "turn")


@register("k2_open_nodes", """WITH s AS (SELECT c_custkey, c_name FROM customer WHERE c_name IN ('Customer#000000001', 'Customer#000000004', 'Customer#4', 'Customer#7')) SELECT c_name AS name, count(o_orderkey) AS relations FROM s LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_name""")
def k2(spark, d):
    names = ["Customer#000000001", "Customer#000000004", "Customer#4", "Customer#7"]
    nodes = table(spark, d, "customer").filter(F.col("c_name").isin(*names)).select(F.col("c_custkey").alias("name"), F.col("c_name").alias("title"))
    edges = table(spark, d, "orders").select(F.col("o_custkey").alias("source"), (-F.col("o_orderkey")).alias("target"))
    touching = rc.touching(edges, nodes.select("name")).groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n"))
    return nodes.join(touching, "name", "left").select(F.col("title").alias("name"), F.coalesce("n", F.lit(0)).cast("long").alias("relations"))


@register("k3_graph_context", """SELECT r_regionkey, left('## Memory' || chr(10) || chr(10) || '**' || r_name || '** (region)' || chr(10) || string_agg('- ' || n_name || chr(10), '' ORDER BY n_name) || chr(10), 60) AS context FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name""")
def k3(spark, d):
    obs = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    lines = F.array_join(F.transform("names", lambda n: F.concat(F.lit("- "), n, F.lit("\n"))), "")
    said = F.concat(F.lit("## Memory\n\n**"), F.col("r_name"), F.lit("** (region)\n"), lines, F.lit("\n"))
    return table(spark, d, "region").join(obs, "r_regionkey").select("r_regionkey", F.left(said, F.lit(15 * 4)).alias("context"))


@register("k4_salvaged", "SELECT p_partkey, p_name AS name, 'part' AS entity_type, 1 AS n FROM part WHERE p_partkey % 4 <> 3")
def k4(spark, d):
    """JSON in a fence or among words; entities without a name or type and blank observations go."""
    body = F.to_json(F.struct(F.array(F.struct(F.when(F.col("p_partkey") % 4 == 3, " ").otherwise(F.col("p_name")).alias("name"), F.lit("part").alias("entity_type"), F.array(F.lit("big"), F.lit(" ")).alias("observations"))).alias("entities")))
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("Here: "), body, F.lit(" done")))
    found = F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), "struct<entities:array<struct<name:string,entity_type:string,observations:array<string>>>>")["entities"]
    rows = _part(spark, d).select("p_partkey", F.explode(found).alias("e")).filter("trim(e.name) <> '' and trim(e.entity_type) <> ''")
    return rows.select("p_partkey", F.trim("e.name").alias("name"), F.trim("e.entity_type").alias("entity_type"), F.size(F.filter("e.observations", lambda o: F.trim(o) != "")).alias("n"))


@register("d3_triggers", """SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_id % 7 > 0 THEN date_trunc('second', ts) + to_seconds(event_id % 7 * 60) WHEN event_id % 3 = 1 AND TIMESTAMP '2024-01-15 00:00:00' > ts THEN TIMESTAMP '2024-01-15 00:00:00' END AS next_run FROM events""")
def d3(spark, d):
    i = F.col("event_id")
    kind = F.when(i % 3 == 0, "interval").when(i % 3 == 1, "once").otherwise("never")
    return table(spark, d, "events").select("event_id", se.next_of_trigger(kind, i % 7 * 60, F.lit("2024-01-15").cast("timestamp"), F.col("ts").cast("timestamp")).alias("next_run"))


@register("d5_retry_after", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 120 WHEN 1 THEN greatest(0, 1706745600 - floor(epoch(ts))::BIGINT) ELSE 0 END::BIGINT AS wait FROM events""")
def d5(spark, d):
    header = F.when(F.col("event_id") % 4 == 0, "120").when(F.col("event_id") % 4 == 1, "Thu, 01 Feb 2024 00:00:00 GMT").when(F.col("event_id") % 4 == 2, "-5").otherwise("soon")
    return table(spark, d, "events").select("event_id", se.retry_after(header, F.col("ts").cast("timestamp")).alias("wait"))


@register("e8_session_retention", "SELECT user_id, max(ts) AS updated FROM events GROUP BY user_id HAVING epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch(max(ts)) <= 259200")
def e8(spark, d):
    s = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("updated"))
    return s.filter(F.unix_micros(F.lit("2024-02-01").cast("timestamp")) - F.unix_micros(F.col("updated").cast("timestamp")) <= 259_200_000_000)


@register("e9_due_jobs", "SELECT event_id, ts + to_minutes(5) AS next_run FROM events WHERE event_type <> 'signup' AND ts <= TIMESTAMP '2024-01-10 00:00:00' AND event_id % 10 <> 0")
def e9(spark, d):
    """Active jobs whose time has come and that do not run already, with their next time."""
    jobs = table(spark, d, "events").filter((F.col("event_type") != "signup") & (F.col("ts") <= F.lit("2024-01-10").cast("timestamp")))
    running = jobs.filter("event_id % 10 = 0").select("event_id")
    return jobs.join(running, "event_id", "left_anti").select("event_id", (F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("next_run"))


@register("e11_backoff", "SELECT i::INT AS attempt, CAST(least(30000, 500 * pow(2, i - 1)) AS BIGINT) AS wait_ms FROM range(1, 11) t(i)")
def e11(spark, d):
    return spark.range(1, 11).select(F.col("id").cast("int").alias("attempt"), se.backoff(F.col("id"), 500, 2.0, 30_000).alias("wait_ms"))


@register("e13_budget", """WITH t AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS total, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE text IS NOT NULL),
g AS (SELECT *, total - coalesce(lag(total) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS delta FROM t),
h AS (SELECT *, lag(delta) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM g),
c AS (SELECT conv_id, turn, NOT coalesce(n > 2 AND delta < 200 AND before < 200, false) AND total < 0.9 * 3000 AS fine FROM h)
SELECT conv_id, turn, (SELECT count(*) FROM c p WHERE p.conv_id = c.conv_id AND p.turn <= c.turn AND NOT p.fine) = 0 AS go FROM c""")
def e13(spark, d):
    t = table(spark, d, "conversations").filter("text is not null")
    total = F.sum(F.length("text")).over(Window.partitionBy("conv_id").orderBy("turn"))
    return se.continuation(t.select("conv_id", "turn", total.alias("total")), "conv_id", "turn", "total", 3000, 200).select("conv_id", "turn", F.coalesce("go", F.lit(False)).alias("go"))


@register("e1_bounded_queue", """WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
q AS (SELECT user_id, 0 AS n, 0 AS held, 0 AS kept FROM e GROUP BY user_id UNION ALL
 SELECT q.user_id, q.n + 1, greatest(0, least(q.held + 1, 8) - CASE WHEN (q.n + 1) % 3 = 0 THEN 1 ELSE 0 END), q.kept + CASE WHEN q.held < 8 THEN 1 ELSE 0 END FROM q JOIN e ON e.user_id = q.user_id AND e.n = q.n + 1)
SELECT user_id, arg_max(kept, n)::BIGINT AS emitted, (max(n) - arg_max(kept, n))::BIGINT AS overflow, arg_max(held, n)::BIGINT AS held FROM q GROUP BY user_id""")
def e1(spark, d):
    return se.bounded_queue(table(spark, d, "events").select("user_id", "event_id"), 8, 3, "user_id", "event_id")


@register("a12_exposition", """SELECT event_type AS name, '# TYPE ' || event_type || ' counter' || chr(10) || event_type || ' ' || count(*) AS text FROM events GROUP BY event_type ORDER BY name""")
def a12(spark, d):
    n = table(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n"))
    return n.select("name", F.format_string("# TYPE %s counter\n%s %d", "name", "name", "n").alias("text")).orderBy("name")


BOUNDS = mt.TIMER_BOUNDS
RANK = "CASE " + " ".join(f"WHEN value <= {b} THEN {i}" for i, b in enumerate(BOUNDS)) + f" ELSE {len(BOUNDS)} END"


@register("a12_snapshot", f"""WITH h AS (SELECT event_type, {RANK} AS bucket, count(*) AS n FROM events GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY bucket) AS running, sum(n) OVER (PARTITION BY event_type) AS total FROM h)
SELECT event_type, any_value(total)::BIGINT AS n, (SELECT round(avg(value), 6) FROM events e WHERE e.event_type = r.event_type) AS average,
([{', '.join(f'{b}.0' for b in BOUNDS)}]::DOUBLE[])[least(min(bucket) FILTER (running >= greatest(1, floor(total * 50 / 100))) + 1, {len(BOUNDS)})] AS p50,
([{', '.join(f'{b}.0' for b in BOUNDS)}]::DOUBLE[])[least(min(bucket) FILTER (running >= greatest(1, floor(total * 95 / 100))) + 1, {len(BOUNDS)})] AS p95,
([{', '.join(f'{b}.0' for b in BOUNDS)}]::DOUBLE[])[least(min(bucket) FILTER (running >= greatest(1, floor(total * 99 / 100))) + 1, {len(BOUNDS)})] AS p99
FROM r GROUP BY event_type""")
def a12_snapshot(spark, d):
    e = table(spark, d, "events")
    sums = e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("average"))
    hist = mt.histogram(e, "event_type", "value")
    for p in (50, 95, 99):
        sums = sums.join(mt.histogram_percentile(hist, "event_type", p).withColumnRenamed("bound", f"p{p}"), "event_type")
    return sums.select("event_type", "n", "average", "p50", "p95", "p99")


@register("t6_run_history", "SELECT o_orderkey AS run FROM orders WHERE o_custkey % 2 = 0 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def t6(spark, d):
    return table(spark, d, "orders").filter("o_custkey % 2 = 0").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50).select(F.col("o_orderkey").alias("run"))


@register("t7_upcoming", "SELECT event_id, ts AS next_run FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00' ORDER BY ts, event_id LIMIT 20")
def t7(spark, d):
    return table(spark, d, "events").filter(F.col("ts") > F.lit("2024-01-15").cast("timestamp")).orderBy("ts", "event_id").limit(20).select("event_id", F.col("ts").alias("next_run"))


@register("t8_sessions_by_file", "SELECT l_partkey AS file, count(DISTINCT l_orderkey) AS sessions, max(l_shipdate) AS last FROM lineitem GROUP BY l_partkey")
def t8(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("file")).agg(F.count_distinct("l_orderkey").alias("sessions"), F.max("l_shipdate").alias("last"))


@register("t10_tasks", "SELECT l_orderkey, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_shipdate, l_linenumber) AS tasks FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_orderkey")
def t10(spark, d):
    """Open tasks of each list by position, then creation."""
    rows = table(spark, d, "lineitem").filter("l_linestatus = 'O'").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_shipdate", "l_linenumber"))).alias("rows"))
    return rows.select("l_orderkey", F.array_join(F.transform("rows", lambda r: r["l_linenumber"].cast("string")), ",").alias("tasks"))
