"""Secret scans through a trigram index of the rules' needs.

Each rule is a regular expression. From its parse tree comes a Boolean query over lower-cased
trigrams: every string it matches holds all trigrams of one of the query's conjunctions. The index
lists, for every trigram some query asks for, the rows that hold it; intersecting lists gives each
rule's candidates, and only these are matched. A rule without mandatory trigrams scans every row.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import set_aside

try:
    from re import _parser as sre
except ImportError:  # before Python 3.11
    import sre_parse as sre

#: kind: (pattern, least characters, group they are counted in). The first three are the base kinds.
RULES: dict[str, tuple[str, int, int]] = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    # a run matches whole, so asking for its least length in the pattern drops the same matches
    "access": (r"AKIA[A-Z0-9]{16,}", 20, 0),
    "hex": (r"[0-9a-f]{24,}", 24, 0),
    "github": (r"gh[pousr]_[A-Za-z0-9]{36,}", 40, 0),
    "chat": (r"xox[abprs]-[A-Za-z0-9-]{10,}", 15, 0),
    "jwt": (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30, 0),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 26, 0),
}
BASE = ("assign", "access", "hex")
#: Beyond this many alternatives a prefix is given up and the text known so far stands for the rule.
MOST_STRINGS = 64


def mandatory(pattern: str) -> list[frozenset[str]] | None:
    """Conjunctions of trigrams, one of which every match holds (lower-cased); None: no such query.

    Runs of literals, small classes and alternatives are multiplied out; anything else ends the run.
    """
    runs: list[set[str]] = [{""}]

    def literal(options: set[str]) -> None:
        grown = {a + b for a, b in product(runs[-1], options)}
        if len(grown) > MOST_STRINGS:
            runs.append(options if len(options) <= MOST_STRINGS else {""})
        else:
            runs[-1] = grown

    def strings(items) -> set[str] | None:
        """All strings that the items match, if these are few."""
        out = {""}
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                some = {chr(arg).lower()}
            elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
                some = {chr(c).lower() for _, c in arg}
            elif name == "BRANCH":
                found = [strings(b) for b in arg[1]]
                some = None if None in found else set().union(*found)
            elif name == "SUBPATTERN":
                some = strings(arg[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] == arg[1] or name == "MAX_REPEAT" and arg[:2] == (0, 1):
                one = strings(arg[2])
                some = None if one is None else {"".join(p) for n in {arg[0], arg[1]} for p in product(one, repeat=n)} if arg[1] <= 4 else None
            else:
                some = None
            if some is None or len(out) * len(some) > MOST_STRINGS:
                return None
            out = {a + b for a, b in product(out, some)}
        return out

    for item in sre.parse(pattern):
        some = strings([item])
        if some is None:
            runs.append({""})
        else:
            literal(some)
    queries = []
    for run in runs:
        grams = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run]
        if grams and all(grams):
            queries.append(grams)
    # the most selective run: the one whose weakest conjunction asks for most
    return max(queries, key=lambda q: min(map(len, q)), default=None)


def _bound(value: Column, use) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, join) -> Column:
    """Each value of an array joined with all before it, ``join`` being associative. Step k joins every value
    with the one 2^k places before, so n values take log n steps over one array each."""

    def scan_(held: Column) -> Column:
        def step(acc: Column, back: Column) -> Column:
            return F.transform(acc, lambda x, i: F.when(i >= back, join(x, F.get(acc, i - back))).otherwise(x))

        # as many steps as the last index has binary digits
        powers = F.transform(F.sequence(F.lit(1), F.length(F.bin(F.size(held) - 1))), lambda k: F.call_function("shiftleft", F.lit(1), k - 1))
        return F.when(F.size(held) > 1, F.aggregate(powers, held, step)).otherwise(held)

    return _bound(values, scan_)


def _spans(text: Column, pattern: str, least: int, group: int, size=F.length) -> Column:
    """array<struct<at, to>> of the matches that are long enough, in the units of ``size``. The pieces between
    the matches and the matches themselves, added up, give the offsets."""
    sizes = lambda g: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)), size)
    counted = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length)
    gaps = F.transform(F.split(text, pattern, -1), size)
    parts = F.struct(gaps.alias("gaps"), sizes(0).alias("sizes"), counted.alias("counts"))

    def place(p: Column) -> Column:
        ends = running(F.transform(p["sizes"], lambda s, i: s + F.get(p["gaps"], i)), lambda x, y: x + y)
        return _bound(ends, lambda e: F.transform(p["sizes"], lambda s, i: F.struct((F.get(e, i) - s).alias("at"), F.get(e, i).alias("to"), F.get(p["counts"], i).alias("n"))))

    long_enough = F.filter(_bound(parts, place), lambda m: m["n"] >= least)
    return F.transform(long_enough, lambda m: F.struct(m["at"].alias("at"), m["to"].alias("to")))


def _literal(kind: str, spans: Column, order: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["at"].alias("at"), F.lit(order).alias("kind"), F.concat(F.lit(f"{kind}:"), s["at"].cast("string"), F.lit(":"), s["to"].cast("string")).alias("said"), s["to"].alias("to")))


def trigram_postings(rows: DataFrame, grams: list[str]) -> DataFrame:
    """(gram, key): the inverted index of the wanted trigrams over rows (key, text)."""
    held = F.array_compact(F.array(*[F.when(F.col("low").contains(g), F.lit(g)) for g in grams]))
    return rows.select("key", F.lower("text").alias("low")).select("key", F.explode(held).alias("gram"))


def candidates(rows: DataFrame, rules: dict[str, tuple[str, int, int]]) -> DataFrame:
    """(key, kinds): the rules whose trigram query the row of that key answers."""
    spark = rows.sparkSession
    wanted = [(kind, n, gram, len(q)) for kind, (p, _, _) in rules.items() for n, q in enumerate(mandatory(p) or []) for gram in sorted(q)]
    terms = spark.createDataFrame(wanted, "kind string, clause int, gram string, need int")
    postings = trigram_postings(rows, sorted({w[2] for w in wanted})).distinct()
    # the terms are the rules' own trigrams, a fixed handful
    met = postings.join(F.broadcast(terms), "gram").groupBy("key", "kind", "clause", "need").agg(F.count("*").alias("n")).filter("n = need")
    return met.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def scan(docs: DataFrame, rules: dict[str, tuple[str, int, int]] = RULES, size=F.length) -> DataFrame:
    """docs with found array<struct<at, kind, said, to>>, sorted by start, then by the rules' order.

    Offsets are in code points, or in the units that ``size`` counts (F.octet_length: bytes). A null text is
    empty: nothing is found. Rows are keyed by their id and text, so repeated rows share candidates and each
    keeps its own result; null ids are keys like others. Texts of any length are matched whole, in time that
    grows with n log n of their matches. No rows in, no rows out. A column ``found`` of the input is replaced,
    others come along whatever their names.
    """
    docs, back = set_aside(docs.drop("found"), "doc_id", "text")
    names = docs.columns
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(*names, F.xxhash64("doc_id", text).alias("_key"))
    hits = candidates(keyed.select(F.col("_key").alias("key"), text.alias("text")), rules)
    # the candidates, a few bytes each, are the hashed side: the texts are dealt by their key and stay unsorted
    hits = hits.select(F.col("key").alias("_key"), F.col("kinds").alias("_kinds")).hint("shuffle_hash")
    joined = keyed.join(hits, "_key", "left")
    nothing = F.array().cast("array<struct<at:int,to:int>>")
    parts = []
    for order, (kind, (pattern, least, group)) in enumerate(rules.items()):
        spans = _spans(text, pattern, least, group, size)
        # only texts with a match are cut up
        may = text.rlike(pattern) if mandatory(pattern) is None else F.array_contains("_kinds", kind)
        spans = F.when(may, spans).otherwise(nothing)
        parts.append(_literal(kind, spans, order))
    return back(joined.withColumn("found", F.array_sort(F.concat(*parts))).select(*names, "found"))


def kinds_said(found: Column, kinds: dict[str, int] | None = None) -> Column:
    kept = found if kinds is None else F.filter(found, lambda x: x["kind"].isin(*kinds.values()))
    return F.array_join(F.transform(kept, lambda x: x["said"]), ",")


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """docs with every found span replaced by ``mask`` (overlapping spans as one); null texts stay null. All
    columns of the input come along, ``n_chars`` with the new length, and texts may hold any number of spans."""
    own, back = set_aside(docs, "doc_id", "text", "n_chars")
    raw = F.col("text").cast("binary")

    def clean(found: Column) -> Column:
        # a span that begins before an earlier one ends is covered or joined: what lies between the others stays
        reach = running(F.transform(found, lambda x: x["to"]), F.greatest)

        def between(r: Column) -> Column:
            since = lambda i: F.coalesce(F.get(r, i - 1), F.lit(0))
            gaps = F.transform(found, lambda x, i: F.struct(since(i).alias("at"), (x["at"] - since(i)).alias("n")))
            last = F.struct(F.element_at(r, -1).alias("at"), F.octet_length("text").alias("n"))
            kept = F.concat(F.filter(gaps, lambda g: g["n"] >= 0), F.array(last))
            # the bytes are bound: each cast would copy the whole text for one piece
            return _bound(raw, lambda b: F.array_join(F.transform(kept, lambda g: F.substring(b, g["at"] + 1, g["n"]).cast("string")), mask))

        return _bound(reach, between)

    # bytes can be cut at an offset without a walk from the start of the text
    out = scan(own, size=F.octet_length).withColumn("text", F.when(F.size("found") > 0, clean(F.col("found"))).otherwise(F.col("text")))
    if "n_chars" in own.columns:
        out = out.withColumn("n_chars", F.when(F.size("found") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return back(out.select(*own.columns))


def op7_trigram_secret_scan(spark, sf_dir: str) -> DataFrame:
    """The secrets of all documents: counts and spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = F.col("found")
    order = {k: i for i, k in enumerate(RULES)}
    count = lambda kind: F.size(F.filter(found, lambda x: x["kind"] == order[kind])).cast("long")
    return scan(docs).select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(kinds_said(found, {k: order[k] for k in BASE}).cast("binary"), 256).alias("base_sha256"),
        kinds_said(found).alias("spans"),
    )
