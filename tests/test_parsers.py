"""Expressions, shell commands and searches over line ends against plain Python on random input."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tidewell.functions import expressions as ex
from tidewell.functions import maths as ma
from tidewell.functions import shell as sh
from tidewell.operators import metrics as mt
from tidewell.operators import retrieval as rt
from tidewell.operators import sessions as se
from tidewell.operators import spans as sn

LEVEL = {"?": 0, "||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, ">=": 3, "+": 4, "-": 4, "*": 5, "/": 5, "%": 5, "neg": 6, "not": 6, "**": 7}


class NoValue(Exception):
    pass


def _tree(rng, depth, truth=False):
    if truth:
        kind = rng.choice(["<", ">=", "==", "!=", "&&", "||", "not"]) if depth else "<"
        if kind in ("&&", "||"):
            return (kind, _tree(rng, depth - 1, True), _tree(rng, depth - 1, True))
        if kind == "not":
            return (kind, _tree(rng, depth - 1, True))
        return (kind, _tree(rng, max(depth - 1, 0)), _tree(rng, max(depth - 1, 0)))
    kind = rng.choice(["+", "-", "*", "/", "%", "**", "neg", "?", "call", "leaf"]) if depth else "leaf"
    if kind == "leaf":
        return rng.choice(["a", "b", "c", 2.0, 0.5, 3.0, "pi"])
    if kind == "neg":
        return (kind, _tree(rng, depth - 1))
    if kind == "call":
        return ("call", rng.choice(["sqrt", "abs", "ln", "sin", "exp"]), _tree(rng, depth - 1))
    if kind == "?":
        return (kind, _tree(rng, depth - 1, True), _tree(rng, depth - 1), _tree(rng, depth - 1))
    return (kind, _tree(rng, depth - 1), _tree(rng, depth - 1))


def _said(t):
    """(text, level) with no more brackets than the levels ask for."""
    if isinstance(t, str):
        return t, 9
    if isinstance(t, float):
        return repr(t), 9
    kind = t[0]
    wrap = lambda x, least: _said(x)[0] if _said(x)[1] >= least else f"({_said(x)[0]})"
    if kind == "call":
        return f"{t[1]}({_said(t[2])[0]})", 9
    if kind == "neg":
        return f"-{wrap(t[1], 6)}", 6
    if kind == "not":
        return f"!{wrap(t[1], 6)}", 6
    if kind == "**":
        return f"{wrap(t[1], 8)} ** {wrap(t[2], 6)}", 7
    if kind == "?":
        return f"{wrap(t[1], 1)} ? {_said(t[2])[0]} : {_said(t[3])[0]}", 0
    return f"{wrap(t[1], LEVEL[kind])} {kind} {wrap(t[2], LEVEL[kind] + 1)}", LEVEL[kind]


def _value(t, names):
    if isinstance(t, float):
        return t
    if isinstance(t, str):
        return math.pi if t == "pi" else names[t]
    kind, *args = t
    if kind == "?":
        return _value(args[1] if _value(args[0], names) else args[2], names)
    if kind == "&&":
        return _value(args[0], names) and _value(args[1], names)
    if kind == "||":
        return _value(args[0], names) or _value(args[1], names)
    if kind == "not":
        return not _value(args[0], names)
    if kind == "call":
        x = _value(args[1], names)
        if args[0] == "sqrt" and x < 0 or args[0] == "ln" and x <= 0 or args[0] == "exp" and x > 700:
            raise NoValue
        return {"sqrt": math.sqrt, "abs": abs, "ln": math.log, "sin": math.sin, "exp": math.exp}[args[0]](x)
    a = [_value(x, names) for x in args]
    try:
        out = {
            "neg": lambda: -a[0], "+": lambda: a[0] + a[1], "-": lambda: a[0] - a[1], "*": lambda: a[0] * a[1], "/": lambda: a[0] / a[1], "%": lambda: math.fmod(a[0], a[1]), "**": lambda: math.pow(a[0], a[1]),
            "<": lambda: a[0] < a[1], ">=": lambda: a[0] >= a[1], "==": lambda: a[0] == a[1], "!=": lambda: a[0] != a[1],
        }[kind]()
    except (ZeroDivisionError, ValueError, OverflowError):
        raise NoValue from None
    if isinstance(out, float) and not math.isfinite(out):
        raise NoValue
    return out


def test_random_expressions_equal_their_trees(spark):
    rng = random.Random(9)
    trees = [_tree(rng, 3) for _ in range(120)]
    rows = [(float(a), float(b), c) for a, b, c in ((0, 1, -2.5), (3, -2, 0.25), (7, 7, 1.0))]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    names = {n: F.col(n) for n in "abc"}
    got = df.select("a", "b", "c", *(ex.compile_expression(_said(t)[0], names).alias(f"x{i}") for i, t in enumerate(trees))).collect()
    nulls = 0
    for r in got:
        for i, t in enumerate(trees):
            try:
                want = _value(t, {"a": r.a, "b": r.b, "c": r.c})
            except NoValue:
                want = None
            nulls += want is None
            assert r[f"x{i}"] == (None if want is None else pytest.approx(want, rel=1e-9, abs=1e-9)), _said(t)[0]
    assert 0 < nulls < 200


def test_expressions_that_cannot_be_read():
    a = {"a": F.lit(1.0)}
    for wrong in ("", "1 +", "(1", "a b", "foo(1)", "x", "1 < 2", "a ? 1 : 2", "(a < 1 ? 1 : a < 2)", "pow(1)", "sin(1, 2)", "a $ 1", "!a", "a && a"):
        with pytest.raises(ValueError):
            ex.compile_expression(wrong, a)
    for name in ("pi", "Sin", "1a", "_a", "a-b"):
        with pytest.raises(ValueError):
            ex.compile_expression("1", {name: F.lit(1.0)})


def _automaton(command, twice):
    """One sign at a time, by a state of quote, level and backtick."""
    out, held, operator = [], "", ""
    single = double = ticked = False
    level = i = 0
    while i < len(command):
        c, rest = command[i], command[i:]
        if c == "\\" and not single and len(rest) > 1:
            held, i = held + rest[:2], i + 2
            continue
        step = 1
        if single:
            single = c != "'"
        elif c == "'" and not double and level == 0:
            single = True
        elif c == '"' and level == 0:
            double = not double
        elif c == "`":
            level, ticked = level + (-1 if ticked else 1), not ticked
        elif rest.startswith("$("):
            level += 1
            if not twice:
                step = 2
        elif c == "(" and level > 0:
            level += 1
        elif c == ")" and level > 0:
            level -= 1
        elif not double and level <= 0 and (op := next((o for o in ("&>>", "&&", "||", "|&", ">>", "&>", "|", ">", "<", ";") if rest.startswith(o)), None)):
            if held.strip():
                out.append((held.strip(), operator, sh.OPERATORS.get(operator, "command")))
            held, operator, i = "", op, i + len(op)
            continue
        held, i = held + rest[:step], i + step
    if held.strip():
        out.append((held.strip(), operator, sh.OPERATORS.get(operator, "command")))
    return out or [(command.strip(), "", "command")]


def test_random_commands_equal_an_automaton():
    rng = random.Random(4)
    parts = ["ls", " ", "a b", "'", '"', "`", "$(", "(", ")", "\\", "\\'", '\\"', "&&", "||", "|", "|&", ">>", ">", "<", "&>", "&>>", ";", "&", "é", "$x"]
    for _ in range(20_000):
        command = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        for twice in (True, False):
            assert sh.cut_command(command, twice) == _automaton(command, twice), command
    assert [s[0] for s in sh.cut_command("echo $(date; (pwd)) && ls", twice=False)] == ["echo $(date; (pwd))", "ls"]


def test_variables_and_kinds(spark):
    rows = [("A=1 B=x=y A=2 git log",), ("-x=1 ls",), ("1a=2 cat f",), ("A=1 B=2",), ("",), (None,), ("  K= rm  -f  x ",), ("odd-name=1 ls",)]
    got = [(r.e.env, r.e.rest, r.k, r.s) for r in spark.createDataFrame(rows, "c string").select(sh.environment(F.col("c")).alias("e"), sh.command_kind(F.col("c")).alias("k"), sh.is_silent(F.col("c")).alias("s")).collect()]
    assert [g[0] for g in got][:4] == [{"A": "2", "B": "x=y"}, {}, {}, {"A": "1", "B": "2"}]
    assert [g[2] for g in got] == ["version_control", "unknown", "unknown", "unknown", "unknown", "unknown", "write", "unknown"]
    assert got[0][1] == "git log" and got[3][1] == "A=1 B=2" and got[6][1] == "rm -f x"
    assert spark.createDataFrame([("mv a b",)], "c string").select(sh.is_silent(F.col("c"))).first()[0] is True


def _lines_of(text, pattern, around):
    """Lines by their character ranges, one by one."""
    lines, at = [], 0
    parts = text.split("\n")
    if len(parts) > 1 and parts[-1] == "":
        parts.pop()
    for p in parts:
        lines.append((at, at + len(p) + 1))
        at += len(p) + 1
    hits = set()
    for m in re.finditer(pattern, text, re.DOTALL | re.MULTILINE):
        a, b = m.start(), max(m.end() - 1, m.start())
        mine = {i for i, (s, e) in enumerate(lines) if s <= b and a < e} or {len(lines) - 1}
        hits |= mine
    near = {j for i in hits for j in range(max(0, i - around), min(len(lines), i + around + 1))}
    return [(j + 1, parts[j][:500], j in hits) for j in sorted(near)]


def test_spans_equal_brute_force(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choices("ab\n ", k=rng.randint(0, 40))) for _ in range(150)] + ["x" * 60_000 + "\nab\n" + "y\n" * 3000 + "b\na", "", "\n", "\n\n"]
    docs = spark.createDataFrame([*enumerate(texts), (9999, None)], "id long, text string")
    for pattern, around in (("a.b", 0), ("a.*?b", 2), ("b\n+a", 1), ("^a$", 1), ("z*", 0), ("a\n", 0)):
        got = {}
        for r in sn.span_lines(docs, pattern, around=around).collect():
            got.setdefault(r.id, []).append((r.number, r.line, r.hit))
        want = {i: _lines_of(t, pattern, around) for i, t in enumerate(texts) if re.search(pattern, t, re.DOTALL | re.MULTILINE)}
        assert {i: sorted(v) for i, v in got.items()} == want
        counts = {r.id: r.n for r in sn.span_counts(docs, pattern).collect()}
        assert counts == {i: len(re.findall(pattern, t, re.DOTALL | re.MULTILINE)) for i, t in enumerate(texts) if i in want}
    assert sn.span_files(docs, "A.B", ignore_case=True).count() == sum(bool(re.search("(?s)a.b", t)) for t in texts)
    assert sn.page(docs.select("id"), ["id"], 5, 3).count() == 5 and [r.id for r in sn.page(docs.select("id"), ["id"], 2, 10_000).collect()] == [0, 1]


def test_a_tail_follows_any_chain_of_pairs(spark):
    n = 10_000
    rows = [("long", i, f"t{i}" if i < n else "", f"t{i - 1}" if i else "") for i in range(n + 1)]
    rows += [("two", 0, "a", ""), ("two", 1, "b", ""), ("two", 2, "", "a"), ("two", 3, "c", "b"), ("two", 4, "", "c"), ("two", 5, "", "")]
    starts = spark.createDataFrame([("long", n), ("two", 4), ("none", 7)], "s string, start int")
    got = {r.s: r.start for r in se.widened_tail(spark.createDataFrame(rows, "s string, at int, uses string, answers string"), starts, "s", "at").collect()}
    assert got == {"long": 0, "two": 0, "none": 7}
    later = spark.createDataFrame([("two", 5)], "s string, start int")
    assert se.widened_tail(spark.createDataFrame(rows, "s string, at int, uses string, answers string"), later, "s", "at").first().start == 5


def test_a_session_that_stopped_stays_so(spark):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate((1000, 1500, 1550, 1600, 2500))], "s int, n int, total int")
    assert [r.go for r in se.continuation(rows, "s", "n", "total", 10_000, 200).orderBy("n").collect()] == [True, True, True, False, False]
    assert [r.go for r in se.continuation(rows, "s", "n", "total", 10_000, 10, limit=2).orderBy("n").collect()] == [True, True, False, False, False]


def test_marks_in_texts_are_plain_signs(spark):
    row = spark.createDataFrame([("a\u0001b\nX\nc",)], "t string").select(ma.apply_patch(F.col("t"), F.lit("X"), F.lit("Y"))).first()
    assert row[0] == "a\u0001b\nY\nc"
    said = rt.sentences(spark.createDataFrame([(1, "One\u0001two. Three!")], "id int, text string")).orderBy("position").collect()
    assert [r.sentence for r in said] == ["One\u0001two.", "Three!"]


def test_examples_are_of_low_success(spark):
    rows = [("t", i, i * 2000, i in (2, 9), f"e{i}") for i in range(12)] + [("u", i, i, False, "x") for i in range(2)]
    df = spark.createDataFrame(rows, "tool string, n int, s long, ok boolean, message string").withColumn("ts", F.timestamp_seconds("s"))
    r = mt.learned_patterns(df, "tool", "ok", "message", "ts", "n").collect()
    assert [(x.tool, x.attempts, x.examples) for x in r] == [("t", 12, ["e3", "e4", "e5", "e6", "e7"])]
