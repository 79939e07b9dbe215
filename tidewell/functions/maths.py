"""Arithmetic over operands, guarded functions, expressions with variables, hashes and line patches."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions import text as tx

# Names of an expression and the Spark functions that stand for them.
FUNCTIONS = {"sin": "sin", "cos": "cos", "tan": "tan", "asin": "asin", "acos": "acos", "atan": "atan", "log": "log10", "ln": "ln", "abs": "abs", "sqrt": "sqrt", "pow": "pow", "exp": "exp", "factorial": "factorial"}
CONSTANTS = {"pi": "pi()", "PI": "pi()", "e": "e()", "E": "e()"}
EXACT = "decimal(38,18)"


def half_away(value: Column, precision: int) -> Column:
    """Rounded to ``precision`` digits, halves away from zero."""
    scale = 10.0**precision
    return F.signum(value) * F.floor(F.abs(value) * scale + 0.5) / scale


def arithmetic(operation: str, operands: list[Column], precision: int = 0) -> Column:
    """add, subtract, multiply or divide two operands or more, in decimals, rounded at the end; null where
    a divisor is zero."""
    if len(operands) < 2:
        raise ValueError("at least two operands")
    if operation == "divide":
        exact = reduce(lambda a, b: F.try_divide(a, b), [c.cast("double") for c in operands])
    else:
        step = {"add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "multiply": lambda a, b: (a * b).cast(EXACT)}[operation]
        exact = reduce(step, [c.cast(EXACT) for c in operands])
    return half_away(exact.cast("double"), precision)


def function(name: str, x: Column, exponent: Column | None = None, degrees: bool = False) -> Column:
    """A function of one value, null outside its domain. With ``degrees`` angles are in degrees."""
    angle = F.radians(x) if degrees else x
    back = (lambda c: F.degrees(c)) if degrees else (lambda c: c)
    whole = (x >= 0) & (x == F.floor(x)) & (x <= 170)
    product = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.when(whole, x).otherwise(1).cast("int"))), F.lit(1.0), lambda a, i: a * i)
    ways = {
        "sin": lambda: F.sin(angle), "cos": lambda: F.cos(angle), "tan": lambda: F.tan(angle), "abs": lambda: F.abs(x), "atan": lambda: back(F.atan(x)),
        "asin": lambda: F.when(x.between(-1, 1), back(F.asin(x))), "acos": lambda: F.when(x.between(-1, 1), back(F.acos(x))), "log": lambda: F.when(x > 0, F.log10(x)), "ln": lambda: F.when(x > 0, F.log(x)),
        "sqrt": lambda: F.when(x >= 0, F.sqrt(x)), "exp": lambda: F.when(x <= 700, F.exp(x)), "factorial": lambda: F.when(whole, product),
        "pow": lambda: F.when(~(((x == 0) & (exponent < 0)) | ((x < 0) & (exponent != F.floor(exponent)))), F.pow(x, exponent)),
    }
    out = ways[name]()
    return F.when(~F.isnan(out) & (F.abs(out) < float("inf")), out)


def evaluate(expression: str, variables: dict[str, str]) -> Column:
    """A Spark expression for an arithmetic one over columns: ``variables`` names the column of each.
    Only numbers, + - * / % ( ) ,, powers (** or ^) of simple terms, the known functions and constants
    pass; anything else raises a ValueError."""
    if not re.fullmatch(r"[\w\s.+\-*/%^(),]+", expression):
        raise ValueError(f"signs in {expression!r}")

    def name(m: re.Match) -> str:
        word = m.group(0)
        if word in variables:
            return f"`{variables[word]}`"
        if word in CONSTANTS:
            return CONSTANTS[word]
        if word in FUNCTIONS:
            return FUNCTIONS[word]
        raise ValueError(f"unknown name {word!r}")

    term = r"(\([^()]*\)|[\w.`]+)"
    out = expression.replace("**", "^")
    while (new := re.sub(term + r"\s*\^\s*" + term, r"pow(\1,\2)", out, count=1)) != out:
        out = new
    return F.expr(re.sub(r"(?<![\w.])[A-Za-z_]\w*", name, out)).cast("double")


def fnv32(text: Column) -> Column:
    """32-bit hash of the bytes: each byte is taken in by exclusive or, then multiplied by the prime."""
    raw = F.hex(text.cast("binary"))
    places = F.sequence(F.lit(1), F.length(raw) - 1, F.lit(2))
    byte = lambda i: F.conv(F.substring(raw, i, F.lit(2)), 16, 10).cast("long")
    step = lambda h, i: (h.bitwiseXOR(byte(i)) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    start = F.lit(2166136261).cast("long")
    return F.when(F.length(raw) > 0, F.aggregate(places, start, step)).otherwise(start)


def line_patch(old: Column, new: Column, context: int = 3) -> Column:
    """struct<old_start, old_lines, new_lines, lines>: one hunk between the common first and last lines of
    two texts, with lines around it; null where they are equal."""
    cut = lambda c: F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(c, "\n$", ""), "\n"))
    same = lambda x, y, n: F.coalesce(F.nullif(F.array_position(F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda p, q: p != q), True), F.lit(0)) - 1, n).cast("int")
    part = lambda x, lo, hi, sign: F.transform(F.slice(x, lo + 1, F.greatest(hi - lo, F.lit(0))), lambda s: F.concat(F.lit(sign), s))

    def hunk(a: Column, b: Column, head: Column, tail: Column) -> Column:
        first, end_a, end_b = F.greatest(F.lit(0), head - context), F.size(a) - tail, F.size(b) - tail
        last_a, last_b = F.least(F.size(a), end_a + context), F.least(F.size(b), end_b + context)
        lines = F.concat(part(a, first, head, " "), part(a, head, end_a, "-"), part(b, head, end_b, "+"), part(b, end_b, last_b, " "))
        return F.struct((first + 1).alias("old_start"), (last_a - first).alias("old_lines"), (last_b - first).alias("new_lines"), lines.alias("lines"))

    def ends(a: Column, b: Column) -> Column:
        least = F.least(F.size(a), F.size(b))
        return tx.bound(same(a, b, least), lambda head: tx.bound(F.least(same(F.reverse(a), F.reverse(b), least), least - head), lambda tail: hunk(a, b, head, tail)))

    return F.when(old != new, tx.bound(F.struct(cut(old).alias("a"), cut(new).alias("b")), lambda x: ends(x["a"], x["b"])))


def apply_patch(text: Column, search: Column, replace: Column) -> Column:
    """The text with the first block of whole lines that equals ``search`` replaced; null where there is
    none. An empty search puts the lines in front."""
    # between line ends, so that only whole lines are found
    lined = lambda c: F.concat(F.lit("\n"), c, F.lit("\n"))
    at = F.call_function("locate", lined(search), lined(text))
    kept = F.concat(F.substring(text, F.lit(1), at - 1), replace, F.substring(text, at + F.length(search), F.length(text)))
    return F.when(search == "", F.concat(replace, F.lit("\n"), text)).when(at > 0, kept)
