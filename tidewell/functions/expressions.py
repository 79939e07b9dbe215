"""Arithmetic expressions compiled to columns.

A precedence parser reads an expression once and builds the column as it goes. From weakest to strongest:
``? :`` (to the right), ``||``, ``&&``, comparisons, ``+ -``, ``* / %``, the signs ``- !``, and powers ``**``
or ``^`` (to the right, so -2 ** 2 is -(2 ** 2)); ``x!`` is a factorial. Whatever has no value - a division by
zero, an argument outside a function's domain, a result that is endless - is null, unless a branch that is
not taken holds it.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions import maths

TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([A-Za-z_]\w*)|(\*\*|==|!=|<=|>=|&&|\|\||[-+*/%^()<>!?:,]))")
CONSTANTS = {"pi": F.pi, "PI": F.pi, "e": F.e, "E": F.e}
BINARY = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "*": 5, "/": 5, "%": 5}
SIGN, POWER = 6, 7


class Typed(NamedTuple):
    """A column that is a number or a truth."""

    column: Column
    truth: bool = False


def _number(x: Typed, what: str) -> Column:
    if x.truth:
        raise ValueError(f"{what} needs a number")
    return x.column


def _truth(x: Typed, what: str) -> Column:
    if not x.truth:
        raise ValueError(f"{what} needs a comparison")
    return x.column


def _finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


class _Parser:
    def __init__(self, text: str, variables: dict[str, Column]):
        self.variables, self.tokens, self.at = variables, [], 0
        end = len(text.rstrip())
        place = 0
        while place < end:
            m = TOKEN.match(text, place)
            if not m:
                raise ValueError(f"unexpected sign at {place} of {text!r}")
            self.tokens.append(("number", m[1]) if m[1] else ("name", m[2]) if m[2] else ("sign", m[3]))
            place = m.end()

    def peek(self) -> str | None:
        kind, said = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        return said if kind == "sign" else None

    def take(self, sign: str) -> None:
        if self.peek() != sign:
            raise ValueError(f"expected {sign!r} after {self.tokens[: self.at]}")
        self.at += 1

    def conditional(self) -> Typed:
        test = self.binary(1)
        if self.peek() != "?":
            return test
        self.take("?")
        yes = self.conditional()
        self.take(":")
        no = self.conditional()
        if yes.truth != no.truth:
            raise ValueError("both branches must be of one kind")
        asked = _truth(test, "?")
        return Typed(F.when(asked, yes.column).when(~asked, no.column), yes.truth)

    def binary(self, least: int) -> Typed:
        left = self.sign()
        while (sign := self.peek()) in BINARY and BINARY[sign] >= least:
            self.at += 1
            left = self.join(sign, left, self.binary(BINARY[sign] + 1))
        return left

    def join(self, sign: str, left: Typed, right: Typed) -> Typed:
        if sign in ("&&", "||"):
            a, b = _truth(left, sign), _truth(right, sign)
            # the right side is looked at only where the left one doesn't decide
            return Typed(F.when(a, b).when(~a, F.lit(False)) if sign == "&&" else F.when(a, F.lit(True)).when(~a, b), True)
        if sign in ("==", "!=") and left.truth and right.truth:
            same = left.column == right.column
            return Typed(same if sign == "==" else ~same, True)
        a, b = _number(left, sign), _number(right, sign)
        if BINARY[sign] == 3:
            return Typed({"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[sign], True)
        made = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.when(b != 0, a / b), "%": lambda: F.when(b != 0, a % b)}[sign]
        return Typed(_finite(made()))

    def sign(self) -> Typed:
        sign = self.peek()
        if sign == "-":
            self.at += 1
            return Typed(-_number(self.sign(), "-"))
        if sign == "!":
            self.at += 1
            return Typed(~_truth(self.sign(), "!"), True)
        return self.power()

    def power(self) -> Typed:
        base = self.factor()
        if self.peek() not in ("**", "^"):
            return base
        self.at += 1
        # the exponent may have a sign, and powers in it come first
        return Typed(maths.function("pow", _number(base, "a power"), _number(self.sign(), "a power")))

    def factor(self) -> Typed:
        x = self.primary()
        while self.peek() == "!":
            self.at += 1
            x = Typed(maths.function("factorial", _number(x, "!")))
        return x

    def primary(self) -> Typed:
        if self.at == len(self.tokens):
            raise ValueError("the expression ends too soon")
        kind, said = self.tokens[self.at]
        if kind == "number":
            self.at += 1
            return Typed(F.lit(float(said)))
        if kind == "name":
            self.at += 1
            return self.call(said) if self.peek() == "(" else self.named(said)
        self.take("(")
        inside = self.conditional()
        self.take(")")
        return inside

    def named(self, name: str) -> Typed:
        if name in self.variables:
            x = self.variables[name].cast("double")
            return Typed(_finite(x))
        if name in CONSTANTS:
            return Typed(CONSTANTS[name]())
        raise ValueError(f"unknown name {name!r}")

    def call(self, name: str) -> Typed:
        if name not in maths.FUNCTIONS:
            raise ValueError(f"unknown function {name!r}")
        self.take("(")
        given = [_number(self.conditional(), name)]
        while self.peek() == ",":
            self.take(",")
            given.append(_number(self.conditional(), name))
        self.take(")")
        if len(given) != (2 if name == "pow" else 1):
            raise ValueError(f"{name} has {len(given)} arguments")
        return Typed(maths.function(name, *given))


def compile_expression(text: str, variables: dict[str, Column]) -> Column:
    """The value of an expression over columns as a double; null where it has none. An expression that is
    empty, malformed or a truth raises a ValueError."""
    for name in variables:
        if not re.fullmatch(r"[A-Za-z]\w*", name, re.ASCII) or name.lower() in {n.lower() for n in (*CONSTANTS, *maths.FUNCTIONS)}:
            raise ValueError(f"variable name {name!r}")
    parser = _Parser(text, variables)
    value = parser.conditional()
    if parser.at != len(parser.tokens):
        raise ValueError(f"cannot read {parser.tokens[parser.at :]}")
    return _finite(_number(value, "the result"))
