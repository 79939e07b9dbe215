"""Shell commands in parts: segments between operators, leading variables and kinds of command."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Operators with what the segment after them is, and the commands of each kind.
OPERATORS = {
    "&&": "logical", "||": "logical", "|&": "pipe", "|": "pipe", ">>": "redirection", "&>>": "redirection", "&>": "redirection", ">": "redirection", "<": "redirection", ";": "sequential",
}
KINDS = {
    "read": "cat head tail less more ls tree du stat file wc which whereis locate diff echo printf pwd env printenv type command",
    "search": "grep rg ag ack find fd",
    "write": "mv cp mkdir touch rm chmod chown chgrp ln tee dd truncate install rename rmdir",
    "state_change": "cd export unset source .",
    "version_control": "git svn hg fossil",
}
SILENT = "mv cp rm mkdir rmdir chmod chown chgrp touch ln cd export unset wait"

#: Signs that change what follows, longest operators first; all other stretches are plain.
SIGNS = re.compile(r"\\.|\$\(|['\"`()]|" + "|".join(map(re.escape, sorted(OPERATORS, key=len, reverse=True))), re.DOTALL)
SEGMENT = "text string, operator string, kind string"


def cut_command(command: str, twice: bool = True) -> list[tuple[str, str, str]]:
    """(text, operator before it, kind) of a command's segments.

    Operators inside quotes, backticks and ``$( )`` cut nothing; inside a substitution quotes are plain
    signs. With ``twice`` a ``$(`` opens two levels, as the format has it, so that only a second closing
    sign ends it; without, it closes as it was opened. A command without any segment is one whole.
    """
    out, start, operator = [], 0, ""
    quote, level, ticked = "", 0, False

    def close(end: int) -> None:
        text = command[start:end].strip()
        if text:
            out.append((text, operator, OPERATORS.get(operator, "command")))

    for m in SIGNS.finditer(command):
        sign = m.group()
        if quote == "'":
            # a backslash is plain here, so the quote it stands before counts
            if sign[-1] == "'":
                quote = ""
        elif sign[0] == "\\":
            continue
        elif sign in "'\"" and level == 0 and quote in ("", sign):
            quote = "" if quote else sign
        elif sign == "`":
            level, ticked = level + (-1 if ticked else 1), not ticked
        elif sign == "$(":
            level += 1
            level += 1 if twice and level > 0 else 0
        elif sign in "()":
            level += (1 if sign == "(" else -1) if level > 0 else 0
        elif sign in OPERATORS and not quote and level <= 0:
            close(m.start())
            start, operator = m.end(), sign
    close(len(command))
    return out or [(command.strip(), "", "command")]


def segments(command: Column, twice: bool = True) -> Column:
    """array<struct<text, operator, kind>> of a command; null for null."""

    @F.pandas_udf(f"array<struct<{SEGMENT.replace(' string', ':string')}>>")
    def cut(commands: pd.Series) -> pd.Series:
        return commands.map(lambda c: None if c is None else [dict(zip(("text", "operator", "kind"), s, strict=True)) for s in cut_command(c, twice)])

    return cut(command)


def environment(command: Column) -> Column:
    """struct<env: map, rest>: leading NAME=value words, the last of a name counting, and the words from the
    first other one on, joined by blanks; a command of such words alone is its own rest."""
    words = F.filter(F.split(command, r"\s+"), lambda w: w != "")
    is_name = lambda w: w.rlike(r"^[A-Za-z_][A-Za-z0-9_]*=")
    flags = F.transform(words, lambda w, i: F.when(~is_name(w), i))
    n = F.coalesce(F.array_min(F.filter(flags, lambda i: i.isNotNull())), F.size(words))
    named = F.transform(F.slice(words, 1, n), lambda w: F.struct(F.substring_index(w, "=", 1).alias("k"), F.substring(w, F.locate("=", w) + 1, F.length(w)).alias("v")))
    # an earlier value of a name is left out where a later one stands
    last = F.filter(F.transform(named, lambda x, i: F.struct(x["k"].alias("k"), x["v"].alias("v"), i.alias("i"))), lambda x: ~F.exists(F.slice(named, x["i"] + 2, F.size(named)), lambda y: y["k"] == x["k"]))
    env = F.map_from_arrays(F.transform(last, lambda x: x["k"]), F.transform(last, lambda x: x["v"]))
    rest = F.when(n < F.size(words), F.array_join(F.slice(words, n + 1, F.size(words)), " ")).otherwise(command)
    return F.struct(env.alias("env"), rest.alias("rest"))


def command_kind(command: Column) -> Column:
    """read, search, write, state_change, version_control or unknown, by the first word after variables."""
    first = F.get(F.filter(F.split(environment(command)["rest"], r"\s+"), lambda w: w != ""), F.lit(0))
    out = F.when(F.lit(False), "")
    for kind, names in KINDS.items():
        out = out.when(first.isin(*names.split()), kind)
    return out.otherwise("unknown")


def is_silent(command: Column) -> Column:
    """Whether a command prints nothing when all is well, by its very first word."""
    first = F.get(F.filter(F.split(command, r"\s+"), lambda w: w != ""), F.lit(0))
    return F.coalesce(first.isin(*SILENT.split()), F.lit(False))
