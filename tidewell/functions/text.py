"""Text expressions: tokens, slugs, truncation, patterns."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words that lexical ranking leaves out.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "do", "for", "from", "has", "have", "he", "in",
    "is", "it", "its", "of", "on", "or", "that", "the", "this", "to", "was", "were", "will", "with",
]


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row. What is used inside a lambda function, or more than once
    beside one, is otherwise computed again for each element."""
    return F.transform(F.array(value), body)[0]


def lexical_tokens(text: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """Lower-cased runs of letters and digits of two bytes or more, without stop words."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{Nd}]+")
    return F.filter(parts, lambda t: (F.octet_length(t) >= 2) & ~t.isin(*stop_words))


def keywords(text: Column) -> Column:
    """Lower-cased parts between space, tab, newline, comma and dot that are longer than three bytes."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\n,.]+"), lambda t: F.octet_length(t) > 3)


def query_terms(text: Column) -> Column:
    """A search text without the signs of the query language."""
    return F.trim(F.translate(text, '"()*^-+', "       "))


def namespace_slug(name: Column) -> Column:
    """Letters, digits and hyphens stay, other signs become underscores; 200 characters; never empty."""
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(name, "[^A-Za-z0-9-]", "_"), 1, 200), F.lit("")), F.lit("default"))


def stable_key(name: Column) -> Column:
    """Lower case, runs of other signs than letters and digits become hyphens, none at the ends, 96 long."""
    low = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(low, "^-+|-+$", ""), 1, 96)


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def ellipsis(text: Column, most: int) -> Column:
    """At most ``most`` characters, the last one an ellipsis where something was cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def occurrences(text: Column, part: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    gone = F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))
    return F.floor(gone / len(part))


def line_count(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)


def token_estimate(text: Column, per_token: int = 4) -> Column:
    """Characters over characters a token, at least one."""
    return F.greatest(F.floor(F.length(F.coalesce(text, F.lit(""))) / per_token), F.lit(1))


def byte_token_estimate(text: Column) -> Column:
    return F.floor(F.octet_length(F.coalesce(text, F.lit(""))) / 4)


def human_size(n: Column) -> Column:
    kb, mb = F.lit(1024.0), F.lit(1024.0 * 1024)
    return F.when(n < kb, F.format_string("%d B", n)).when(n < mb, F.format_string("%.1f KB", n / kb)).otherwise(F.format_string("%.1f MB", n / mb))


def strip_tags(html: Column) -> Column:
    """Tags out, the five common entities back to signs."""
    text = F.regexp_replace(html, "<[^>]*>", "")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def glob_pattern(glob: str) -> str:
    """An anchored expression for a path glob: ``**`` crosses segments, ``*`` and ``?`` do not."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i]))
            i += 1
    return f"^{out}$"


def wildcard_pattern(pattern: str) -> str:
    """An anchored, case-insensitive expression where ``*`` is any text and ``?`` one sign."""
    return "(?is)^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "$"


def stable_id(namespace: Column, key: Column) -> Column:
    """An unsigned 64-bit number as text: the first eight bytes of a digest, the last one leading."""
    digest = F.sha2(F.concat(namespace, F.lit("\0"), key).cast("binary"), 256)
    turned = F.concat(*[F.substring(digest, i, 2) for i in range(15, 0, -2)])
    return F.conv(turned, 16, 10)


def object_key(kind: str, corpus: Column, name: Column) -> Column:
    """kind/corpus/name, signs that file names don't take as underscores."""
    clean = lambda c: F.regexp_replace(c, "[^A-Za-z0-9._-]", "_")
    return F.concat_ws("/", F.lit(kind), clean(corpus), clean(name))


def host_of(url: Column) -> Column:
    """Host of an address in lower case, without a leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, "^[A-Za-z]+://([^/?#:]+)", 1)), r"^www\.", "")


def normal_url(url: Column) -> Column:
    """The address with https; null for other schemes, empty hosts and local targets."""
    local = url.rlike(r"^https?://(localhost|127\.|10\.|192\.168\.|\[::1\])")
    return F.when(url.rlike("^https?://[^/]") & ~local, F.regexp_replace(url, "^http://", "https://"))


def snip(text: Column, most: int) -> Column:
    """Longer texts by their first and last halves of ``most`` characters."""
    half = most // 2
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, half), F.lit(" [...] "), F.right(text, F.lit(half)))).otherwise(text)


def fold_quotes(text: Column) -> Column:
    """Line feeds alone as line ends, straight quotes."""
    return F.translate(F.replace(text, F.lit("\r\n"), F.lit("\n")), "‘’“”", "''\"\"")


# Names that an expression gives a meaning to.
BUILT_IN = ["pi", "PI", "e", "E", "sin", "cos", "tan", "asin", "acos", "atan", "log", "ln", "abs", "sqrt", "pow", "exp", "factorial"]


def variables(text: Column) -> Column:
    """Distinct identifiers of an expression but the built-in ones, in order of their names."""
    found = F.regexp_extract_all(text, F.lit(r"\b[a-zA-Z_][a-zA-Z0-9_]*\b"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: ~x.isin(*BUILT_IN))))
