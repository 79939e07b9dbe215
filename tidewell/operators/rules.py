"""Permission rules, approved hosts, classes of errors and checks of records."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Classes of error messages, the first one that fits, and what to do about them.
ERROR_CLASSES = {"permission": ["permission denied"], "not_found": ["not found", "no such file"], "timeout": ["timeout"], "connection": ["connection"], "invalid": ["invalid"], "generic": ["failed", "error"]}
SUGGESTIONS = {
    "permission": "Check file permissions or run with appropriate access",
    "not_found": "Verify the file path exists before operation",
    "timeout": "Check network connectivity or increase timeout",
    "connection": "Verify the service is running and accessible",
    "invalid": "Check input format and parameters",
}
OTHER_SUGGESTION = "Review error details and try again"
# States that are tried again.
RETRYABLE = [408, 409, 429, 500, 502, 503, 504]


def escape_wildcards(rule: Column) -> Column:
    """An anchored expression for a rule: a star is any text of one line, a backslash takes the next sign
    as it is."""
    quoted = F.regexp_replace(rule, r"([.+?^${}()|\[\]])", r"\\$1")
    # "\*" stays a literal star, a bare star becomes any text
    return F.concat(F.lit("^"), F.regexp_replace(quoted, r"(?<!\\)\*", ".*"), F.lit("$"))


def rule_fits(rule: Column, candidate: Column) -> Column:
    """``prefix:*`` takes the prefix alone or followed by a blank; other rules with a star are wildcards;
    the rest must be equal. Empty rules and candidates fit nothing."""
    rule, candidate = F.trim(rule), F.trim(candidate)
    prefix = F.regexp_replace(rule, r":\*$", "")
    legacy = rule.endswith(":*") & (F.length(rule) > 2)
    starred = rule.rlike(r"(?<!\\)\*")
    fit = F.when(legacy, (candidate == prefix) | candidate.startswith(F.concat(prefix, F.lit(" ")))).when(starred, F.regexp_like(candidate, escape_wildcards(rule))).otherwise(candidate == rule)
    return F.coalesce((rule != "") & (candidate != "") & fit, F.lit(False))


def first_rule(calls: DataFrame, rules: DataFrame, behaviour: str) -> DataFrame:
    """(call_id, rule_id): of the rules (rule_id, seq, priority, behaviour, tool, content) with this
    behaviour that name the call's tool and have no content or fit the call's, the one of the highest
    priority, then the first. Rules are joined by tool and one is kept by partial aggregation."""
    some = rules.filter(F.col("behaviour") == behaviour)
    met = calls.join(some, "tool").filter((F.trim("content") == "") | rule_fits(F.col("content"), F.col("candidate")))
    return met.groupBy("call_id").agg(F.min_by("rule_id", F.struct(-F.col("priority"), "seq")).alias("rule_id"))


def name_fits(name: Column, patterns: list[str]) -> Column:
    """Any pattern fits: a star, the name itself, ``begin*`` or ``*end``."""
    tests = [F.lit(True) if p == "*" else (name == p) | (name.startswith(p[:-1]) if len(p) > 1 and p.endswith("*") else F.lit(False)) | (name.endswith(p[1:]) if len(p) > 1 and p.startswith("*") else F.lit(False)) for p in patterns]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def approved(places: DataFrame, hosts: DataFrame, prefixes: DataFrame) -> DataFrame:
    """places (id, host, path) whose host is in ``hosts`` (host), or has a prefix (host, prefix) that the
    path equals or continues with a slash."""
    whole = places.join(hosts.select("host").distinct(), "host", "left_semi").select("id")
    part = places.join(prefixes, "host").filter((F.col("path") == F.col("prefix")) | F.col("path").startswith(F.concat("prefix", F.lit("/")))).select("id")
    return whole.union(part).distinct()


def base_folder(pattern: str) -> tuple[str, str]:
    """(folder, rest) of a glob: the folder before the first special sign."""
    special = re.search(r"[*?\[{]", pattern)
    if not special:
        folder, _, name = pattern.rpartition("/")
        return (folder or ("/" if pattern.startswith("/") else ".")), name
    at = max(pattern.rfind("/", 0, special.start()), pattern.rfind("\\", 0, special.start()))
    if at < 0:
        return "", pattern
    folder = pattern[:at] or ("/" if at == 0 else "")
    return folder + "/" if len(folder) == 2 and folder.endswith(":") else folder, pattern[at + 1 :]


def error_class(message: Column) -> Column:
    low = F.lower(message)
    out = F.when(F.lit(False), "")
    for name, parts in ERROR_CLASSES.items():
        out = out.when(reduce(lambda a, b: a | b, [low.contains(p) for p in parts]), name)
    return out.otherwise("unknown")


def suggestion(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in SUGGESTIONS.items() for x in kv])[kind], F.lit(OTHER_SUGGESTION))


def retry_class(status: Column) -> Column:
    """Class of a response by its status."""
    named = F.when(status == 429, "rate_limit").when(status.isin(503, 504), "server_overload").when(status == 408, "timeout").when(status == 500, "server_error")
    named = named.when(status == 400, "client_error").when(status == 404, "model_deprecated").when(status.isin(401, 403), "auth_error")
    return named.when(status.between(500, 599), "server_error").when(status.between(400, 499), "client_error").otherwise("unknown")


def diff_shaped(text: Column) -> Column:
    """Whether a text is a unified diff: a hunk's head, or the heads of both files, at the start of a line."""
    heads = text.rlike("(?m)^--- ") & text.rlike(r"(?m)^\+\+\+ ")
    return F.coalesce(text.rlike("(?m)^@@ -[0-9]") | heads, F.lit(False))


def record_problem(record: Column, fields: dict[str, str], required: list[str], allowed: dict[str, list[str]] | None = None) -> Column:
    """What is wrong with a JSON record, null if nothing: required fields first, then the kinds of the
    named fields (string, number, boolean), then the values allowed. Nulls and unknown fields pass."""
    value = lambda k: F.get_json_object(record, f"$.{k}")
    kind = lambda k: F.schema_of_variant(F.try_variant_get(F.try_parse_json(record), f"$.{k}", "variant"))
    out = F.when(F.try_parse_json(record).isNull(), "not a record")
    for k in required:
        out = out.when(value(k).isNull(), f"missing {k}")
    for k, want in fields.items():
        ok = {"string": kind(k) == "STRING", "number": kind(k).rlike("BIGINT|DOUBLE|DECIMAL"), "boolean": kind(k) == "BOOLEAN"}[want]
        out = out.when(value(k).isNotNull() & ~ok, f"{k}: expected {want}")
    for k, values in (allowed or {}).items():
        out = out.when(value(k).isNotNull() & ~value(k).isin(*values), f"{k}: not allowed")
    return out


def shell_segments(command: Column) -> Column:
    """Parts of a command between ; && || | and line ends outside quotes. Quoted stretches are taken as
    whole signs by the expression, so nothing is cut inside them."""
    part = r"""(?:'[^']*'|"(?:\\.|[^"\\])*"|\$\([^)]*\)|`[^`]*`|\\.|[^;&|\n'"\\`])+"""
    return F.filter(F.transform(F.regexp_extract_all(command, F.lit(part), F.lit(0)), lambda s: F.trim(s)), lambda s: s != "")
