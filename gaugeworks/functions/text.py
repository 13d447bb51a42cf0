"""Text and JSON expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ends a line, besides the line feed.
_BREAKS = "(?:\\r\\n|[\\n\\r\\u000B\\f\\u001C\\u001D\\u001E\\u0085\\u2028\\u2029])"

#: Publication rules for secrets, by name.
SECRET_RULES = {
    "private key": r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----",
    "provider token": r"\bsk-(?:(?:proj|svcacct|ant-api\d+|or-v1)-)?[A-Za-z0-9_-]{24,}",
    "GitHub token": r"\b(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{40,})",
    "AWS access key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "Google API key": r"\bAIza[A-Za-z0-9_-]{35}\b",
    "Slack token": r"\bxox[baprs]-[A-Za-z0-9-]{20,}",
    # An extension: quoted literals of long hexadecimal digits bound to a telling name.
    "named_literal": r"(?:token|secret|password)\s*=\s*\"[0-9a-f]{32,}\"",
}
#: What each match of a pattern holds one of: looked for first, as most texts have none.
_HELD = {
    SECRET_RULES[rule]: held
    for rule, held in {
        "private key": ("PRIVATE KEY-----",), "provider token": ("sk-",), "GitHub token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"),
        "AWS access key": ("AKIA", "ASIA"), "Google API key": ("AIza",), "Slack token": ("xox",), "named_literal": ("token", "secret", "password"),
    }.items()
}
#: What a message holds that tells of a rate limit; what is never published, by patterns of a file's lower-cased name and of its path.
RATE_LIMITS = ("rate limit", "rate_limit", "429", "too many requests", "overloaded", "capacity", "quota")
PRIVATE = (
    ("name", r"^\.env(?:\.(?!example\z)|\z)"), ("name", r"(?s).\.(?:pem|key|p12|pfx)\z"), ("name", r"^(?:credentials\.json|\.ds_store)\z"), ("name", r"(?s)^service-account.*\.json\z"),
    ("path", r"(?:^|/)(?:\.local|\.venv|__pycache__|\.pytest_cache|\.mypy_cache|\.ruff_cache)(?:/|\z)"), ("path", r"^tasks/[^/]*/runs(?:/|\z)"),
)


def lines(text: Column) -> Column:
    """The lines of a text, whatever ends them; a last end makes no line."""
    parts = F.split(text, _BREAKS, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def normalise(text: Column) -> Column:
    """White space runs as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def stripped(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def indent(text: Column) -> Column:
    """Characters of white space that a line starts with."""
    return F.length(F.regexp_extract(text, r"(?U)^\s*", 0))


def any_prefix(path: Column, prefixes: Sequence[str]) -> Column:
    """Whether ``path`` starts with one of ``prefixes``."""
    return F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(path, p)) if prefixes else F.lit(False)


def is_blank(text: Column) -> Column:
    return normalise(text) == ""


def word_set(x: Column) -> Column:
    """The distinct words of a line."""
    return F.array_distinct(F.regexp_extract_all(x, F.lit(r"(?U)\w+"), F.lit(0)))


def token_overlap(gone: Column, kept: Column) -> Column:
    """Share of the distinct words of ``gone`` that stand in ``kept``; 1 if it has none."""
    mine = word_set(gone)
    return F.when(F.size(mine) == 0, 1.0).otherwise(F.size(F.array_intersect(mine, word_set(kept))) / F.size(mine))


def json_object(text: Column) -> Column:
    """The JSON object in a reply, as a variant: of each fenced part, then of the whole, from the first
    opening to the last closing brace; the first that parses to an object."""
    fenced = F.regexp_extract_all(text, F.lit(r"(?s)```(?:json)?\s*(.*?)```"), F.lit(1))
    spans = F.transform(F.concat(fenced, F.array(text)), lambda t: F.regexp_extract(t, r"(?s)\{.*\}", 0))
    parsed = F.transform(spans, lambda t: F.try_parse_json(F.nullif(t, F.lit(""))))
    return F.element_at(F.filter(F.concat(parsed, F.array(F.lit(None).cast("variant"))), lambda v: v.isNull() | F.schema_of_variant(v).startswith("OBJECT")), 1)


def last_error(text: Column) -> Column:
    """The last line that starts with `E ` without that mark, else the last line."""
    own = F.filter(lines(text), lambda x: ~is_blank(x))
    marked = F.filter(own, lambda x: x.startswith("E "))
    return F.when(F.size(marked) > 0, F.trim(F.substr(F.element_at(marked, -1), F.lit(2)))).when(F.size(own) > 0, F.trim(F.element_at(own, -1)))


def shortened(text: Column, limit: int, mark: str = "\n[...]\n") -> Column:
    """Three quarters of the limit from the start and one from the end."""
    head = limit * 3 // 4
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(head)), F.lit(mark), F.right(text, F.lit(limit - head))))


def secret_hits(text: Column, rules: dict[str, str] = SECRET_RULES) -> Column:
    """array<struct<rule, nth, line, match>>: each rule's own matches without overlap and the lines they start on."""
    none = F.array().cast("array<struct<rule:string,nth:bigint,line:bigint,match:string>>")
    breaks = lambda s: F.length(s) - F.length(F.replace(s, F.lit("\n")))

    def of(rule: str, pattern: str) -> Column:
        def step(a: Column, x: Column) -> Column:
            # One pass: each match takes the line that the texts before it have come to.
            line = a["line"] + breaks(x["before"])
            hit = F.struct(F.lit(rule).alias("rule"), (F.size(a["hits"]) + 1).cast("long").alias("nth"), line.alias("line"), x["match"].alias("match"))
            return F.struct((line + breaks(x["match"])).alias("line"), F.concat(a["hits"], F.array(hit)).alias("hits"))

        def hits(found: Column) -> Column:
            start = F.struct(F.lit(1).cast("long").alias("line"), none.alias("hits"))
            each = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, lambda before, match: F.struct(before.alias("before"), match.alias("match")))
            return F.when(F.size(found) == 0, none).otherwise(F.aggregate(each, start, step, lambda a: a["hits"]))

        # By a lambda, so that the matches are found once, however often they are named.
        every = F.transform(F.array(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), hits)[0]
        held = [F.contains(text, F.lit(x)) for x in _HELD.get(pattern, ())]
        return F.when(~reduce(Column.__or__, held), none).otherwise(every) if held else every

    return F.concat(*(of(k, p) for k, p in rules.items()))


def usage(reply: Column) -> Column:
    """struct(input_tokens, output_tokens, cache_read, cache_write) of a call's JSON; a count that is none is null."""
    v = F.try_parse_json(reply)
    get = lambda k: F.try_variant_get(v, f"$.usage.{k}", "bigint")
    return F.when(v.isNotNull(), F.struct(*(get(k).alias(k) for k in ("input_tokens", "output_tokens", "cache_read", "cache_write"))))


def exit_code(recorded: Column, sentence: Column) -> Column:
    """The exit code of a run: as recorded, else the number that its reason names."""
    return F.coalesce(recorded, F.regexp_extract(sentence, r"exit(?: code| status)?\D{0,3}(\d+)", 1).try_cast("bigint"))


def links(text: Column) -> Column:
    """Targets of markdown links and of src, srcset and href attributes outside fenced code, in order of kind."""
    prose = F.regexp_replace(text, r"(?s)```.*?```", "")
    return F.concat(
        F.regexp_extract_all(prose, F.lit(r"\]\(([^)\s]+)[^)]*\)"), F.lit(1)), F.regexp_extract_all(prose, F.lit(r"""(?:src|srcset|href)\s*=\s*["']([^"']+)["']"""), F.lit(1))
    )


def is_local(link: Column) -> Column:
    return ~link.rlike(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:|//|#)")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def digest12(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 12)


def rate_limited(message: Column) -> Column:
    low = F.lower(message)
    return F.exists(F.array(*map(F.lit, RATE_LIMITS)), lambda m: F.contains(low, m))


def private_path(path: Column) -> Column:
    """Whether a file is none to publish, by the rules of ``PRIVATE``."""
    of = {"name": F.lower(basename(path)), "path": path}
    return reduce(Column.__or__, (of[part].rlike(pattern) for part, pattern in PRIVATE))


def summarised(text: Column, limit: int = 4000, keep: int = 200) -> Column:
    """A long argument as its length, hash, head and tail; null for one that is short enough."""
    made = F.struct(F.length(text).alias("length"), F.sha2(text, 256).alias("sha256"), F.left(text, F.lit(keep)).alias("head"), F.right(text, F.lit(keep)).alias("tail"))
    return F.when(F.length(text) > limit, made)


def age_seconds(created: Column, now: Column) -> Column:
    """Seconds since a time like `2026-01-02 03:04:05 +0000 UTC`; null if it can't be read."""
    t = F.try_to_timestamp(F.regexp_extract(created, r"^(\S+ \S+ [+-]\d{4})", 1), F.lit("yyyy-MM-dd HH:mm:ss Z"))
    return F.unix_timestamp(now) - F.unix_timestamp(t)
