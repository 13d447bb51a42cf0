"""Pull requests judged as tasks: whether one adapted a library to a new version, from what it changed and what its base tested.

What was fetched lies in three tables; everything is counted by pull request, nothing is asked of a host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

#: Addresses; files that are no library, tests among them; where continuous integration is declared; services by the words that name them.
PULL = r"github\.com/([^/\s]+)/([^/\s]+)/pull/(\d+)"
NON_SOURCE = r"(^|/)(tests?|testing|docs?|examples?)/|\.(rst|md|txt|cfg|toml|ini|yml|yaml|lock)$|(^|/)(CHANGELOG|CHANGES|HISTORY|AUTHORS|MANIFEST)"
TEST_FILE = r"(^|/)tests?/|(^|/)test_"
CI_PATHS = (".github/workflows", ".travis.yml", "tox.ini", "azure-pipelines.yml", ".circleci/config.yml", "noxfile.py")
SERVICES = ("mongodb", "postgres", "postgresql", "mysql", "mariadb", "redis", "memcached", "elasticsearch", "rabbitmq", "kafka", "services:", "docker-compose")
#: Files with pins, those that name the package, names in their lines, a title's first word, sections and numbers of versions.
PIN_FILE = r"(setup\.py|pyproject\.toml|setup\.cfg|requirements.*\.txt|tox\.ini)$"
NAMING_FILE = r"(setup\.py|pyproject\.toml|setup\.cfg|requirements.*\.txt)$"
PIN_NAME = r"""(?U)['"]?([A-Za-z][\w.-]{2,})\s*(?:[><=~!]=|['"]?\s*$)"""
BOUND_NAME = r"""(?U)['"]?([A-Za-z][\w.-]{2,})\s*[><=~!]="""
TITLE_NAME = r"(?U)^\W*([A-Za-z][\w.-]{2,})\b"
PYTHON_SECTION = r"(?is)python[-_ ]?versions?\s*:(.*?)(\n\S|\z)"
PYTHON_VERSION = r"""['"]?(\d\.\d{1,2})['"]?"""
MATRIX = r"(?i)envlist|matrix|strategy"
OLD_PYTHON = r"^(2\.|3\.0|3\.1 |3\.2|3\.3|3\.4|3\.5|3\.6)"
RECENT_PYTHON = ("3.9", "3.10", "3.11", "3.12", "3.13")
#: Source lines under which a task is small; lines of a matrix that are read; characters of a line that are shown.
LEAST_LINES, MATRIX_LINES, SHOWN = 10, 8, 90

_strings = "array<string>"


def _part(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def pins(files: DataFrame) -> DataFrame:
    """By url: removed and added (names in the pins' changed lines), and package, the first name with a bound in them."""
    changed = files.where(F.col("filename").rlike(PIN_FILE)).select("url", "ix", "filename", F.posexplode(tx.lines(F.coalesce("patch", F.lit("")))).alias("at", "raw"))
    changed = changed.where(F.left("raw", F.lit(1)).isin("+", "-") & ~F.col("raw").rlike(r"^(\+\+\+|---)"))
    body = F.trim(F.substring("raw", 2, 1 << 30))
    named = changed.select("url", "ix", "at", F.left("raw", F.lit(1)).alias("sign"), F.lower(_part(body, PIN_NAME)).alias("name"), F.when(F.col("filename").rlike(NAMING_FILE), F.lower(_part(F.col("raw"), BOUND_NAME))).alias("bound"))
    of = lambda sign: F.array_sort(F.collect_set(F.when(F.col("sign") == sign, F.col("name"))))
    return named.groupBy("url").agg(of("-").alias("removed"), of("+").alias("added"), F.min_by("bound", F.when(F.col("bound").isNotNull(), F.struct("ix", "at"))).alias("package"))


def both_versions(body: Column, lines: Column, package: Column) -> Column:
    """Those of a declaration's lines that run against more than one version of the package: a matrix entry with two values or more, or a list of factors."""
    token = F.concat(F.lit(r"(?i)\Q"), package, F.lit(r"\E"))

    def shown(line: Column, i: Column) -> Column:
        values = F.regexp_extract_all(F.array_join(F.slice(lines, i + 1, F.lit(MATRIX_LINES)), "\n"), F.lit(r"(?m)^\s*-\s*(.+)$"), F.lit(1))
        entry = F.when(F.size(values) >= 2, F.concat(F.trim(line), F.lit(" -> "), F.array_join(F.slice(values, 1, 3), ", ")))
        factor = F.rlike(line, F.concat(token, F.lit(r"\d+"))) & F.left(body, i * 40 + 400).rlike(MATRIX)
        return F.when(F.rlike(line, F.concat(token, F.lit(r"[-_ ]?version\s*[:=]"))), entry).when(factor, line)

    found = F.transform(F.array_compact(F.transform(lines, shown)), lambda x: F.left(F.trim(x), F.lit(SHOWN)))
    return F.when(F.coalesce(package, F.lit("")) == "", F.array().cast(_strings)).otherwise(found)


def screen(pulls: DataFrame, files: DataFrame, base: DataFrame) -> DataFrame:
    """One row a pull request: owner, repo, number, title, merged, package, counts of source and test files and of their changed
    lines, python_versions, services, evidence, replaced and gained (names), blockers, notes, viable (no blocker).

    pulls: url, title, merged_at (string). files: url, ix, filename, additions, deletions, patch (what it changed). base: url, path, body (files
    of the base commit). Files without a pull request are left out; all declarations of the base are read. An
    address that is none of a pull request is a blocker of its own."""
    own = pulls.select("url", *(_part(F.col("url"), PULL, i).alias(n) for i, n in enumerate(("owner", "repo", "number"), 1)), F.coalesce("title", F.lit("")).alias("title"), F.left("merged_at", F.lit(10)).alias("merged"))
    lines = F.coalesce("additions", F.lit(0)) + F.coalesce("deletions", F.lit(0))
    source = ~F.col("filename").rlike(NON_SOURCE)
    test = ~source & F.col("filename").rlike(TEST_FILE)
    zero = F.lit(0).cast("long")
    sizes = files.groupBy("url").agg(*(x.alias(f"{kind}_{what}") for kind, is_ in (("source", source), ("test", test)) for what, x in (("files", F.count_if(is_)), ("lines", F.coalesce(F.sum(F.when(is_, lines)), zero)))))
    named = own.join(sizes, "url", "left").na.fill(0, ["source_files", "source_lines", "test_files", "test_lines"]).join(pins(files), "url", "left")
    named = named.withColumn("package", F.coalesce("package", F.lower(_part(F.col("title"), TITLE_NAME)), F.lit("")))
    is_ci = F.exists(F.array(*map(F.lit, CI_PATHS)), lambda c: (F.col("path") == c) | F.startswith(F.col("path"), F.concat(c, F.lit("/"))))
    ci = base.where(is_ci & (F.coalesce("body", F.lit("")) != "")).select("url", "path", "body", tx.lines(F.col("body")).alias("lines")).join(named.select("url", "package"), "url")
    ci = ci.select(
        "url", F.regexp_extract_all(F.regexp_extract("body", PYTHON_SECTION, 1), F.lit(PYTHON_VERSION), F.lit(1)).alias("versions"),
        F.filter(F.array(*map(F.lit, SERVICES)), lambda s: F.contains(F.lower("body"), s)).alias("services"),
        F.transform(both_versions(F.col("body"), F.col("lines"), F.col("package")), lambda x: F.concat("path", F.lit(": "), x)).alias("evidence"),
    )
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    ci = ci.groupBy("url").agg(every("versions").alias("python_versions"), every("services").alias("services"), every("evidence").alias("evidence"))
    none = F.array().cast(_strings)
    out = named.join(ci, "url", "left")
    out = out.withColumns({c: F.coalesce(c, none) for c in ("python_versions", "services", "evidence", "removed", "added")})
    out = out.withColumns({"replaced": F.array_except("removed", "added"), "gained": F.array_except("added", "removed")})
    old = F.exists("python_versions", lambda v: v.rlike(OLD_PYTHON)) & ~F.arrays_overlap("python_versions", F.array(*map(F.lit, RECENT_PYTHON)))
    blockers = {
        "not_a_pull_request": F.col("number").isNull(), "not_merged": F.coalesce("merged", F.lit("")) == "", "no_source_changed": F.col("source_files") == 0,
        "both_versions_tested": F.size("evidence") > 0, "package_replaced": (F.col("package") != "") & F.array_contains("replaced", F.col("package")) & (F.size("gained") > 0),
    }
    notes = {"few_source_lines": (F.col("source_files") > 0) & (F.col("source_lines") < LEAST_LINES), "old_python": old, "needs_service": F.size("services") > 0}
    listed = lambda kinds: F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in kinds.items())))
    return out.drop("removed", "added").withColumns({"blockers": listed(blockers), "notes": listed(notes)}).withColumn("viable", F.size("blockers") == 0)
