"""Test reports, coverage, labels, manifests and task files as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import last_error
from .records import documents

#: Outcomes of a test, those that are failures, and exit codes without a verdict.
KNOWN = ("passed", "failed", "error", "skipped", "xfailed", "xpassed")
BAD = ("failed", "error")
NO_VERDICT_EXITS = (2, 3, 4, 5)

_TESTS = "array<struct<nodeid:string, outcome:string, call:struct<longrepr:string>, setup:struct<longrepr:string>, teardown:struct<longrepr:string>>>"


def test_reports(docs: DataFrame) -> DataFrame:
    """One row per report (name, value): status ok or no_verdict, reason, exit_code, counts by outcome, failed_ids and errors.

    A report that doesn't add up has no verdict, for the first reason that holds."""
    v = F.col("v")
    get = lambda path, t: F.try_variant_get(v, path, t)
    tests = get("$.tests", _TESTS)
    kind = F.schema_of_variant(F.variant_get(v, "$.exitcode", "variant"))
    outcome = F.transform(F.col("tests"), lambda t: F.coalesce(t["outcome"], F.lit("__missing__")))
    ids = F.transform(F.col("tests"), lambda t: t["nodeid"])
    failing = F.filter("tests", lambda t: t["outcome"].isin(*BAD))
    unknown = F.array_sort(F.array_distinct(F.filter("outcomes", lambda o: ~o.isin(*KNOWN))))
    reason = (
        F.when(v.isNull(), "not valid JSON").when(kind.isNull() | (kind == "VOID"), "no exitcode").when(kind != "BIGINT", "exitcode is not an integer")
        .when(F.col("exit_code").isin(*NO_VERDICT_EXITS), F.concat(F.lit("the suite could not run: exit "), F.col("exit_code").cast("string")))
        .when(F.col("tests").isNull(), "no outcomes by test").when(F.size(unknown) > 0, F.concat(F.lit("unknown outcomes "), F.array_join(unknown, ", ")))
        .when(F.size(F.array_distinct("ids")) < F.size("ids"), "duplicate nodeids").when(F.col("total").isNotNull() & (F.col("total") != F.size("tests")), "the total is not the number of tests")
        .when(F.exists(failing, lambda t: F.coalesce(t["nodeid"], F.lit("")) == ""), "a failing test has no nodeid")
    )
    longrepr = lambda t: F.coalesce(F.nullif(t["call"]["longrepr"], F.lit("")), F.nullif(t["setup"]["longrepr"], F.lit("")), F.nullif(t["teardown"]["longrepr"], F.lit("")), F.lit(""))
    d = docs.withColumn("v", F.try_parse_json("value")).withColumns({"exit_code": F.when(kind == "BIGINT", get("$.exitcode", "bigint")), "tests": tests, "total": get("$.summary.total", "bigint")})
    d = d.withColumns({"outcomes": outcome, "ids": ids}).withColumn("reason", reason)
    fine = F.col("reason").isNull()
    count = lambda o: F.when(fine, F.size(F.filter("outcomes", lambda x: x == o)).cast("long"))
    return d.select(
        "name", F.when(fine, "ok").otherwise("no_verdict").alias("status"), "reason", "exit_code", *(count(o).alias(o) for o in KNOWN),
        F.when(fine, F.transform(failing, lambda t: t["nodeid"])).alias("failed_ids"),
        F.when(fine, F.map_from_entries(F.transform(failing, lambda t: F.struct(t["nodeid"], last_error(longrepr(t)))))).alias("errors"),
        F.when(fine, count("xfailed") + count("xpassed")).alias("suppressed"),
    )


def executed_lines(docs: DataFrame) -> DataFrame:
    """(name, path, line) of coverage reports."""
    files = F.from_json("value", "files map<string, struct<executed_lines: array<bigint>>>")["files"]
    each = docs.select("name", F.explode(files).alias("path", "f"))
    return each.select("name", F.regexp_replace("path", r"^[./]+", "").alias("path"), F.explode("f.executed_lines").alias("line"))


#: A rater's entry, and the labels file of a version.
_LABEL = "struct<neutral:string, agent_relative:string, rationale:string, at:string, source:string, days_after:bigint>"
LABELS_VERSION = 2


def label_pairs(docs: DataFrame) -> DataFrame:
    """One row per pair of a labels file: id, task_id, run, model, agent_position, human, relabel, judge. Another version is an error."""
    schema = f"version bigint, pairs array<struct<id:string, task_id:string, run:string, path:string, model:string, agent_position:string, human:{_LABEL}, relabel:{_LABEL}, judge:map<string, struct<verdict:string, agreement:double, cost_usd:double>>>>"
    d = docs.select("name", F.from_json("value", schema).alias("d"))
    known = F.when(F.col("d.version") == LABELS_VERSION, True).otherwise(F.raise_error(F.concat(F.lit("labels version "), F.coalesce(F.col("d.version").cast("string"), F.lit("?")))).cast("boolean"))
    return d.where(known).select("name", F.explode("d.pairs").alias("p")).select("name", "p.*")


def manifests(docs: DataFrame) -> DataFrame:
    """Sweep manifests: started, finished, cells, jobs, settled, completed; unreadable ones have broken set."""
    v = F.try_parse_json("value")
    get = lambda path, t: F.try_variant_get(v, path, t)
    return docs.select(
        "name", v.isNull().alias("broken"), F.to_timestamp(get("$.started", "string")).alias("started"), F.to_timestamp(get("$.finished", "string")).alias("finished"), get("$.matrix.cells", "bigint").alias("cells"),
        get("$.jobs", "bigint").alias("jobs"), get("$.ledger.settled", "double").alias("settled"), F.size(get("$.outcome.completed", "array<string>")).alias("completed"), get("$.git_dirty", "boolean").alias("git_dirty"),
    )


def sheet_rows(lines: DataFrame, line: str = "value") -> DataFrame:
    """Rows of a filled table in markdown: token, verdict, rationale (which may hold bars itself)."""
    cells = F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|")
    d = lines.where(F.trim(line).startswith("|")).select(cells.alias("c")).where("size(c) >= 3")
    d = d.select(F.regexp_replace(F.trim(F.col("c")[0]), "`", "").alias("token"), F.trim(F.col("c")[1]).alias("verdict"), F.trim(F.array_join(F.slice("c", 3, F.size("c")), "|")).alias("rationale"))
    return d.where(F.col("token").rlike("^[0-9a-f]{6}$"))


def token(pair_id: Column) -> Column:
    return F.substring(F.sha2(pair_id, 256), 1, 6)


def read_tasks(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Task definitions from YAML files, one small file each: id, package, versions, root_causes, is_smoke_test."""
    import yaml

    rows = []
    for path in paths:
        with open(path) as f:
            t = yaml.safe_load(f)
        lacking = [k for k in ("id", "package", "from_version", "to_version", "test_command") if not t.get(k)]
        if lacking:
            raise ValueError(f"{path} lacks {lacking}")
        rows.append((t["id"], t["package"], str(t["from_version"]), str(t["to_version"]), t["test_command"], t.get("root_causes") or [], len(t.get("root_causes") or []) < 2))
    return spark.createDataFrame(rows, "id string, package string, from_version string, to_version string, test_command string, root_causes array<string>, is_smoke_test boolean")


def read_reports(spark: SparkSession, directory: str) -> DataFrame:
    return test_reports(documents(spark, directory))
