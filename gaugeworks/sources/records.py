"""Strict loading of run records, one JSON document per file.

A document becomes a variant; every rule it breaks becomes a text. Documents without a
broken rule are records, all others are rejections: nothing is dropped, and nothing absent is filled in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import written

#: The record's version, its fields, and the labels it may hold.
VERSION = 3
REQUIRED = (
    "schema_version", "config_version", "task_id", "model", "outcome", "diff", "failed_ids", "before_failed_ids", "verdict_status",
    "iterations", "cost_usd", "cost_known", "max_iterations", "max_cost_usd",
)
FIELDS = {
    "schema_version": "bigint", "config_version": "string", "task_id": "string", "model": "string", "outcome": "string", "verdict_status": "string",
    "verdict_reason": "string", "verdict_exit_code": "bigint", "failed_ids": "array<string>", "before_failed_ids": "array<string>",
    "before_errors": "map<string,string>", "tests_passed": "bigint", "tests_failed": "bigint", "tests_errored": "bigint", "tests_skipped": "bigint",
    "tests_xfailed": "bigint", "tests_xpassed": "bigint", "iterations": "bigint", "cost_usd": "double", "cost_known": "boolean", "wall_seconds": "double",
    "max_iterations": "bigint", "max_cost_usd": "double", "max_wall_seconds": "double", "give_up_reason": "string", "harness_error": "string",
    "diff": "string", "changed_files": "array<string>", "tool_calls": "map<string,bigint>", "hallucinated_tools": "array<string>",
    "score": "variant", "config": "variant", "trajectory": "variant",
}
OUTCOMES = (
    "solved", "solved_with_cheats", "gave_up", "stopped_without_solving", "iteration_limit", "cost_limit", "time_limit", "no_verdict",
    "broke_suite", "harness_error",
)
VERDICTS = ("ok", "no_verdict")
COUNTS = ("iterations", "max_iterations", "tests_passed", "tests_failed", "tests_errored", "tests_skipped", "tests_xfailed", "tests_xpassed")
AMOUNTS = ("cost_usd", "max_cost_usd", "wall_seconds", "max_wall_seconds")
OBJECTS = ("score", "config", "before_errors")


def documents(spark: SparkSession, directory: str) -> DataFrame:
    """(name, modified, value): the *.json files of a directory, whole; hidden files are not read."""
    read = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", "*.json").load(directory)
    return read.select(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_modification_time").alias("modified"), "value")


def _shape(v: Column, key: str) -> Column:
    """Type of a field in words of SQL; null where absent."""
    return F.schema_of_variant(F.variant_get(v, f"$.{key}", "variant"))


def violations(v: Column, keys: Column) -> Column:
    """Texts of the broken rules in their order; empty for a record."""
    has = lambda k: F.array_contains(keys, k)
    get = lambda k, t: F.try_variant_get(v, f"$.{k}", t)
    number = lambda s: s.rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    ids = lambda s: s.isin("ARRAY<STRING>", "ARRAY<VOID>")
    rule = lambda bad, text: F.when(F.coalesce(bad, F.lit(False)), text if isinstance(text, Column) else F.lit(text))
    listed = lambda names: F.array(*map(F.lit, names))
    missing, unknown = F.array_except(listed(REQUIRED), keys), F.array_except(keys, listed(FIELDS))
    out = [
        rule(~(get("schema_version", "bigint") == VERSION) | ~has("schema_version") | (_shape(v, "schema_version") != "BIGINT"), F.concat(F.lit("schema v"), F.coalesce(F.try_variant_get(v, "$.schema_version", "string"), F.lit("?")))),
        rule(F.size(missing) > 0, F.concat(F.lit("missing required "), F.array_join(missing, ", "))),
        rule(has("config_version") & (F.coalesce(get("config_version", "string"), F.lit("")) == ""), "no config_version"),
        rule(F.size(unknown) > 0, F.concat(F.lit("unknown fields "), F.array_join(unknown, ", "))),
    ]
    for k in ("config_version", "task_id", "model", "outcome", "verdict_status"):
        out.append(rule(has(k) & (_shape(v, k) != "STRING"), f"{k} is not a string"))
        out.append(rule(has(k) & (F.trim(get(k, "string")) == ""), f"{k} is empty"))
    out.append(rule(~get("outcome", "string").isin(*OUTCOMES), "unknown outcome"))
    out.append(rule(~get("verdict_status", "string").isin(*VERDICTS), "unknown verdict_status"))
    out.append(rule(has("diff") & (_shape(v, "diff") != "STRING"), "diff is not a string"))
    for k in ("failed_ids", "before_failed_ids", "changed_files"):
        own = get(k, "array<string>")
        out.append(rule(has(k) & ~ids(_shape(v, k)), f"{k} is not a list of strings"))
        out.append(rule(F.size(F.array_distinct(own)) < F.size(own), f"{k} has duplicate ids"))
    for k in COUNTS:
        out.append(rule(has(k) & (_shape(v, k) != "BIGINT"), f"{k} is not an integer"))
        out.append(rule(get(k, "bigint") < 0, f"{k} is negative"))
    for k in AMOUNTS:
        out.append(rule(has(k) & ~number(_shape(v, k)), f"{k} is not a number"))
        out.append(rule(get(k, "double") < 0, f"{k} is negative"))
    out.append(rule(has("cost_known") & (_shape(v, "cost_known") != "BOOLEAN"), "cost_known is not a boolean"))
    out.append(rule(has("verdict_exit_code") & ~_shape(v, "verdict_exit_code").isin("BIGINT", "VOID"), "verdict_exit_code is not an integer"))
    calls = _shape(v, "tool_calls")
    out.append(rule(has("tool_calls") & ~calls.rlike(r"^OBJECT<(\S+: BIGINT(, )?)*>$"), "tool_calls are not counts by name"))
    for k in OBJECTS:
        out.append(rule(has(k) & ~_shape(v, k).startswith("OBJECT"), f"{k} is not an object"))
    out.append(rule(has("trajectory") & ~_shape(v, "trajectory").startswith("ARRAY"), "trajectory is not a list"))
    return F.array_compact(F.array(*out))


def checked(docs: DataFrame) -> DataFrame:
    """``docs`` (name, value, ..) with broken (texts). Written, so that a filter on it doesn't check all over again."""
    seen = docs.withColumns({"v": F.try_parse_json("value"), "keys": F.json_object_keys("value")})
    is_object = F.schema_of_variant("v").startswith("OBJECT")
    broken = F.when(F.col("v").isNull(), F.array(F.lit("not valid JSON"))).when(~is_object, F.array(F.lit("not a JSON object"))).otherwise(violations(F.col("v"), F.col("keys")))
    return written(seen.withColumn("broken", broken).drop("keys", "v"), "checked-records")


def load(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, rejections) of ``docs`` (name, value): records have the typed fields, null where absent;
    rejections have name, reason (the first broken rule), reasons, schema_version and missing."""
    seen = checked(docs)
    fields = [F.try_variant_get("v", f"$.{k}", t).alias(k) for k, t in FIELDS.items()]
    records = seen.where(F.size("broken") == 0).withColumn("v", F.try_parse_json("value")).select("name", *fields)
    missing = F.array_except(F.array(*map(F.lit, REQUIRED)), F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>")))
    version = F.try_variant_get(F.try_parse_json("value"), "$.schema_version", "string")
    bad = seen.where(F.size("broken") > 0).select("name", F.element_at("broken", 1).alias("reason"), F.col("broken").alias("reasons"), version.alias("schema_version"), missing.alias("missing"))
    return records, bad


def holds_measurement(docs: DataFrame) -> DataFrame:
    """(name, usable): loadable, and the harness itself did not fail."""
    error = F.coalesce(F.try_variant_get(F.try_parse_json("value"), "$.harness_error", "string"), F.lit(""))
    return checked(docs).select("name", ((F.size("broken") == 0) & (error == "")).alias("usable"))


def save(records: DataFrame, path: str) -> None:
    """Write records as JSON; rows of another version or without config_version are an error, and then nothing is written."""
    fine = F.col("schema_version").eqNullSafe(F.lit(VERSION)) & (F.coalesce("config_version", F.lit("")) != "")
    ok = F.when(fine, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("record can't be saved: "), F.coalesce("task_id", F.lit("?")))).cast("boolean"))
    records.where(ok).write.json(path)


def rejected_by_version(rejections: DataFrame) -> DataFrame:
    return rejections.groupBy(F.coalesce("schema_version", F.lit("unversioned")).alias("schema")).agg(F.count("*").alias("n"), F.min("name").alias("first_name"))
