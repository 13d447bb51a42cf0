"""Scores of runs: the gates in their order, progress, clusters and one final label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import first_not_empty
from .detectors import CHEAT

#: Exit codes of a suite that could not run through the changed code's fault.
AGENT_EXITS = (2, 5)
NO_MESSAGE = "(no message)"


def missing_verdict_cause(exit_code: Column, n_changed: Column) -> Column:
    """Whose fault a missing verdict is: the agent's if the exit code says so and it changed anything."""
    return F.when(exit_code.isin(*AGENT_EXITS) & (n_changed > 0), "agent").otherwise("harness")


def clusters(states: DataFrame, key: str = "key") -> DataFrame:
    """(key, message, ids): failing ids by their error message."""
    each = states.select(F.col(key).alias("key"), F.explode("failed_ids").alias("id"), "errors")
    message = first_not_empty(F.try_element_at("errors", F.col("id")), F.lit(NO_MESSAGE))
    return each.select("key", "id", message.alias("message")).groupBy("key", "message").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def score(runs: DataFrame, findings: DataFrame | None = None, lists: bool = False) -> DataFrame:
    """One row per run. runs: key, before and after (struct ok, failed_ids, errors, suppressed, reason, exit_code),
    interrupted (string, empty if not), changed_files.

    Gates: a before-state without verdict, one without failures, an interruption, an after-state without verdict; then
    progress. Findings are attached whatever gate a run stops at; a run without findings has empty lists. ``lists`` adds
    cheats and warnings: the findings themselves (kind, path, line, detail), in listing order, where ``findings`` are those of the detectors."""
    b, a = F.col("before"), F.col("after")
    was, now = b["failed_ids"], a["failed_ids"]
    gate = (
        F.when(~F.coalesce(b["ok"], F.lit(False)), F.struct(F.lit("harness").alias("cause"), F.concat(F.lit("no verdict before: "), F.coalesce(b["reason"], F.lit(""))).alias("reason")))
        .when(F.size(was) == 0, F.struct(F.lit("task").alias("cause"), F.lit("nothing failed before").alias("reason")))
        .when(F.coalesce("interrupted", F.lit("")) != "", F.struct(F.lit("harness").alias("cause"), F.col("interrupted").alias("reason")))
        .when(~F.coalesce(a["ok"], F.lit(False)), F.struct(missing_verdict_cause(a["exit_code"], F.size("changed_files")).alias("cause"), F.coalesce(a["reason"], F.lit("")).alias("reason")))
    )
    gone = clusters(runs.select("key", b["failed_ids"].alias("failed_ids"), b["errors"].alias("errors")))
    left = gone.join(runs.select("key", now.alias("now")), "key").groupBy("key").agg(
        F.count("*").alias("clusters_total"), F.count_if(~F.arrays_overlap("ids", F.coalesce("now", F.array().cast("array<string>")))).alias("clusters_fixed")
    )
    out = runs.withColumn("gate", gate).join(left, "key", "left")
    scored = F.col("gate").isNull()
    when = lambda x: F.when(scored, x)
    fixed = F.size(F.array_except(was, now)).cast("long")
    out = out.select(
        "key", F.when(scored, "scored").otherwise("unscoreable").alias("status"), F.col("gate.cause").alias("unscoreable_cause"), F.col("gate.reason").alias("unscoreable_reason"),
        scored.alias("valid"), when(fixed).alias("fixed"), when(F.size(F.array_intersect(was, now)).cast("long")).alias("still_failing"),
        when(F.size(F.array_except(now, was)).cast("long")).alias("newly_broken"), when(F.greatest(F.lit(0), a["suppressed"] - b["suppressed"])).cast("long").alias("newly_suppressed"),
        when(F.bround(fixed / F.size(was), 3)).alias("progress"), when(F.col("clusters_fixed")).alias("clusters_fixed"), when(F.col("clusters_total")).alias("clusters_total"),
        when(F.bround(F.col("clusters_fixed") / F.col("clusters_total"), 3)).alias("cluster_progress"), F.array_sort("changed_files").alias("files_changed"),
    )
    if findings is None:
        out = out.withColumns({"n_cheats": F.lit(0).cast("long"), "n_warnings": F.lit(0).cast("long"), "kinds": F.array().cast("array<string>")})
    else:
        by = findings.groupBy("key").agg(F.count_if(F.col("severity") == CHEAT).alias("n_cheats"), F.count_if(F.col("severity") != CHEAT).alias("n_warnings"), F.array_sort(F.collect_set("kind")).alias("kinds"))
        out = out.join(by, "key", "left").na.fill(0, ["n_cheats", "n_warnings"]).withColumn("kinds", F.coalesce("kinds", F.array().cast("array<string>")))
    if lists and findings is not None:
        place, shown = ["detector_ix", "file_ix", "line", "kind"], ["kind", "path", "line", "detail"]
        of = lambda bad: F.array_sort(F.collect_list(F.when(bad, F.struct(F.struct(*place).alias("at"), F.struct(*shown).alias("f")))))
        cheat = F.col("severity") == CHEAT
        each = findings.groupBy("key").agg(of(cheat).alias("cheats"), of(~cheat).alias("warnings"))
        # A run's findings are of one diff, which is one text.
        each = each.withColumns({c: F.transform(c, lambda x: x["f"]) for c in ("cheats", "warnings")})
        none = F.array().cast(each.schema["cheats"].dataType)
        out = out.join(each, "key", "left").withColumns({c: F.coalesce(c, none) for c in ("cheats", "warnings")})
    out = out.withColumn("is_clean", F.col("n_cheats") == 0)
    return out.withColumn("credible_progress", F.when(F.col("valid") & F.col("is_clean"), F.col("progress")).otherwise(0.0))


def final_outcome(harness_error: Column, valid: Column, cause: Column, n_failing: Column, n_cheats: Column, gave_up: Column, over_cost: Column, over_time: Column, over_iterations: Column) -> Column:
    """One label for a run, by fixed priority; ``n_failing`` counts what fails after it."""
    solved = n_failing == 0
    return (
        F.when(F.coalesce(harness_error, F.lit("")) != "", "harness_error")
        .when(~F.coalesce(valid, F.lit(False)), F.when(cause == "agent", "broke_suite").otherwise("no_verdict"))
        .when(solved & (n_cheats == 0), "solved").when(solved, "solved_with_cheats").when(gave_up, "gave_up")
        .when(over_cost, "cost_limit").when(over_time, "time_limit").when(over_iterations, "iteration_limit").otherwise("stopped_without_solving")
    )
