"""The report's views over run records: each is a small table, with n beside every rate."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import labels as lb
from ..functions.intervals import wilson
from ..functions.text import is_blank
from ..operators import agreement as ag
from ..operators import resampling as rs
from ..operators.sequences import upper_median_by
from . import rates

#: Outcomes of a run and the class each is reported in; tools by what they do.
OUTCOME_CLASSES = {
    "solved": "solved cleanly", "solved_with_cheats": "green but flagged", "gave_up": "stopped short", "stopped_without_solving": "stopped short",
    "iteration_limit": "hit a cap", "cost_limit": "hit a cap", "time_limit": "hit a cap",
    "no_verdict": "no verdict or broke the suite", "harness_error": "no verdict or broke the suite", "broke_suite": "no verdict or broke the suite",
}
READ_TOOLS = ("list_files", "read_file", "search_code")
WRITE_TOOLS = ("edit_file", "write_file", "create_file")
#: Fixed value: the verdict of a pair that its reader passes over.
SKIPPED = "skip"
#: Days between a label and its second reading; least rows of an arm that is compared.
RETEST_DAYS, LEAST_ARM = 7, 8


def runs(records: DataFrame, tasks: DataFrame | None = None) -> DataFrame:
    """``records`` with what the views need from score and config: valid, progress, credible, n_cheats (null without a
    score), patched, scored, model_id; and of the task is_smoke_test and known_task, where ``tasks`` (id, is_smoke_test; a few rows) has it."""
    of = lambda v, k, t: F.try_variant_get(v, f"$.{k}", t)
    has_score = F.coalesce(F.schema_of_variant("score").startswith("OBJECT<") & (F.schema_of_variant("score") != "OBJECT<>"), F.lit(False))
    out = records.withColumns({
        "has_score": has_score, "valid": F.coalesce(of("score", "valid", "boolean"), F.lit(False)), "progress": of("score", "progress", "double"),
        "credible": of("score", "credible_progress", "double"), "n_cheats": F.when(has_score, F.coalesce(F.size(of("score", "cheats", "array<string>")), F.lit(0))),
        "patched": ~is_blank(F.col("diff")), "model_id": F.coalesce(of("config", "model_id", "string"), F.col("model")), "route": lb.route(of("config", "provider_route", "string")),
    })
    out = out.withColumns({"scored": F.col("has_score") & F.col("valid"), "detectable": F.col("has_score") & F.col("patched"), "flagged": F.col("n_cheats") > 0})
    if tasks is None:
        return out.withColumns({"is_smoke_test": F.lit(False), "known_task": F.lit(False)})
    dim = F.broadcast(tasks.select(F.col("id").alias("task_id"), "is_smoke_test", F.lit(True).alias("known_task")))  # a row per task definition
    return out.join(dim, "task_id", "left").na.fill(False, ["is_smoke_test", "known_task"])


def cells(r: DataFrame) -> DataFrame:
    """One row per (task, configuration), never pooled."""
    out = rates.cell_summary(r, ["task_id", "config_version"], F.col("scored"), F.col("detectable"), F.coalesce("flagged", F.lit(False)), F.when(F.col("cost_known"), F.col("cost_usd")))
    more = r.groupBy("task_id", "config_version").agg(
        F.count_if(~F.col("scored")).alias("n_unscoreable"), F.count_if(F.col("outcome") == "broke_suite").alias("n_broke"), F.count_if(F.col("scored") & (F.col("credible") >= 1)).alias("n_solved"),
        F.count_if(~F.col("cost_known")).alias("n_cost_unknown"),
    )
    return out.join(more, ["task_id", "config_version"])


def flag_rates(r: DataFrame) -> DataFrame:
    """By model: flagged runs over detectable ones, smoke tests left out."""
    return rates.rate_by(r.where("detectable and not is_smoke_test"), ["model_id"], F.col("flagged"))


def family(model: Column, families: dict[str, str]) -> Column:
    """A model's family by the registry of them; a model that isn't there is its own."""
    return F.coalesce(lb.mapped(model, families), model) if families else model


def model_differences(r: DataFrame, families: dict[str, str] | None = None) -> DataFrame:
    """Differences of flag rates of models with enough runs; with ``families`` (model to family) also within_family: whether both are of one."""
    enough = r.where("not is_smoke_test").groupBy("model_id").agg(F.count("*").alias("runs")).where(F.col("runs") >= LEAST_ARM)
    out = rates.differences(flag_rates(r).join(enough.select("model_id"), "model_id", "left_semi"), "model_id")
    return out if families is None else out.withColumn("within_family", family(F.col("first"), families) == family(F.col("second"), families))


def denominators(r: DataFrame) -> DataFrame:
    """One row: the flag rate over runs with a verdict, and over all with a patch, and how many have none."""
    own = r.where("not is_smoke_test")
    out = own.agg(
        F.count_if(F.col("scored") & F.col("patched")).alias("n_narrow"), F.count_if(F.col("scored") & F.col("patched") & F.col("flagged")).alias("k_narrow"), F.count_if("detectable").alias("n_broad"),
        F.count_if(F.col("detectable") & F.col("flagged")).alias("k_broad"), F.count_if(~F.col("patched")).alias("n_unpatched"),
    )
    return out.withColumns({"narrow": wilson(F.col("k_narrow"), F.col("n_narrow")), "broad": wilson(F.col("k_broad"), F.col("n_broad"))})


def measured(r: DataFrame, families: dict[str, str] | None = None) -> DataFrame:
    """One row: distinct cells, tasks, models, with ``families`` also these, and the sum of the costs that are known (null if none is)."""
    of = [] if families is None else [F.count_distinct(family(F.col("model_id"), families)).alias("families")]
    return r.agg(F.count("*").alias("runs"), F.count_distinct("task_id", "config_version").alias("cells"), F.count_distinct("task_id").alias("tasks"), F.count_distinct("model_id").alias("models"), *of, F.sum(F.when(F.col("cost_known"), F.col("cost_usd"))).alias("cost"))


def outcome_classes(r: DataFrame) -> DataFrame:
    return r.groupBy("max_iterations", lb.classify(F.col("outcome"), OUTCOME_CLASSES).alias("class")).agg(F.count("*").alias("n"))


def effort(r: DataFrame) -> DataFrame:
    """By cap: mean reads and writes, runs that never wrote, configurations. Runs without tool counts are left out and counted."""
    calls = lambda names: sum((F.coalesce(F.try_element_at("tool_calls", F.lit(t)), F.lit(0)) for t in names), F.lit(0))
    known = F.col("tool_calls").isNotNull()
    own = r.withColumns({"reads": F.when(known, calls(READ_TOOLS)), "writes": F.when(known, calls(WRITE_TOOLS))})
    return own.groupBy("max_iterations").agg(F.count("reads").alias("n"), F.count_if(~known).alias("n_unknown"), F.avg("reads").alias("mean_reads"), F.avg("writes").alias("mean_writes"), F.count_if(F.col("writes") == 0).alias("never_wrote"), F.count_distinct("config_version").alias("configs"))


def failures(r: DataFrame) -> DataFrame:
    """What kept runs from a clean result, each over all runs."""
    invented = F.coalesce(F.size("hallucinated_tools"), F.lit(0)) > 0
    return rates.several_rates(r, {"unattributed": F.col("outcome") == "no_verdict", "invented_tool": invented, "harness_error": F.col("outcome") == "harness_error", "broke_suite": F.col("outcome") == "broke_suite"})


def costs(r: DataFrame, by: list[str]) -> DataFrame:
    """By group: upper median, mean and greatest of the known costs."""
    known = r.where("cost_known")
    rest = known.groupBy(*by).agg(F.avg("cost_usd").alias("mean"), F.max("cost_usd").alias("greatest"))
    return upper_median_by(known, by, "cost_usd").join(rest, by)


def ladder(r: DataFrame) -> DataFrame:
    """Solved runs by task, model and cap, of series with two caps or more."""
    return rates.ladder(r.where("scored"), ["task_id", "model_id"], "max_iterations", F.col("credible") >= 1)


@F.pandas_udf(T.StringType())
def config_digest(configs: pd.Series) -> pd.Series:
    """Twelve hex digits of the SHA-256 of a configuration's JSON, keys sorted; of its text in, null for null."""
    import hashlib

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        return hashlib.sha256(json.dumps(json.loads(text), sort_keys=True).encode()).hexdigest()[:12]

    return configs.map(one)


# Calibration


def labels_long(pairs: DataFrame) -> DataFrame:
    """(id, rater, verdict): a row for each reading of a pair: human, relabel, and each judge by its alias."""
    one = lambda rater, col: pairs.select("id", F.lit(rater).alias("rater"), F.col(col).alias("verdict")).where("verdict is not null")
    judges = pairs.select("id", F.explode("judge").alias("rater", "j")).select("id", "rater", F.col("j.verdict").alias("verdict"))
    return one("human", "human.agent_relative").unionByName(one("relabel", "relabel.agent_relative")).unionByName(judges)


def calibration(long: DataFrame, truth: str = "human") -> DataFrame:
    """Agreement of every other rater with ``truth``: seven classes and two, with what the headline kappa licenses."""
    a = long.where(F.col("rater") == truth).select("id", F.col("verdict").alias("a"))
    both = long.where(F.col("rater") != truth).select("id", "rater", F.col("verdict").alias("b")).join(a, "id")
    two = both.withColumns({"a": F.coalesce(lb.collapse(F.col("a")), F.col("a")), "b": F.coalesce(lb.collapse(F.col("b")), F.col("b"))})
    seven = ag.agreement(both, "a", "b", ["rater"]).withColumn("classes", F.lit(7))
    return seven.unionByName(ag.agreement(two, "a", "b", ["rater"]).withColumn("classes", F.lit(2))).withColumns({"band": lb.kappa_band(F.col("kappa")), "standing": F.when(F.col("classes") == 2, lb.standing(F.col("kappa")))})


def calibration_intervals(long: DataFrame, truth: str = "human", n_boot: int = 2000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """``calibration`` with kappa's interval in its row: kappa_low and kappa_high, null where more than half of the draws have no kappa."""
    a = long.where(F.col("rater") == truth).select("id", F.col("verdict").alias("a"))
    both = long.where(F.col("rater") != truth).select("id", "rater", F.col("verdict").alias("b")).join(a, "id")
    kinds = F.explode(F.array(F.struct(F.lit(7).alias("classes"), F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.lit(2).alias("classes"), *(F.coalesce(lb.collapse(F.col(x)), F.col(x)).alias(x) for x in "ab"))))
    cut = rs.kappa_interval(both.select("rater", kinds.alias("k")).select("rater", "k.*"), ["rater", "classes"], "a", "b", n_boot, alpha, seed, strict=False)
    return calibration(long, truth).join(cut.select("rater", "classes", F.col("low").alias("kappa_low"), F.col("high").alias("kappa_high")), ["rater", "classes"], "left")


def calibration_progress(pairs: DataFrame, judges: Sequence[str], sampled: DataFrame) -> DataFrame:
    """One row: pairs, labelled, skipped, usable, judged (by judge, of the usable), sampled and retested (ids read again), and whether it is all complete.

    pairs: id, human (agent_relative, neutral), relabel, judge (by alias). sampled: id of the pairs to be read again."""
    own = pairs.join(sampled.select("id").distinct().withColumn("_sampled", F.lit(True)), "id", "left")
    labelled = F.col("human").isNotNull()
    usable = labelled & ~F.coalesce(F.col("human.neutral") == SKIPPED, F.lit(False))
    out = own.agg(
        F.count("*").alias("pairs"), F.count_if(labelled).alias("labelled"), F.count_if(labelled & ~usable).alias("skipped"), F.count_if(usable).alias("usable"),
        F.create_map(*(x for j in judges for x in (F.lit(j), F.count_if(usable & F.coalesce(F.map_contains_key("judge", j), F.lit(False)))))).alias("judged"),
        F.count("_sampled").alias("sampled"), F.count_if(F.col("_sampled").isNotNull() & F.col("relabel").isNotNull()).alias("retested"),
    )
    done = (F.col("labelled") == F.col("pairs")) & F.forall(F.map_values("judged"), lambda n: n == F.col("usable")) & (F.col("sampled") > 0) & (F.col("retested") == F.col("sampled"))
    return out.withColumn("complete", (F.col("labelled") > 0) & done)


def headline(calibrated: DataFrame, progress: DataFrame) -> DataFrame:
    """The judges' rows of two classes once ``progress`` is complete, and none before: band is inconclusive without a kappa."""
    own = calibrated.where("classes = 2").select("rater", "n", "kappa", "kappa_low", "kappa_high", F.coalesce("standing", F.lit("inconclusive")).alias("band"))
    return own.crossJoin(F.broadcast(progress.select("complete"))).where("complete").drop("complete")  # one row


def allowances(calls: DataFrame, assumed: int) -> DataFrame:
    """By judge: limits (the distinct output limits of its calls, ``assumed`` where none is on record) and recorded (whether all are).
    calls: judge, max_tokens."""
    limits = F.array_sort(F.collect_set(F.coalesce("max_tokens", F.lit(assumed))))
    return calls.groupBy("judge").agg(limits.alias("limits"), F.bool_and(F.col("max_tokens").isNotNull()).alias("recorded"))


def too_early(pairs: DataFrame) -> DataFrame:
    """Pairs read a second time within less than seven days, with the whole days between."""
    at = lambda c: F.to_timestamp(F.col(c))
    gap = F.timestamp_diff("DAY", at("human.at"), at("relabel.at"))
    return pairs.select("id", gap.alias("days")).where(F.col("days") < RETEST_DAYS)


def retest_opens(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row, or one by group: when the last pending pair may be read again."""
    pending = pairs.where("human is not null and relabel is null")
    return pending.groupBy(*by).agg((F.max(F.to_timestamp("human.at")) + F.expr(f"interval {RETEST_DAYS} days")).alias("opens"), F.count("*").alias("pending"))


def position_bias(pairs: DataFrame, strict: bool = False) -> DataFrame:
    """One row: the deficient rate of verdicts by the agent's position, and their difference: null if no verdict has the
    one position. ``strict`` makes that an error, as is a verdict at another position."""
    from ..functions.intervals import newcombe

    bad = lb.collapse(F.col("human.agent_relative")) == "deficient"
    at = lambda p: F.col("agent_position") == p
    judged = pairs.where(bad.isNotNull())
    if strict:
        known = F.coalesce(F.col("agent_position").isin("a", "b"), F.lit(False))
        judged = judged.where(F.when(known, True).otherwise(F.raise_error(F.concat(F.lit("a position is a or b, not "), F.coalesce("agent_position", F.lit("null")))).cast("boolean")))
    out = judged.agg(F.count_if(at("a") & bad).alias("k1"), F.count_if(at("a")).alias("n1"), F.count_if(at("b") & bad).alias("k2"), F.count_if(at("b")).alias("n2"))
    return out.withColumn("difference", newcombe(F.col("k1"), F.col("n1"), F.col("k2"), F.col("n2"), strict=strict))


def pending_cells(matrix: DataFrame, docs_usable: DataFrame, name: Column | str = "name") -> DataFrame:
    """Cells of a sweep's matrix with their state: complete, unusable (a record that is none) or pending."""
    state = F.when(F.col("usable"), "complete").when(F.col("usable").isNotNull(), "unusable").otherwise("pending")
    return matrix.join(docs_usable, name, "left").withColumn("state", state).drop("usable")


# Names and notes of runs


def stratum(r: DataFrame) -> Column:
    """(task, class, whether it has a cheat) of a run."""
    return F.struct("task_id", lb.outcome_class(F.col("scored"), F.col("credible")).alias("class"), F.coalesce(F.col("n_cheats") > 0, F.lit(False)).alias("has_cheat"))


def provider_route(openrouter: Column, pin: Column) -> Column:
    """How a model is called: by a router, pinned to a provider or not, or directly."""
    return F.when(~F.coalesce(openrouter, F.lit(False)), "").otherwise(F.concat(F.lit("openrouter"), F.coalesce(F.concat(F.lit(":"), F.nullif(pin, F.lit(""))), F.lit(""))))


def cell_name(arm: Column, cap: Column, repeat: Column) -> Column:
    """A sweep cell's name: its arm if it has one, its cap if that isn't the usual one, its repeat."""
    return F.concat(F.coalesce(F.concat(F.nullif(arm, F.lit("")), F.lit("-")), F.lit("")), F.coalesce(F.concat(F.lit("i"), cap.cast("string"), F.lit("-")), F.lit("")), F.lit("r"), F.lpad(repeat.cast("string"), 2, "0"))


def caps(r: DataFrame, arm: str) -> DataFrame:
    """By arm its distinct caps in order, and whether they differ from another arm's, so that rates aren't matched."""
    own = r.groupBy(arm).agg(F.array_sort(F.collect_set("max_iterations")).alias("caps"))
    kinds = own.agg(F.count_distinct("caps").alias("_kinds"))
    return own.crossJoin(F.broadcast(kinds)).select(arm, "caps", (F.col("_kinds") > 1).alias("unmatched"))  # `kinds` is one row


def failure_summary(failing: DataFrame, by: str, message: str, id_: str, ids: int = 3, most: int = 10) -> DataFrame:
    """By group its messages, the most frequent first, then by name: place, n, the first ``ids`` ids; the first ``most`` of them, and how many more there are."""
    w = W.partitionBy(by).orderBy(F.col("n").desc(), message)
    out = failing.groupBy(by, message).agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set(id_)), 1, ids).alias("ids"))
    out = out.withColumns({"place": F.row_number().over(w).cast("long"), "all": F.count("*").over(W.partitionBy(by))})
    return out.where(F.col("place") <= most).withColumn("more", F.greatest(F.lit(0), F.col("all") - most)).drop("all")


def finding_counts(findings: DataFrame) -> DataFrame:
    """By kind the number of findings and of runs, and the detail of the first one in listing order."""
    order = F.struct("key", "detector_ix", "file_ix", "line")
    return findings.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("key").alias("runs"), F.min_by("detail", order).alias("example"))


def dual_version_lines(lines: DataFrame, key: str, ix: str, text: str, ahead: int = 8) -> DataFrame:
    """Lines that test a version or an import, and whether one of the next ``ahead`` lines turns to the other case."""
    w = W.partitionBy(key).orderBy(ix)
    test = F.col(text).rlike(r"^\s*(?:if\b.*version|try\s*:)")
    turns = F.col(text).rlike(r"^\s*(?:else\s*:|elif\b|except\b.*:)")
    out = lines.withColumns({"_turns": turns, "_test": test})
    out = out.withColumn("turns", F.coalesce(F.bool_or("_turns").over(w.rowsBetween(1, ahead)), F.lit(False)))
    return out.where("_test").drop("_turns", "_test")


def reading_progress(pairs: DataFrame, judge_calls: DataFrame) -> DataFrame:
    """By judge its pairs, usable verdicts and cost; the cost is unknown if one call's is."""
    usable = ag.is_verdict(F.col("verdict"))
    own = judge_calls.join(pairs.select("id"), "id", "left_semi").groupBy("judge")
    return own.agg(F.count_distinct("id").alias("pairs"), F.count_if(usable).alias("usable"), F.when(F.bool_and(F.col("cost").isNotNull()), F.sum("cost")).alias("cost"))
