"""Verdicts of judges: neutral and relative labels, and a pair's calls as one result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import mapped
from ..functions.text import json_object

#: Neutral verdicts and what each is seen from the other side; relative verdicts in the order that breaks ties.
MIRROR = {
    "equivalent": "equivalent", "a_narrower": "b_narrower", "b_narrower": "a_narrower", "a_wrong": "b_wrong", "b_wrong": "a_wrong",
    "different": "different", "unclear": "unclear",
}
RELATIVE = ("equivalent", "agent_narrower", "agent_wider", "agent_different", "agent_wrong", "reference_wrong", "unclear")
#: Neutral verdicts as seen of the agent where it is a.
RELATIVE_OF_A = {"equivalent": "equivalent", "different": "agent_different", "unclear": "unclear", "a_narrower": "agent_narrower", "b_narrower": "agent_wider", "a_wrong": "agent_wrong", "b_wrong": "reference_wrong"}


def mirrored(verdict: Column) -> Column:
    return mapped(verdict, MIRROR)


def relative(verdict: Column, position: Column) -> Column:
    """A neutral verdict as seen of the agent, which stood at ``position`` (a or b)."""
    return mapped(F.when(position == "a", verdict).otherwise(mirrored(verdict)), RELATIVE_OF_A)


def parsed_reply(reply: Column) -> Column:
    """struct(verdict, reasoning, confidence) of a judge's reply; null if there is no object or the verdict is none."""
    v = json_object(reply)
    get = lambda k: F.coalesce(F.try_variant_get(v, f"$.{k}", "string"), F.lit(""))
    verdict = F.lower(F.trim(get("verdict")))
    made = F.struct(verdict.alias("verdict"), F.left(get("reasoning"), F.lit(2000)).alias("reasoning"), F.left(F.lower(F.trim(get("confidence"))), F.lit(16)).alias("confidence"))
    return F.when(v.isNotNull() & verdict.isin(*MIRROR), made)


def judge_results(calls: DataFrame, pair: str, verdict: str, order: str, cost: str) -> DataFrame:
    """One row per pair: n_calls, n_parsed, verdict (most frequent, ties by vocabulary; unparseable without any), agreement,
    position_bias (the two orders' most frequent verdicts differ), cost, cost_known, stable, usable.

    calls: one row per call; a null verdict is an unparsed reply."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, RELATIVE)), F.col(verdict)), F.lit(0)), F.lit(len(RELATIVE) + 1))
    votes = calls.where(F.col(verdict).isNotNull()).groupBy(pair, F.col(verdict).alias("v"), rank.alias("r"), F.col(order).alias("o")).agg(F.count("*").alias("c"))
    mode = lambda: F.max_by("v", F.struct("c", -F.col("r")))
    by_order = votes.groupBy(pair, "o").agg(mode().alias("m")).groupBy(pair).agg(F.count_distinct("m").alias("modes"), F.count("*").alias("orders"))
    overall = votes.groupBy(pair, "v", "r").agg(F.sum("c").alias("c")).groupBy(pair).agg(mode().alias("verdict"), (F.max("c") / F.sum("c")).alias("agreement"))
    totals = calls.groupBy(pair).agg(F.count("*").alias("n_calls"), F.count(verdict).alias("n_parsed"), F.sum(cost).alias("cost"), F.bool_and(F.col(cost).isNotNull()).alias("cost_known"))
    out = totals.join(overall, pair, "left").join(by_order, pair, "left")
    bias = F.coalesce((F.col("orders") == 2) & (F.col("modes") > 1), F.lit(False))
    out = out.withColumns({"verdict": F.coalesce("verdict", F.lit("unparseable")), "position_bias": bias}).drop("modes", "orders")
    return out.withColumns({"stable": F.coalesce(F.col("agreement") == 1.0, F.lit(False)), "usable": (F.col("n_parsed") > 0) & ~F.col("verdict").isin("unclear", "unparseable")})


def self_judged(judges: DataFrame, judge: str, graded: DataFrame, model: str) -> DataFrame:
    """Judges that are among the models they grade."""
    return judges.join(graded.select(F.col(model).alias(judge)).distinct(), judge, "left_semi")


def judge_pairs(verdicts: DataFrame, pair: str = "pair", judge: str = "judge", verdict: str = "verdict") -> DataFrame:
    """(first, second, a, b) for each pair that two judges read, the first judge's name before the second's."""
    a = verdicts.select(pair, F.col(judge).alias("first"), F.col(verdict).alias("a"))
    b = verdicts.select(pair, F.col(judge).alias("second"), F.col(verdict).alias("b"))
    return a.join(b, pair).where("first < second").drop(pair)


def probe_answer(reply: Column) -> Column:
    """The JSON object of a probe's reply, as a variant: of its first fenced part that opens with a brace, else of the whole text."""
    fenced = F.transform(F.regexp_extract_all(reply, F.lit(r"(?s)```(.*?)```"), F.lit(1)), lambda t: F.regexp_replace(t, r"(?U)^\s*(?:json)?\s*", ""))
    own = F.filter(F.concat(fenced, F.array(F.trim(reply))), lambda t: t.startswith("{"))
    return F.try_parse_json(F.trim(F.try_element_at(own, F.lit(1))))
