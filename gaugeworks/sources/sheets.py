"""Filled-in sheets of verdicts: checked row by row, and taken over whole or not at all.

Every row of a sheet gets the problems it has. They are counted while the rows are written; only if there is none, the labels with the
sheet's verdicts become the next version of the labels table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.labels import COLLAPSE
from ..shared import written
from . import versioned
from .reports import sheet_rows, token

#: The label that leaves a pair out, labels that are a verdict or none, the least length of a reason, and the layout of the labels table.
SKIP = "skip"
VERDICTS = (*COLLAPSE, "unclear")
LEAST_REASON = 20
LAYOUT = 2


@dataclass
class Imported:
    """report: token, verdict, state (applied, unchanged, held or problem) and problems of each row; version: of the labels now."""

    report: DataFrame
    version: int
    published: bool


def checked(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` (token, verdict, rationale) with id, state and problems, against ``labels`` (id, neutral, ..).

    A row that repeats what is recorded is unchanged; one that contradicts it is a problem, and so are a token of no pair or of several, a word
    that is no verdict, a reason too short, and rows of one sheet that contradict each other."""
    pairs = labels.select(token(F.col("id")).alias("token"), "id", "neutral")
    known = pairs.groupBy("token").agg(F.count("*").alias("pairs"), F.min("id").alias("id"), F.min("neutral").alias("recorded"))
    own = rows.select("token", F.lower(F.trim("verdict")).alias("verdict"), F.trim("rationale").alias("rationale")).where("verdict <> ''")
    said = own.groupBy("token").agg(F.count_distinct("verdict").alias("said"))
    d = own.join(said, "token").join(known, "token", "left")
    recorded, verdict = F.col("recorded").isNotNull(), F.col("verdict")
    bad = verdict.isin(*VERDICTS, SKIP) == F.lit(False)
    # The first that holds stands for the rest, but for a sheet's quarrel with itself.
    first = (
        F.when(F.col("pairs").isNull(), "no such pair").when(F.col("pairs") > 1, "several pairs").when(bad, "not a verdict").when(recorded & (F.col("recorded") != verdict), "labelled otherwise")
        .when(~recorded & (verdict != SKIP) & (F.length("rationale") < LEAST_REASON), "reason too short")
    )
    problems = F.array_compact(F.array(first, F.when(F.col("said") > 1, "said otherwise in this sheet")))
    state = F.when(F.size("problems") > 0, "problem").when(recorded, "unchanged").otherwise("ready")
    return d.withColumn("problems", problems).withColumn("state", state).select("token", "id", "verdict", "rationale", "state", "problems")


def import_sheet(lines: DataFrame, labels_path: str, at: str, line: str = "value") -> Imported:
    """Takes the verdicts of a sheet's ``lines`` into the labels table at ``labels_path`` (id, neutral, rationale, at, source, ..).

    One problem in any row, and nothing is taken: rows that are fine are held. at: the time that is recorded. A sheet without new
    verdicts leaves the version as it is. Null lines are no rows; repeated rows are taken once."""
    spark = lines.sparkSession
    expect = versioned.newest(labels_path)["version"]
    labels = versioned.read(spark, labels_path, LAYOUT)
    seen = Observation()
    rows = written(checked(sheet_rows(lines, line), labels).observe(seen, F.count_if(F.col("state") == "problem").alias("problems"), F.count_if(F.col("state") == "ready").alias("ready")), "sheet-rows")
    fine = not seen.get["problems"]
    publish = fine and seen.get["ready"] > 0
    if publish:
        new = rows.where("state = 'ready'").groupBy("id").agg(F.min("verdict").alias("_verdict"), F.min("rationale").alias("_why"))
        taken = F.col("_verdict").isNotNull()
        why = F.when(F.col("_why") == "", "not worth labelling").otherwise(F.col("_why"))
        put = {"neutral": F.col("_verdict"), "rationale": why, "at": F.lit(at), "source": F.lit("sheet")}
        merged = labels.join(new, "id", "left").withColumns({c: F.when(taken, v).otherwise(F.col(c)) for c, v in put.items()})
        versioned.publish(merged.select(*labels.columns), labels_path, expect, LAYOUT)
    shown = F.when(F.col("state") == "ready", "applied" if fine else "held").otherwise(F.col("state"))
    return Imported(rows.withColumn("state", shown).select("token", "verdict", "state", "problems"), expect + publish, publish)
