"""Agreement of two raters, from one contingency frame.

Labels are counted by pairs before anything else, so all that follows works on a
few rows for each group, however many items there are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import is_verdict


def paired(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows in which both labels are verdicts."""
    return df.where(is_verdict(F.col(a)) & is_verdict(F.col(b)))


def confusion(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts of label pairs, non-verdicts included: columns by, a, b, n."""
    return df.groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def confusion_pivot(df: DataFrame, a: str, b: str, labels: Sequence[str]) -> DataFrame:
    """One row per label of ``a``, one column per label of ``b``; missing pairs are 0."""
    counted = [F.coalesce(F.sum(F.when(F.col(b) == x, 1)), F.lit(0)).alias(f"n_{x}") for x in labels]
    return df.groupBy(F.col(a).alias("a")).agg(*counted)


def agreement(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per group: n, n_excluded (a non-verdict on either side), observed, kappa,
    ac1, pabak, prevalence (share of the most common label of ``a``), n_labels.

    Kappa is 0 where chance agreement is total; AC1 and PABAK are 0 for a single label. Without a
    pair left the measures are null."""
    by = list(by)
    pairs = confusion(paired(df, a, b), a, b, by)
    side = lambda col: pairs.groupBy(*by, F.col(col).alias("label")).agg(F.sum("n").alias(f"n_{col}"))
    labels = side("a").join(side("b"), [*by, "label"], "full").na.fill(0, ["n_a", "n_b"])
    total = pairs.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    all_rows = df.groupBy(*by).agg(F.count("*").alias("n_all"))
    pool = labels.join(total, by) if by else labels.crossJoin(F.broadcast(total))  # without groups `total` is one row
    mean = (F.col("n_a") + F.col("n_b")) / (2 * F.col("n"))
    sums = pool.groupBy(*by).agg(
        F.max("n").alias("n"), F.max("same").alias("same"), F.count("*").alias("n_labels"), F.max("n_a").alias("top"),
        F.sum(F.col("n_a") * F.col("n_b")).alias("cross"), F.sum(mean * (1 - mean)).alias("spread"),
    )
    observed, k = F.col("same") / F.col("n"), F.col("n_labels")
    expected, chance = F.col("cross") / (F.col("n") * F.col("n")), F.col("spread") / (k - 1)
    sums = all_rows.join(sums, by, "left") if by else all_rows.crossJoin(F.broadcast(sums))
    return sums.select(
        *by, F.coalesce("n", F.lit(0)).alias("n"), (F.col("n_all") - F.coalesce("n", F.lit(0))).alias("n_excluded"), observed.alias("observed"),
        F.when(expected >= 1, 0.0).otherwise((observed - expected) / (1 - expected)).alias("kappa"),
        F.when((k < 2) | (chance >= 1), 0.0).otherwise((observed - chance) / (1 - chance)).alias("ac1"),
        F.when(k < 2, 0.0).otherwise((k * observed - 1) / (k - 1)).alias("pabak"),
        (F.col("top") / F.col("n")).alias("prevalence"), k.alias("n_labels"),
    )


def modal_prevalence(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """The share of each group's most frequent label, and n."""
    counts = df.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count("*").alias("c"))
    return counts.groupBy(*by).agg((F.max("c") / F.sum("c")).alias("prevalence"), F.sum("c").alias("n"))


def modal_vote(df: DataFrame, by: Sequence[str], label: str, order: Sequence[str]) -> DataFrame:
    """Each group's most frequent label, of equals the first in ``order``; votes, n and share of the mode."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(label))
    counts = df.groupBy(*by, F.col(label).alias("label"), rank.alias("rank")).agg(F.count("*").alias("votes"))
    best = F.max_by(F.struct("label", "votes"), F.struct("votes", -F.col("rank")))
    out = counts.groupBy(*by).agg(best.alias("best"), F.sum("votes").alias("n"))
    return out.select(*by, F.col("best.label").alias("mode"), F.col("best.votes").alias("votes"), "n", (F.col("best.votes") / F.col("n")).alias("share"))
