"""Operations along an order: running totals, runs, first steps, carried values, order statistics.

Each works within keys. Nothing here orders a whole table, or all rows of a key, in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scans


def upper_median(x: Column) -> Column:
    """The upper of the two middle values, as an aggregate."""
    return F.element_at(F.array_sort(F.collect_list(x)), (F.count(x) / 2).cast("int") + 1)


def upper_median_by(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """upper_median without gathering a group's values: the least value that more than half of the group's values come up to."""
    seen = scans.ranked_values(df, by, x)
    return seen.where(F.col("upto") > F.floor(F.col("n") / 2)).groupBy(*by).agg(F.min(x).alias("upper_median"), F.max("n").alias("n"))


#: Values of a group up to which they are listed beside its summary.
LISTED = 9


def describe(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """n, median (interpolated), least, greatest and mean of each group, and its values in order if they are LISTED at most (else null)."""
    seen = scans.ranked_values(df, by, x)
    last = F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)
    low, high = (F.min(F.when(F.col("upto") > rank, F.col(x))) for rank in last)
    few = F.flatten(F.array_sort(F.collect_list(F.when(F.col("n") <= LISTED, F.array_repeat(x, F.col("c").cast("int"))))))
    return seen.groupBy(*by).agg(
        F.max("n").alias("n"), ((low + high) / 2).alias("median"), F.min(x).alias("least"), F.max(x).alias("greatest"), (F.sum(F.col(x) * F.col("c")) / F.max("n")).alias("mean"), few.alias("_few")
    ).withColumn("listed", F.when(F.col("n") <= LISTED, F.col("_few"))).drop("_few")


def until_spent(df: DataFrame, by: Sequence[str], order: Sequence[str], amount: str, budget: float) -> DataFrame:
    """Rows of each key up to and with the one that reaches ``budget``; adds spent (through the row)."""
    run = scans.running_sum(df, by, order, F.col(amount), "spent")
    return run.where(F.col("spent") - F.col(amount) < budget)


def runs(df: DataFrame, by: Sequence[str], order: Sequence[str], flag: Column) -> DataFrame:
    """Each unbroken run of rows with ``flag``: by, run_start and run_end (of the first order column), length."""
    marked = df.withColumn("_on", F.coalesce(flag, F.lit(False)))
    island = scans.running_sum(marked, by, order, F.when(F.col("_on"), 0).otherwise(1), "_off")
    first = F.col(order[0])
    return island.where("_on").groupBy(*by, "_off").agg(F.min(first).alias("run_start"), F.max(first).alias("run_end"), F.count("*").alias("length")).drop("_off")


def first_step(df: DataFrame, by: Sequence[str], order: Sequence[str], kinds: dict[str, Column]) -> DataFrame:
    """For each key the rank (from 1) of the first row of each kind, null if there is none."""
    ranked = scans.running_sum(df.withColumns({f"_is_{k}": c for k, c in kinds.items()}), by, order, F.lit(1), "_step")
    return ranked.groupBy(*by).agg(*(F.min(F.when(F.col(f"_is_{k}"), F.col("_step"))).alias(f"first_{k}") for k in kinds))


def carried(df: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Adds ``name``: the last non-null ``value`` up to the row."""
    return scans.last_value(df, by, order, value, name)


def occurrence(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "nth") -> DataFrame:
    """Adds the rank of a row among those of its key, from 1."""
    return scans.running_sum(df, by, order, F.lit(1), name)


def latest(df: DataFrame, by: Sequence[str], of: str, at: str, listed: str | None = None) -> DataFrame:
    """Adds superseded: whether the row's ``of`` is not the one that its key had last: of equal times, the least, or with ``listed`` the first by that."""
    times = df.groupBy(*by).agg(F.max(at).alias("_at"))
    best = df.join(times, list(by)).where(F.col(at) == F.col("_at")).groupBy(*by).agg((F.min(of) if listed is None else F.min_by(of, F.struct(listed, of))).alias("_last"))
    return df.join(best, list(by)).withColumn("superseded", F.col(of) != F.col("_last")).drop("_last")
