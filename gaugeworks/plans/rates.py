"""Views of rates: the rows of a report, each rate with its n and its interval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import established, newcombe, wilson


def rate_by(df: DataFrame, by: Sequence[str], hit: Column, level: float = 0.95) -> DataFrame:
    """by, k, n, rate, low, high. Null hits count in n_unknown, not in n."""
    out = df.groupBy(*by).agg(F.count_if(hit).alias("k"), F.count(hit).alias("n"), F.count_if(hit.isNull()).alias("n_unknown"))
    i = wilson(F.col("k"), F.col("n"), level)
    return out.withColumns({"rate": i["point"], "low": i["low"], "high": i["high"]})


def differences(rates: DataFrame, key: str, level: float = 0.95) -> DataFrame:
    """All pairs of rows of a report (key, k, n), first before second: the difference of their rates, its
    interval, and whether it leaves zero out."""
    a = rates.select(F.col(key).alias("first"), F.col("k").alias("k1"), F.col("n").alias("n1"))
    b = rates.select(F.col(key).alias("second"), F.col("k").alias("k2"), F.col("n").alias("n2"))
    i = newcombe(F.col("k1"), F.col("n1"), F.col("k2"), F.col("n2"), level)
    return a.join(b, F.col("first") < F.col("second")).select("first", "second", "k1", "n1", "k2", "n2", i["point"].alias("difference"), i["low"].alias("low"), i["high"].alias("high"), established(i).alias("established"))


def cell_summary(df: DataFrame, by: Sequence[str], scored: Column, patched: Column, hit: Column, cost: Column) -> DataFrame:
    """One row per cell, never pooled: rows, scored, hits over both denominators with intervals, cost."""
    out = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(scored).alias("n_scored"), F.count_if(scored & hit).alias("k_scored"), F.count_if(patched).alias("n_patched"),
        F.count_if(patched & hit).alias("k_patched"), F.sum(cost).alias("cost"),
    )
    narrow, broad = wilson(F.col("k_scored"), F.col("n_scored")), wilson(F.col("k_patched"), F.col("n_patched"))
    return out.withColumns({"narrow_low": narrow["low"], "narrow_high": narrow["high"], "broad_low": broad["low"], "broad_high": broad["high"]})


def several_rates(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """One row per named flag over one n: name, k, n, rate, low, high."""
    one = df.agg(F.count("*").alias("n"), *(F.count_if(c).alias(k) for k, c in flags.items()))
    long = one.select("n", F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.col(k).alias("k")) for k in flags))).alias("r")).select("r.name", "r.k", "n")
    i = wilson(F.col("k"), F.col("n"))
    return long.withColumns({"rate": i["point"], "low": i["low"], "high": i["high"]})


def ladder(df: DataFrame, series: Sequence[str], rung: str, hit: Column, least_points: int = 2) -> DataFrame:
    """k and n by series and rung, of series with enough rungs."""
    points = df.groupBy(*series, rung).agg(F.count_if(hit).alias("k"), F.count(hit).alias("n")).where("n > 0")
    enough = points.groupBy(*series).agg(F.count("*").alias("points")).where(F.col("points") >= least_points)
    return points.join(enough, list(series))


def matched(df: DataFrame, settings: Sequence[str], arm: str, hit: Column, least: int) -> DataFrame:
    """Pairs of arms that ran under equal settings, none of them null, each with ``least`` rows or more."""
    arms = df.where(" and ".join(f"{s} is not null" for s in settings)).groupBy(*settings, arm).agg(F.count("*").alias("rows"), F.count_if(hit).alias("k"), F.count(hit).alias("n"))
    arms = arms.where(F.col("rows") >= least)
    a = arms.select(*settings, F.col(arm).alias("first"), F.col("k").alias("k1"), F.col("n").alias("n1"))
    b = arms.select(*settings, F.col(arm).alias("second"), F.col("k").alias("k2"), F.col("n").alias("n2"))
    i = newcombe(F.col("k1"), F.col("n1"), F.col("k2"), F.col("n2"))
    return a.join(b, list(settings)).where("first < second").select(*settings, "first", "second", "k1", "n1", "k2", "n2", i["point"].alias("difference"), i["low"].alias("low"), i["high"].alias("high"))


def before_after(before: DataFrame, after: DataFrame, by: Sequence[str], item: str) -> DataFrame:
    """Per group: items fixed (gone), new, and still there."""
    b = before.select(*by, item).distinct().withColumn("was", F.lit(True))
    a = after.select(*by, item).distinct().withColumn("is", F.lit(True))
    both = b.join(a, [*by, item], "full")
    return both.groupBy(*by).agg(
        F.count_if(F.col("is").isNull()).alias("fixed"), F.count_if(F.col("was").isNull()).alias("newly_broken"), F.count_if(F.col("was").isNotNull() & F.col("is").isNotNull()).alias("still_failing")
    )


def cluster_progress(before: DataFrame, after: DataFrame, cluster: str, item: str) -> DataFrame:
    """One row: clusters, clusters with no item left, and their share (three places, halves to even)."""
    left = before.select(cluster, item).join(after.select(item).distinct().withColumn("_still", F.lit(1)), item, "left")
    by = left.groupBy(cluster).agg(F.count("_still").alias("still"))
    return by.agg(F.count("*").alias("clusters_total"), F.count_if(F.col("still") == 0).alias("clusters_fixed")).withColumn(
        "cluster_progress", F.bround(F.col("clusters_fixed") / F.col("clusters_total"), 3)
    )


def covered(ranges: DataFrame, lines: DataFrame, by: Sequence[str], key: Sequence[str], start: str, count: str, line: str) -> DataFrame:
    """Each distinct range (by, key, start, count) with whether a line of ``lines`` of the same ``by`` lies in [start, start + count):
    one equal join on ``by``, with the range as its condition."""
    own = lines.select(*(F.col(b).alias(f"_{b}") for b in by), F.col(line).alias("_line"))
    same = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]
    inside = (F.col("_line") >= F.col(start)) & (F.col("_line") < F.col(start) + F.col(count))
    met = ranges.join(own, [*same, inside], "left")
    return met.groupBy(*by, *key, start, count).agg(F.bool_or(F.col("_line").isNotNull()).alias("covered"))


def design(df: DataFrame, first: str, second: str) -> DataFrame:
    """All cells of two dimensions' values, in order: first, second, cell (from 1), n (rows of ``df`` in it). The dimensions' distinct values
    make one row before they are laid out, so no rows are crossed."""
    axes = df.agg(F.array_sort(F.collect_set(first)).alias("_a"), F.array_sort(F.collect_set(second)).alias("_b"))
    cells = axes.select(F.posexplode("_a").alias("_i", first), "_b").select("_i", first, F.size("_b").alias("_n"), F.posexplode("_b").alias("_j", second))
    counts = df.groupBy(first, second).agg(F.count("*").alias("n"))
    cells = cells.select(first, second, (F.col("_i") * F.col("_n") + F.col("_j") + 1).cast("long").alias("cell"))
    return cells.join(counts, [first, second], "left").na.fill(0, ["n"])


def planned_cost(df: DataFrame, by: Sequence[str], known: Column, cost: Column, cap: Column, least: int = 3, factor: float = 2.0) -> DataFrame:
    """Per group: the mean cost (unknown ones at their cap) times ``factor``, no more than the cap; with fewer than
    ``least`` rows the cap."""
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.when(known, cost).otherwise(cap)).alias("mean_cost"), F.max(cap).alias("cap"))
    return out.withColumn("planned", F.when(F.col("n") < least, F.col("cap")).otherwise(F.least("cap", F.col("mean_cost") * factor)))
