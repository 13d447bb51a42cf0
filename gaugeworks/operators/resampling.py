"""Bootstrap intervals of means, clustered means, any statistic of counted values, and kappa.

Means: every distinct value, with its count, draws Poisson weights for all replicates where it lies, from a stream keyed by the value;
sums of weights meet in an aggregation. So no group is gathered, and partitions don't change a draw. Other statistics are of few
distinct values (pairs of labels): a resample of n rows is a multinomial draw over them, and groups with more values are an error.
Where values are many, ``little_bootstrap`` takes any statistic of any number of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import written
from .agreement import paired
from .scans import SEND_UP_TO, beside

#: Replicates that one task of a group draws; distinct values that a group of a general statistic may have.
SLICE, MOST_VALUES = 500, 10_000
#: Distinct values whose weights are drawn at a time.
BLOCK = 256


def _bounds(draws: DataFrame, by: Sequence[str], alpha: float) -> DataFrame:
    """Percentile bounds at the places int(alpha/2 m) and min(m - 1, int((1 - alpha/2) m)) of m sorted draws."""
    s, m = F.array_sort(F.collect_list("draw")), F.count("draw")
    lo = F.floor(m * (alpha / 2)).cast("int")
    hi = F.least(m - 1, F.floor(m * (1 - alpha / 2))).cast("int")
    # As many draws as replicates, whatever the input.
    out = draws.groupBy(*by).agg(s.alias("s"), m.alias("m"), lo.alias("lo"), hi.alias("hi"), F.max("point").alias("point"), F.max("n").alias("n"))
    return out.select(*by, "point", F.expr("s[lo]").alias("low"), F.expr("s[hi]").alias("high"), "n", (F.element_at("s", 1) == F.element_at("s", -1)).alias("degenerate"), (F.col("m")).alias("draws"))


def _resample(cells: DataFrame, by: Sequence[str], values: Sequence[str], statistic: Callable, n_boot: int, alpha: float, seed: int, strict: bool = True) -> DataFrame:
    """cells: by, values, c (rows of the cell). The cells of a group, few by contract, meet in a task for each
    slice of replicates. Draws without a value are left out; if they are more than half, that is an error, or without ``strict`` no row."""
    by = list(by)
    sizes = cells.groupBy(*by).agg(F.count("*").alias("_cells"))
    cells = cells.join(sizes, by) if by else cells.crossJoin(F.broadcast(sizes))  # without groups one row
    few = F.when(F.col("_cells") <= MOST_VALUES, F.lit(True)).otherwise(F.raise_error(F.lit(f"a group has more than {MOST_VALUES} distinct values")).cast("boolean"))
    sliced = cells.where(few).drop("_cells").withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit((n_boot - 1) // SLICE))))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.select(*by).schema)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(values)).reset_index(drop=True)
        count = pdf["c"].to_numpy()
        n, part = int(count.sum()), int(key[-1])
        rng = np.random.default_rng([seed, part])
        size = min(SLICE, n_boot - part * SLICE)
        draws = rng.multinomial(n, count / n, size=size)
        data = [pdf[v].to_numpy() for v in values]
        out = pd.DataFrame({b: [k] * size for b, k in zip(by, key)})
        out["draw"] = [statistic(d, *data) for d in draws]
        out["point"], out["n"] = statistic(count, *data), n
        return out[np.isfinite(out["draw"])]

    draws = sliced.groupBy(*by, "slice").applyInPandas(run, f"{fields + ', ' if by else ''}draw double, point double, n bigint")
    if not strict:
        return _bounds(draws, by, alpha).where(F.col("draws") * 2 >= n_boot)
    enough = F.when(F.col("draws") * 2 >= n_boot, F.lit(True)).otherwise(F.raise_error(F.lit("the statistic has no value for more than half of the draws")).cast("boolean"))
    return _bounds(draws, by, alpha).where(enough)


def bootstrap(df: DataFrame, by: Sequence[str], values: Sequence[str], statistic: Callable, n_boot: int = 2000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """point, low, high, n, degenerate, draws of any statistic(counts, *arrays of the distinct values) of each group."""
    cells = df.where(" and ".join(f"{v} is not null" for v in values)).groupBy(*by, *values).agg(F.count("*").alias("c"))
    return _resample(cells, by, values, statistic, n_boot, alpha, seed)


def little_bootstrap(
    df: DataFrame, by: Sequence[str], values: Sequence[str], row_id: str, statistic: Callable, subset: int = 1000, subsets: int = 20, n_boot: int = 100, alpha: float = 0.05, seed: int = 0, point: Column | None = None
) -> DataFrame:
    """by, point, low, high, n, subsets, draws of any statistic(counts, *arrays) of each group, however large: a bag of little bootstraps.

    Rows go by the hash of ``row_id`` to up to ``subsets`` disjoint random subsets of about ``subset`` rows, each a task's. In each, ``n_boot``
    resamples of all n rows of the group are drawn as multinomial weights over the subset's; the subsets' percentile bounds are averaged.
    A group of up to ``subset`` rows is one subset: the plain bootstrap. ``point`` is an aggregate that gives the exact statistic where there is
    one, else the mean of the subsets'. Rows with a null in ``values`` are left out. Draws without a value are left out; if they
    are more than half of a group's, that is an error, as is a group whose statistic has no value on a subset itself. Rows that share a ``row_id`` go together."""
    by = list(by)
    if not 0 < alpha < 1 or min(subset, subsets, n_boot) < 1:
        raise ValueError("alpha lies between 0 and 1, and subset, subsets and n_boot are at least 1")
    own = df.where(" and ".join(f"{v} is not null" for v in values))
    sizes = own.groupBy(*by).agg(F.count("*").alias("n"), *([] if point is None else [point.cast("double").alias("_exact")]))
    sizes = written(sizes if by else sizes.where("n > 0"), "resample-sizes")
    few = sizes.count() <= SEND_UP_TO
    share = F.least(F.lit(1.0), F.lit(float(subset)) / F.col("n"))
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), row_id), 11).cast("double") * 2.0**-53
    rows = beside(own.select(*by, *values, F.col(row_id).alias("_id"), place.alias("_place")), sizes.select(*by, "n"), by, few=few, how="inner")
    rows = rows.withColumn("subset", F.floor(F.col("_place") / share).cast("int")).where(F.col("subset") < F.least(F.lit(subsets), F.floor(1 / share + 1e-9)))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    fields = "".join(f"{b} {kinds[b]}, " for b in by)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_id", *values], kind="stable")
        n, data = int(pdf["n"].iloc[0]), [pdf[v].to_numpy() for v in values]
        rng = np.random.default_rng([seed, int(key[-1])])
        draws = np.array([statistic(rng.multinomial(n, np.full(len(pdf), 1 / len(pdf))), *data) for _ in range(n_boot)], float)
        good = np.sort(draws[np.isfinite(draws)])
        m = len(good)
        low, high = (good[int(alpha / 2 * m)], good[min(m - 1, int((1 - alpha / 2) * m))]) if m else (np.nan, np.nan)
        # The subset stands for n rows: each is there n / size times.
        at = statistic(np.full(len(pdf), n / len(pdf)), *data)
        return pd.DataFrame([(*key[:-1], at, low, high, m)], columns=[*by, "at", "low", "high", "good"])

    each = rows.groupBy(*by, "subset").applyInPandas(run, f"{fields}at double, low double, high double, good int")
    given = lambda c: F.when(~F.isnan(c), F.col(c))
    out = each.groupBy(*by).agg(F.avg("at").alias("_at"), F.avg(given("low")).alias("low"), F.avg(given("high")).alias("high"), F.count("*").alias("subsets"), F.sum("good").alias("draws"))
    enough = F.when(F.col("draws") * 2 >= F.col("subsets") * n_boot, F.lit(True)).otherwise(F.raise_error(F.lit("the statistic has no value for more than half of the draws")).cast("boolean"))
    defined = F.when(~F.isnan("_at"), F.lit(True)).otherwise(F.raise_error(F.lit("the statistic has no value on a subset itself")).cast("boolean"))
    out = beside(out.where(enough).where(defined), sizes, by, few=few, how="inner")
    return out.select(*by, F.col("_at" if point is None else "_exact").alias("point"), "low", "high", "n", "subsets", "draws")


def _weighted_means(cells: DataFrame, by: Sequence[str], n_boot: int, alpha: float, seed: int) -> DataFrame:
    """cells: by, total and size of a draw of the cell, c (draws that are alike)."""
    by = list(by)
    kinds = {f.name: f.dataType for f in cells.schema}
    src = cells.select(*by, F.xxhash64(F.lit(seed), *by, "total", "size").alias("_stream"), F.col("total").cast("double").alias("total"), F.col("size").cast("double").alias("size"), "c")
    fields = "".join(f"{b} {kinds[b].simpleString()}, " for b in by)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for key, own in pdf.groupby(by, dropna=False, sort=False) if by else [((), pdf)]:
                totals, sizes = np.zeros(n_boot), np.zeros(n_boot)
                for at in range(0, len(own), BLOCK):
                    part = own.iloc[at : at + BLOCK]
                    weights = np.stack([np.random.Generator(np.random.Philox(key=int(s) & (1 << 64) - 1)).poisson(c, n_boot) for s, c in zip(part["_stream"], part["c"])], 1)
                    totals += weights @ part["total"].to_numpy()
                    sizes += weights @ part["size"].to_numpy()
                out = pd.DataFrame({b: [k] * n_boot for b, k in zip(by, key)})
                yield out.assign(replicate=np.arange(n_boot), totals=totals, sizes=sizes)

    sums = src.mapInPandas(run, f"{fields}replicate int, totals double, sizes double").groupBy(*by, "replicate").agg(F.sum("totals").alias("t"), F.sum("sizes").alias("s"))
    exact = cells.groupBy(*by).agg((F.sum(F.col("total") * F.col("c")) / F.sum(F.col("size") * F.col("c"))).alias("point"), F.sum("c").alias("n"))
    draws = sums.where("s > 0").select(*by, (F.col("t") / F.col("s")).alias("draw"))
    draws = draws.join(exact, by) if by else draws.crossJoin(F.broadcast(exact))  # without groups one row
    return _bounds(draws, by, alpha)


def bootstrap_mean(df: DataFrame, by: Sequence[str], x: str, n_boot: int = 2000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """point, low, high, n, degenerate, draws of each group's mean; nulls are left out."""
    cells = df.where(F.col(x).isNotNull()).groupBy(*by, F.col(x).cast("double").alias("total")).agg(F.count("*").alias("c")).withColumn("size", F.lit(1.0))
    return _weighted_means(cells, by, n_boot, alpha, seed)


def cluster_bootstrap(df: DataFrame, by: Sequence[str], cluster: str, x: str, n_boot: int = 2000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """As bootstrap_mean, but whole clusters are drawn, and their rows pooled; n counts clusters."""
    sums = df.where(F.col(x).isNotNull()).groupBy(*by, cluster).agg(F.sum(x).alias("total"), F.count("*").cast("double").alias("size"))
    cells = sums.groupBy(*by, "total", "size").agg(F.count("*").alias("c"))
    return _weighted_means(cells, by, n_boot, alpha, seed)


def _kappa(counts: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
    n = counts.sum()
    same = counts[a == b].sum() / n
    chance = sum(counts[a == x].sum() * counts[b == x].sum() for x in set(a) | set(b)) / (n * n)
    return float("nan") if chance >= 1 else float((same - chance) / (1 - chance))


def kappa_interval(df: DataFrame, by: Sequence[str], a: str, b: str, n_boot: int = 2000, alpha: float = 0.05, seed: int = 0, strict: bool = True) -> DataFrame:
    """As bootstrap_mean, of Cohen's kappa over pairs of verdicts; draws without a kappa are left out."""
    cells = paired(df, a, b).groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("c"))
    return _resample(cells, by, ["a", "b"], _kappa, n_boot, alpha, seed, strict)


def seeded_mean(df: DataFrame, by: Sequence[str], x: str, order: str, n_boot: int = 10_000, alpha: float = 0.05, seed: int = 0, most: int = 10_000) -> DataFrame:
    """bootstrap_mean with the draws of Python's generator for ``seed`` over each group's values in ``order``, to repeat
    published intervals. A group's values meet in one task, so groups of more than ``most`` rows are an error."""
    by = list(by)
    small = df.where(F.col(x).isNotNull()).select(*by, F.col(x).cast("double").alias("x"), F.col(order).alias("o"))
    sized = small.join(small.groupBy(*by).agg(F.count("*").alias("c")), by)
    fine = F.when(F.col("c") <= most, F.lit(True)).otherwise(F.raise_error(F.lit(f"a group has more than {most} rows")).cast("boolean"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in small.select(*by).schema)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        import random

        data = pdf.sort_values("o", kind="stable")["x"].tolist()
        n, rng = len(data), random.Random(seed)
        draws = sorted(sum(data[rng.randrange(n)] for _ in range(n)) / n for _ in range(n_boot)) if n > 1 else data
        low, high = draws[int(alpha / 2 * len(draws))], draws[min(len(draws) - 1, int((1 - alpha / 2) * len(draws)))]
        return pd.DataFrame([(*key, sum(data) / n, low, high, n)], columns=[*by, "point", "low", "high", "n"])

    return sized.where(fine).groupBy(*by).applyInPandas(run, f"{fields}, point double, low double, high double, n bigint")
