"""Intervals for rates, as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two-sided normal quantiles.
QUANTILES = {0.90: 1.6448536269514722, 0.95: 1.959963984540054, 0.99: 2.5758293035489004}


def quantile(level: float) -> float:
    if level not in QUANTILES:
        raise ValueError(f"no quantile for level {level}; there is one for {sorted(QUANTILES)}")
    return QUANTILES[level]


def _bounds(k: Column, n: Column, z: float) -> tuple[Column, Column]:
    k, n = k.cast("double"), n.cast("double")
    p, wide = k / n, F.lit(z * z)
    scale = 1 + wide / n
    centre = (p + wide / (2 * n)) / scale
    spread = z * F.sqrt(p * (1 - p) / n + wide / (4 * n * n)) / scale
    low = F.when(k == 0, 0.0).otherwise(F.greatest(F.lit(0.0), centre - spread))
    high = F.when(k == n, 1.0).otherwise(F.least(F.lit(1.0), centre + spread))
    return F.least(low, p), F.greatest(high, p)


def _possible(k: Column, n: Column, strict: bool) -> Column:
    fine = (n > 0) & k.between(F.lit(0), n)
    if strict:
        return F.when(fine, True).otherwise(F.raise_error(F.format_string("%s successes of %s", k.cast("string"), n.cast("string"))).cast("boolean"))
    return fine


def wilson(k: Column, n: Column, level: float = 0.95, strict: bool = False) -> Column:
    """Wilson score interval of k successes in n: struct(point, low, high, n, level, degenerate).

    Impossible counts (n = 0 among them) and nulls give null; strict raises on them."""
    low, high = _bounds(k, n, quantile(level))
    made = F.struct((k / n).alias("point"), low.alias("low"), high.alias("high"), n.cast("long").alias("n"), F.lit(level).alias("level"), F.lit(False).alias("degenerate"))
    return F.when(_possible(k, n, strict), made)


def newcombe(k1: Column, n1: Column, k2: Column, n2: Column, level: float = 0.95, strict: bool = False) -> Column:
    """Newcombe's hybrid interval of the difference of two rates, within -1 and 1; fields as for wilson."""
    z = quantile(level)
    (l1, u1), (l2, u2) = _bounds(k1, n1, z), _bounds(k2, n2, z)
    p1, p2 = k1 / n1, k2 / n2
    d = p1 - p2
    low = d - F.sqrt((p1 - l1) * (p1 - l1) + (u2 - p2) * (u2 - p2))
    high = d + F.sqrt((u1 - p1) * (u1 - p1) + (p2 - l2) * (p2 - l2))
    made = F.struct(
        d.alias("point"), F.greatest(F.lit(-1.0), low).alias("low"), F.least(F.lit(1.0), high).alias("high"), (n1 + n2).cast("long").alias("n"), F.lit(level).alias("level"), F.lit(False).alias("degenerate")
    )
    return F.when(_possible(k1, n1, strict) & _possible(k2, n2, strict), made)


def established(interval: Column) -> Column:
    """Whether a difference's interval leaves zero out."""
    return (interval["low"] > 0) | (interval["high"] < 0)


def percent(x: Column) -> Column:
    """A share as whole per cent, halves to even."""
    return F.concat(F.bround(x * 100, 0).cast("int").cast("string"), F.lit("%"))
