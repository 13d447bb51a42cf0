"""Scans along an order that a hot key doesn't hold up.

Rows are sorted by key and order in parts, so a key with very many rows lies in many parts. Each part is scanned by itself; what it
sums up to for its last key is composed over the parts, and carried back to the rows. A cut between parts lies in one key at
most, so there are fewer carries than parts, whatever the keys: they are sent to every task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import written

#: Groups whose sizes are sent to every task; beyond it both sides are shuffled.
SEND_UP_TO = 200_000


def in_order(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` sorted by ``by`` and ``order`` in parts, written: _part and _at say in which part a row lies, and where."""
    placed = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_at", F.monotonically_increasing_id())
    return written(placed, "in-order").withColumn("_part", F.shiftright("_at", 33))


def beside(left: DataFrame, right: DataFrame, keys: Sequence[str], few: bool, how: str = "left") -> DataFrame:
    """A join on ``keys`` in which nulls are equal."""
    right = right.withColumnsRenamed({k: f"_{k}_" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(right[f"_{k}_"])
    return left.join(F.broadcast(right) if few else right, on, how).drop(*(f"_{k}_" for k in keys))


def _scanned(placed: DataFrame, by: Sequence[str], summary: Column, within: Column, over: Column, name: str, join: Column) -> DataFrame:
    """Adds ``name``: ``join`` of _in, the scan ``within`` a part, and _carry, what the ``summary`` of the key's parts before come to by ``over``."""
    parts = placed.groupBy(*by, "_part").agg(summary.alias("_own"))
    first = F.min("_part").over(W.partitionBy(*by))
    carries = parts.withColumns({"_carry": over, "_first": first}).where("_part > _first").select(*by, "_part", "_carry")
    return beside(placed.withColumn("_in", within), carries, [*by, "_part"], few=True).withColumn(name, join).drop("_in", "_carry")


def _before(by: Sequence[str]):
    return W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)


def _upto(by: Sequence[str]):
    return W.partitionBy(*by, "_part").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)


def running_sum(df: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` within the key, up to and with the row. Rows that tie in the order follow one another somehow."""
    placed = in_order(df.withColumn("_v", value), by, order)
    done = _scanned(placed, by, F.sum("_v"), F.sum("_v").over(_upto(by)), F.sum("_own").over(_before(by)), name, F.when(F.col("_carry").isNull(), F.col("_in")).otherwise(F.coalesce("_in", F.lit(0)) + F.col("_carry")))
    return done.drop("_v", "_at", "_part")


def last_value(df: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Adds ``name``: the last ``value`` that isn't null within the key, up to and with the row."""
    placed = in_order(df.withColumn("_v", value), by, order)
    last = F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("_at")))
    return _scanned(placed, by, last, F.last("_v", ignorenulls=True).over(_upto(by)), F.last("_own", ignorenulls=True).over(_before(by)), name, F.coalesce("_in", "_carry")).drop("_v", "_at", "_part")


def ranked_values(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """(by, x, c, upto, n): each distinct value of ``x`` that isn't null, how often it is there, how many values come up to and with it, and all of
    its group. No group is held: values are counted, then scanned."""
    counts = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("c"))
    seen = running_sum(counts, by, [x], F.col("c"), "upto")
    sizes = written(counts.groupBy(*by).agg(F.sum("c").alias("n")), "group-sizes")
    return beside(seen, sizes, by, few=sizes.count() <= SEND_UP_TO, how="inner")


def quantiles(df: DataFrame, by: Sequence[str], x: str, shares: dict[str, float]) -> DataFrame:
    """by, n, and for each name of ``shares`` the exact quantile, between two values in proportion; all in one pass over the ranks."""
    seen, aggs = ranked_values(df, by, x), [F.max("n").alias("n")]
    for name, share in shares.items():
        at = F.lit(share) * (F.col("n") - 1)
        for end, rank in (("low", F.floor(at)), ("high", F.ceil(at))):
            aggs.append(F.min(F.when(F.col("upto") > rank, F.col(x))).alias(f"_{name}_{end}"))
    found = seen.groupBy(*by).agg(*aggs)
    for name, share in shares.items():
        at = F.lit(share) * (F.col("n") - 1)
        low, high = F.col(f"_{name}_low"), F.col(f"_{name}_high")
        found = found.withColumn(name, low + (high - low) * (at - F.floor(at))).drop(low, high)
    return found
