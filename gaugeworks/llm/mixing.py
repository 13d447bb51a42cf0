"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact length. Each source's budget of words is spent on lengths: whole
passes over the source first, then each length's share in proportion, and what is left of the budget by a
bounded-knapsack dynamic programme over the documents that remain, which finds the sum nearest to it. Which
documents of a length are taken is by a seeded hash."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, sums_in_order, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MOST = (5, 2, 1), (3, 2), 2
#: Words of a source's budget that are left to the dynamic programme (a quarter of the budget at most).
WINDOW = 4096
#: Documents of one length that are ranked in one task; more are narrowed by bytes of their hash first.
RANKED = 1000
#: Rows of a small side that is sent to every task; beyond it both sides are shuffled.
SEND_UP_TO = 500_000


def nearest_sum(lengths: list[int], counts: list[int], budget: int, seed: int) -> list[int]:
    """How many of each length to take so that their sum is as near to ``budget`` as can be (ties: below): a bounded
    knapsack. Lengths come in a seeded order; for each sum that is first reached with a length, how many of it that took is kept."""
    taken = [0] * len(lengths)
    if budget <= 0:
        return taken
    size = 2 * budget + 1  # further off than taking nothing
    first, used = np.full(size, -1, dtype=np.int32), np.zeros(size, dtype=np.int32)
    reached = np.zeros(size, dtype=bool)
    reached[0] = True
    order = np.argsort(mix(np.asarray(lengths, dtype=np.uint64) + np.uint64(seed & (1 << 63) - 1)), kind="stable")
    for k in order.tolist():
        step, most = lengths[k], min(counts[k], (size - 1) // lengths[k]) if lengths[k] else 0
        if not most:
            continue
        rows = -(-size // step)
        grid = np.zeros(rows * step, dtype=bool)
        grid[:size] = reached
        at = np.arange(rows, dtype=np.int32)[:, None]
        last = np.maximum.accumulate(np.where(grid.reshape(rows, step), at, np.int32(-(1 << 30))), axis=0)  # the last row at which the column was reached
        away = (at - last).reshape(-1)[:size]
        fresh = np.flatnonzero((away > 0) & (away <= most))
        first[fresh], used[fresh], reached[fresh] = k, away[fresh], True
        if reached[budget]:
            break
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - budget))])
    while at:
        k = int(first[at])
        taken[k], at = int(used[at]), at - int(used[at]) * lengths[k]
    return taken


def spend(lengths: list[int], counts: list[int], budget: int, seed: int, window: int = WINDOW) -> list[int]:
    """How many documents of each length to take for ``budget`` words, none twice: in proportion, from the longest
    down with what was left unspent carried on, and the last ``window`` words by ``nearest_sum``. Beyond half of all
    words, those to leave out are chosen, so that there is always as much to choose from."""
    total = sum(n * c for n, c in zip(lengths, counts))
    if 2 * budget > total:
        return [c - out for c, out in zip(counts, spend(lengths, counts, max(total - budget, 0), seed, window))]
    if not budget:
        return [0] * len(lengths)
    spread = budget - min(window, budget // 4)
    taken, seen, spent = [0] * len(lengths), 0, 0
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        if lengths[k]:
            seen += lengths[k] * counts[k]
            taken[k] = min(counts[k], (spread * seen // total - spent) // lengths[k])
            spent += taken[k] * lengths[k]
    more = nearest_sum(lengths, [c - t for c, t in zip(counts, taken)], budget - spent, seed)
    return [t + m for t, m in zip(taken, more)]


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) for ``sizes`` (source, source_size): shares of 150 % of all words by weight, at most twice
    the source's size, the excess shared anew until no target is above. Each round is one aggregation; a round either caps sources
    of half the open weight or at least halves what is still to share, so there are few."""
    ranked = sums_in_order(sizes.withColumn("one", F.lit(1)), [F.col("source").asc_nulls_last()], "one")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("before") % len(WEIGHTS) + 1).cast("int"))
    table = written(ranked.select("source", "source_size", weight.alias("weight")), "weights")
    whole = T.DecimalType(38, 0)
    level, capped = None, F.lit(False)
    num, den, n = 0, 1, -1
    while True:
        row = table.agg(
            F.sum(F.col("source_size").cast(whole)), F.sum(F.when(capped, F.col("source_size")).otherwise(0).cast(whole)),
            F.sum(F.when(capped, 0).otherwise(F.col("weight"))), F.sum(capped.cast("long")),
        ).first()
        total, gone, den, now = (int(v or 0) for v in row)
        if now == n or not den:
            break
        # Level: words for each unit of weight, as num / (SHARE[1] * den).
        n, num = now, SHARE[0] * total - SHARE[1] * MOST * gone
        level = [w * num / (SHARE[1] * den) for w in WEIGHTS]
        capped = F.col("source_size").cast(whole) * F.lit(MOST * SHARE[1] * den).cast(whole) <= F.col("weight").cast("decimal(2,0)") * F.lit(str(num)).cast("decimal(35,0)")
    share = F.lit(0.0)
    for w, v in zip(WEIGHTS, level or ()):
        share = F.when(F.col("weight") == w, F.lit(v)).otherwise(share)
    return table.select("source", "source_size", F.when(capped, F.col("source_size") * float(MOST)).otherwise(share).alias("target"))


def _spent(lengths: DataFrame, seed: int, window: int) -> DataFrame:
    """``lengths`` (source, size, n, source_size, target) with whole, the passes over all, and extra, the documents of the length
    that are taken once more. A group holds a row for each distinct length of a source: d lengths take d * (d + 1) / 2 words."""
    schema = T.StructType([*lengths.schema.fields, T.StructField("whole", T.IntegerType()), T.StructField("extra", T.LongType())])

    def run(table: pa.Table) -> pa.Table:
        sizes, counts = table["size"].to_pylist(), table["n"].to_pylist()
        total, target = table["source_size"][0].as_py(), table["target"][0].as_py()
        budget = min(round(target), MOST * total)
        whole = budget // total if total else 0
        extra = spend(sizes, counts, budget - whole * total, seed, window) if total and budget > whole * total else [0] * len(sizes)
        return table.append_column("whole", pa.array([whole] * len(sizes), pa.int32())).append_column("extra", pa.array(extra, pa.int64()))

    return lengths.groupBy("source").applyInArrow(run, schema)


def _beside(left: DataFrame, right: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """``left`` with the columns of ``right`` (source, size, ...), nulls of source being equal."""
    named = right.withColumnsRenamed({"source": "_source", "size": "_size"})
    on = left["source"].eqNullSafe(named["_source"]) & (left["size"] == named["_size"])
    return left.join(F.broadcast(named) if few else named, on, how).drop("_source", "_size")


def _byte(k: int) -> Column:
    """Byte ``k`` of a document's order: of its hash, then of its row's, which tells rows of one doc_id apart. The first byte has the sign."""
    moved = F.shiftright("order" if k < 8 else "again", 56 - 8 * (k % 8))
    return (moved if k % 8 == 0 else moved.bitwiseAND(F.lit(255))).cast("int")


def mix_sources(docs: DataFrame, seed: int = 20_240_601, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", ranked: int = RANKED) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size (words; null text: 0), source_size, target (its source's), copies (0, 1 or 2), taken (copies x size).

    A source's taken words are the sum nearest to its target that the budget's last ``window`` words can be fitted to, mostly the
    target itself, rounded. No document is taken more than twice. The same rows give the same mix however they are split; of rows that share doc_id
    and length, which are alike in the result, some may be taken. Null source: one source, the last; null ids and repeated rows are
    mixed like others; sources without words have target 0; other columns don't matter; empty table: no rows.
    ranked: documents of one length ranked in one task; longer lists are narrowed first, a byte of the hash a round."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = written(base.withColumns({"order": F.xxhash64(F.lit(seed), "doc_id"), "again": F.xxhash64(F.monotonically_increasing_id())}), "sized")
    counted = written(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "lengths")
    targets = written(source_targets(counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))), "targets")
    named = targets.withColumnRenamed("source", "_source")
    lengths = counted.join(F.broadcast(named) if targets.count() <= SEND_UP_TO else named, counted["source"].eqNullSafe(named["_source"])).drop("_source")
    plan = written(_spent(lengths.select("source", "size", "n", "source_size", "target"), seed, window), "plan")
    few = plan.count() <= SEND_UP_TO
    rows = _beside(sized, plan, few)
    open_ = rows.where("extra > 0 and extra < n").withColumns({"need": F.col("extra"), "left": F.col("n"), "more": F.lit(None).cast("int")})
    for k in range(16):
        counts = open_.where((F.col("left") > ranked) & F.col("more").isNull()).groupBy("source", "size", "need", _byte(k).alias("byte")).agg(F.count("*").alias("here"))
        upto = F.sum("here").over(Window.partitionBy("source", "size").orderBy("byte"))  # 256 rows at most
        cut = counts.withColumn("upto", upto).where("upto >= need and upto - here < need").selectExpr("source", "size", "byte AS cut", "need - (upto - here) AS still", "here")
        cut = written(cut, "cuts")
        if cut.isEmpty():
            break
        told = F.when(F.col("cut").isNull() | F.col("more").isNotNull(), F.col("more")).when(_byte(k) < F.col("cut"), 1).when(_byte(k) > F.col("cut"), 0)
        open_ = _beside(open_, cut, few, "left").withColumns({"more": told, "need": F.coalesce("still", "need"), "left": F.coalesce("here", "left")}).drop("cut", "still", "here")
    place = F.row_number().over(Window.partitionBy("source", "size").orderBy("order", "doc_id", "again"))
    undecided = open_.where("more is null").withColumn("more", (place <= F.col("need")).cast("int"))
    settled = rows.where("not (extra > 0 and extra < n)").withColumn("more", (F.col("extra") > 0).cast("int"))
    cols = ["doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("more")).alias("copies")]
    mixed = settled.select(*cols).unionAll(open_.where("more is not null").select(*cols)).unionAll(undecided.select(*cols))
    return mixed.withColumn("taken", F.col("copies") * F.col("size"))
