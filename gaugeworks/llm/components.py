"""Connected components of an edge list, as alternating star contractions.

Each round is two aggregations to a minimum (pre-aggregated before the shuffle) and
two equi-joins; no neighbour list is ever gathered, so a node with very many
neighbours costs only rows, which skew-join handling can split. Before the first round each
task joins the edges it holds, so a list that fits one task is settled by then."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import values, written

#: Nodes that a task holds while it joins its edges.
HELD = 200_000


class Forest:
    """Disjoint sets over hashable nodes; holds only nodes that were joined."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    def join(self, x, y) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _stars(e: DataFrame, held: int) -> DataFrame:
    """``e`` with the edges of each task replaced by stars around the smallest node of what they join: the same nodes and the same
    components. A task that holds ``held`` nodes gives them out and begins anew, so a component may get several stars."""
    kind = e.schema["u"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, arrow = Forest(), None

        def stars() -> pa.RecordBatch:
            ends = list(known.up)
            return pa.RecordBatch.from_arrays([pa.array(ends, arrow), pa.array(map(known.root, ends), arrow)], ["u", "v"])

        for batch in batches:
            arrow = batch.column(0).type
            for u, v in zip(*map(values, batch.columns)):
                known.join(u, v)
                if len(known.up) >= held:
                    yield stars()
                    known = Forest()
        if known.up:
            yield stars()

    return e.mapInArrow(run, T.StructType([T.StructField("u", kind), T.StructField("v", kind)]))


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    ends = e.join(least, "u")
    inner = ends.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return inner.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def _written_with_state(e: DataFrame) -> tuple[DataFrame, tuple]:
    """``e`` written, and how many edges it has with the sum of their hashes, taken as they are written."""
    seen = Observation()
    e = written(e.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("hashes")), "edges")
    return e, (seen.get["n"], seen.get["hashes"])


def connected_components(edges: DataFrame, max_rounds: int = 60, held: int = HELD) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest
    node that can be reached.

    edges: columns u and v of one ordered type. Loops, repeated edges and either
    direction are fine; edges with a null end are left out. No edges: no rows.
    Each round is written to the shared folder, so lineage stays short. held: nodes that a
    task holds at a time, at most; any choice gives the same components."""
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    if isinstance(e.schema["u"].dataType, (T.IntegralType, T.StringType)):  # Python has the same order
        e = _stars(e, held)
    e, state = _written_with_state(e)
    before = None
    for _ in range(max_rounds):
        if state[0] == 0 or state == before:
            return (
                e.select(F.col("u").alias("node"), F.col("v").alias("component"))
                .unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
            )
        before = state
        e, state = _written_with_state(_small_star(_large_star(e)))
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
