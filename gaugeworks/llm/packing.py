"""Sequence packing by non-negative least squares.

Documents are cut at whole windows; what is left of each is one tail. Shallow
combinations of tail lengths that fill a window exactly are enumerated, their repeat
counts solved against the histogram of lengths by non-negative least squares and
rounded down, and the tails left over are packed greedily, longest first into the
fullest window that has room.

Only the histogram, one number per length, reaches the driver. Tails find their place in the plan by their
rank among tails of their length, which is counted by partitions, so a length that a third of all documents
share is spread like any other."""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_and_text, sums_before, values, written
from .tokens import encoder, vocabulary

WINDOW, END_ID = 1024, 0
#: Steps of the solver.
STEPS = 300


def pieces_of(docs: DataFrame, window: int, path: str, end_id: int, id_col: str, text_col: str, added: bool) -> DataFrame:
    """One row per piece: part, nth (rank among the pieces of its length in its part), doc_id, start, length,
    ids_crc32, doc_tokens. A part is one task's rows; it is numbered once, as this table is written."""
    docs = id_and_text(docs, id_col, text_col)
    longs = ["part", "nth", "start", "length", "ids_crc32", "doc_tokens"]
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in longs)])
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, enc = TaskContext.get().partitionId(), Counter(), encoder(path, added)
        for batch in batches:
            at: list[int] = []
            rows: list[tuple] = []
            for k, text in enumerate(values(batch.column(1))):
                ids = enc.ids(text) + end
                total = len(ids) // 4
                for start in range(0, total, window):
                    own = ids[4 * start : 4 * (start + window)]
                    n = len(own) // 4
                    rows.append((part, seen[n], start, n, zlib.crc32(own), total))
                    seen[n] += 1
                    at.append(k)
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", *longs])

    return docs.mapInArrow(run, schema)


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows (a, b, c), a >= b >= c, of present lengths with sum ``window``; c, then b, may be 0."""
    here = np.zeros(window + 1, dtype=bool)
    here[lengths] = True
    here[0] = False
    a = np.arange(1, window + 1)[here[1:]]
    rows = [np.stack([a, window - a, 0 * a], 1)[(2 * a >= window) & here[window - a]]]
    for c in a[3 * a <= window]:
        b = a[(a >= c) & (2 * a <= window - c)]
        b = b[here[window - c - b]]
        rows.append(np.stack([window - c - b, b, np.full_like(b, c)], 1))
    return np.concatenate(rows).astype(np.int64)


def solve(histogram: np.ndarray, combos: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts x >= 0 that bring ``combos`` near the histogram in least squares: projected
    gradient steps with momentum, on sums by length."""
    n = len(histogram)
    h = histogram.astype(np.float64)
    h[0] = 0
    valid = (combos > 0).astype(np.float64)

    def used(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(combos[:, k], weights=x * valid[:, k], minlength=n) for k in range(3))

    x = np.zeros(len(combos))
    if not len(combos) or not h.any():
        return x
    # Combinations that hold a length, scaled to the step that can't overshoot.
    step = 1.0 / max(1.0, 3.0 * used(np.ones(len(combos)))[1:].max())
    y, t = x, 1.0
    for _ in range(steps):
        over = used(y) - h
        over[0] = 0
        fresh = np.maximum(0.0, y - step * sum(over[combos[:, k]] * valid[:, k] for k in range(3)))
        u = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = fresh + (t - 1) / u * (fresh - x), fresh, u
    return x


def plan(histogram: np.ndarray, window: int) -> list[tuple[int, tuple[int, ...]]]:
    """(how many sequences, the lengths in each), that together use the histogram up."""
    left = histogram.astype(np.int64).copy()
    out: list[tuple[int, tuple[int, ...]]] = [(int(left[window]), (window,))] if left[window] else []
    left[window] = 0
    combos = combinations(np.flatnonzero(left), window)
    x = solve(left, combos)

    def take(row: np.ndarray, most: int) -> None:
        need = Counter(int(v) for v in row if v)
        n = min(most, *(int(left[v]) // k for v, k in need.items()))
        if n > 0:
            for v, k in need.items():
                left[v] -= n * k
            out.append((n, tuple(int(v) for v in row if v)))

    for k in np.argsort(-x, kind="stable"):
        if x[k] < 1:
            break
        take(combos[k], int(x[k]))
    for k in np.argsort(-x, kind="stable"):  # what rounding down has left: by size of the fraction, while lengths are there
        if left[combos[k][combos[k] > 0]].all():
            take(combos[k], int(left.sum()))
    return out + greedy(left, window)


def greedy(left: np.ndarray, window: int) -> list[tuple[int, tuple[int, ...]]]:
    """Each window starts with the longest length left and takes the longest that fits, as often
    as the counts allow; equal windows are made at once."""
    left, out = left.copy(), []
    lengths = [int(v) for v in np.flatnonzero(left)]
    while lengths:
        room, row, used = window, [], Counter()
        while room:
            k = bisect.bisect_right(lengths, room) - 1
            while k >= 0 and used[lengths[k]] >= left[lengths[k]]:
                k -= 1
            if k < 0:
                break
            row.append(lengths[k])
            used[lengths[k]] += 1
            room -= lengths[k]
        n = min(int(left[v]) // c for v, c in used.items())
        for v, c in used.items():
            left[v] -= n * c
        lengths = [v for v in lengths if left[v]]
        out.append((n, tuple(row)))
    return out


def _places(rows: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank, first sequence, sequences and offset of each stretch of ranks."""
    by: dict[int, list[list[int]]] = {}
    rank: Counter = Counter()
    sequence = 0
    for n, row in rows:
        offset = 0
        for v in row:
            by.setdefault(v, []).append([rank[v], sequence, n, offset])
            rank[v] += n
            offset += v
        sequence += n
    return {v: tuple(np.array(c, dtype=np.int64) for c in zip(*x)) for v, x in by.items()}


def pack(docs: DataFrame, window: int = WINDOW, path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", added: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and ``end_id``; each id lies in one piece. Pieces of a
    sequence lie from offset 0 on without gaps and hold at most ``window`` ids.
    added: as of Encoder. Null or empty text: the end id alone. Null ids and repeated rows are packed
    like others. Empty table: no rows."""
    pieces = written(pieces_of(docs, window, path or vocabulary(), end_id, id_col, text_col, added), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = written(counts, "counts")  # parts x lengths rows at most
    histogram = np.zeros(window + 1, dtype=np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # `window` rows at most
        histogram[length] = n
    places = docs.sparkSession.sparkContext.broadcast(_places(plan(histogram, window)))
    # Pieces of the length in earlier parts.
    first = sums_before(counts, "part", ("length",)).withColumnRenamed("before", "first")
    ranked = pieces.join(first, ["part", "length"]).withColumn("rank", F.col("first") + F.col("nth")).drop("first", "nth", "part")
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    schema = T.StructType([*(pieces.schema[c] for c in cols), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = places.value
        for batch in batches:
            length, rank = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            for v in np.unique(length):
                at = np.flatnonzero(length == v)
                starts, sequences, _, offsets = known[int(v)]
                k = np.searchsorted(starts, rank[at], "right") - 1
                sequence[at] = sequences[k] + rank[at] - starts[k]
                offset[at] = offsets[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], schema.names)

    return ranked.select(*cols, "rank").mapInArrow(place, schema)
