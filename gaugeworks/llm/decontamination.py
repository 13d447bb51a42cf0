"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over a window of words; only the words at its selected
positions are hashed, so a window still hits where others were substituted.
Hashes of the benchmark and of the training texts are joined; around each hit the two
word sequences are compared on their common diagonal, and an overlap is reported
where enough of the item's words agree."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import id_and_text, mix, passes, word_hashes, written

#: Masks over windows of words: 1 selects a position. Whatever words are substituted, a stretch of ten words or more
#: that begins and ends with an agreement and agrees in 80 % holds a window where one of them agrees throughout.
MASKS = ("111111", "11101011", "110110011", "1100011011", "11010111", "111100101")
#: Items shorter than this have masks of their own length; items shorter than that are no passages, but words of any text.
SHORT, LEAST_ITEM = 10, 4
#: Stretches on diagonals at most DRIFT words apart are added up, from PIECE words on.
DRIFT, PIECE = 16, 6
#: Test hashes up to this number are sent to every task (24 bytes each); beyond it they are joined by a shuffle.
SEND_UP_TO = 2_000_000


def short_masks(n: int) -> list[str]:
    """Masks for items of ``n`` words, fewer than SHORT, that have to agree as a whole: of one substitution, which
    80 % allow from five words on and which isn't at an end, one of three is free."""
    if n < 5:
        return ["1" * n]
    return ["".join("0" if 0 < i < n - 1 and i % 3 == k else "1" for i in range(n)) for k in range(3)]


def _coefficients(mask: str) -> tuple[np.ndarray, np.ndarray]:
    at = np.array([i for i, c in enumerate(mask) if c == "1"], dtype=np.int64)
    return at, mix((np.arange(len(at), dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash under ``mask`` of each window of ``words`` (64-bit word hashes)."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    at, factor = _coefficients(mask)
    h = np.full(n, len(mask) * 1_000_003 + int(mask, 2), dtype=np.uint64)
    for i, f in zip(at, factor):
        h += words[i : i + n] * f
    return mix(h)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _hashed_items(items: DataFrame) -> DataFrame:
    """(item, item_id, words): a key of its own for each row of the test side, and its word hashes."""
    keyed = items.withColumn("item", F.monotonically_increasing_id()).select("item", "item_id", "text")
    schema = T.StructType([T.StructField("item", T.LongType()), items.schema["item_id"], T.StructField("words", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [_signed(h) for h in word_hashes(batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.list_(pa.int64()))], schema.names)

    return keyed.mapInArrow(run, schema)


def _test_seeds(items: DataFrame, masks: Sequence[str]) -> DataFrame:
    """(seed, item, at, mask): the hashes of all items; short items have masks of their own."""
    schema = T.StructType([T.StructField("seed", T.LongType()), T.StructField("item", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("mask", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = np.array(words, dtype=np.int64).view(np.uint64)
                for m in masks if len(h) >= SHORT else short_masks(len(h)):
                    s = _signed(seed_hashes(h, m))
                    yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(np.full(len(s), item)), pa.array(np.arange(len(s), dtype=np.int32)), pa.array([m] * len(s))], schema.names)

    return items.select("item", "words").mapInArrow(run, schema)


def diagonal(doc: np.ndarray, item: np.ndarray, shift: int, least: float) -> tuple[int, int, int] | None:
    """(start in the item, length, agreeing words) of the longest stretch of the diagonal
    doc[shift + k] ~ item[k] that begins and ends with an agreement and agrees in a
    share ``least`` of its words."""
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    same = (doc[shift + lo : shift + hi] == item[lo:hi]).astype(np.int64)
    hits = np.flatnonzero(same)
    if not len(hits):
        return None
    # Agreements less the least share, summed: a stretch agrees enough if its sum is not
    # below zero. Starts and ends are ordered by their sums; each end takes the earliest start before it.
    upto = np.concatenate([[0.0], np.cumsum(same - least)])
    value = np.concatenate([upto[hits], upto[hits + 1] + 1e-9])
    is_end = np.repeat([0, 1], len(hits))
    place = np.concatenate([hits, hits])
    order = np.lexsort((is_end, value))
    place, is_end = place[order], is_end[order]
    begin = np.minimum.accumulate(np.where(is_end == 0, place, len(same)))
    length = np.where(is_end == 1, place - begin + 1, 0)
    best = int(np.argmax(length))
    start, n = int(begin[best]), int(length[best])
    return lo + start, n, int(same[start : start + n].sum())


def stretches(doc: np.ndarray, item: np.ndarray, shift: int, least: float, shortest: int) -> list[tuple[int, int, int]]:
    """All stretches of ``shortest`` words or more on a diagonal: the longest, and those of what it leaves on its sides."""
    out, open_ = [], [(0, len(item))]
    while open_:
        a, b = open_.pop()
        if b - a >= shortest and (found := diagonal(doc, item[a:b], shift + a, least)) and found[1] >= shortest:
            start = a + found[0]
            out.append((start, *found[1:]))
            open_ += [(a, start), (start + found[1], b)]
    return out


class _Overlaps:
    """Overlaps of one document, from its hits' items and diagonals."""

    def __init__(self, least_share: float, least_words: int, cover: float, least_agree: int):
        self.least_share, self.least_words, self.cover, self.least_agree = least_share, least_words, cover, least_agree

    def of(self, doc: np.ndarray, hits: Iterator[tuple[int, np.ndarray, int]]) -> list[tuple]:
        """(item, doc_word, item_word, n_words, n_agree, share), from hits (item, its words, shift)."""
        shifts: dict[int, tuple[np.ndarray, set]] = {}
        for item, words, shift in hits:
            shifts.setdefault(item, (words, set()))[1].add(shift)
        return [(item, *row) for item, (words, own) in shifts.items() for row in self._of_item(doc, words, sorted(own))]

    def _of_item(self, doc: np.ndarray, words: np.ndarray, shifts: list[int]) -> Iterator[tuple]:
        n = len(words)
        need = min(n, max(self.least_words, self.cover * n))
        near: list[tuple[int, int, int, int]] = []  # stretches too short by themselves, by diagonal
        for shift in shifts:
            found = diagonal(doc, words, shift, self.least_share)
            if found and found[1] < need and n >= 2 * PIECE:
                several = stretches(doc, words, shift, self.least_share, PIECE)
            else:
                several = [found] if found else []
            whole = [x for x in several if x[1] >= need or x[1] >= self.least_words and x[2] >= self.least_agree]
            for start, length, agree in whole[:1] if found and found[1] >= need else whole:
                yield shift + start, start, length, agree, agree / n
            if not whole:
                pieces = [(shift, *x) for x in several if x[1] >= PIECE]
                if pieces and near and shift - near[-1][0] > DRIFT:
                    yield from self._together(doc, words, near, need)
                    near = []
                near += pieces
        yield from self._together(doc, words, near, need)

    def _together(self, doc: np.ndarray, words: np.ndarray, pieces: list[tuple[int, int, int, int]], need: float) -> Iterator[tuple]:
        """One row for pieces on neighbouring diagonals that cover enough of the item together."""
        if len(pieces) < 2:
            return
        covered, agreed = np.zeros(len(words), dtype=bool), np.zeros(len(words), dtype=bool)
        for shift, start, length, _ in pieces:
            covered[start : start + length] = True
            agreed[start : start + length] |= doc[shift + start : shift + start + length] == words[start : start + length]
        if covered.sum() >= need:
            first = min(shift + start for shift, start, _, _ in pieces)
            yield first, min(p[1] for p in pieces), int(covered.sum()), int(agreed.sum()), float(agreed.sum() / len(words))


def overlaps(
    docs: DataFrame, items: DataFrame, masks: Sequence[str] = MASKS, least_share: float = 0.8, least_words: int = 10, cover: float = 0.5,
    least_agree: int = 13, least_item: int = LEAST_ITEM, id_col: str = "doc_id", text_col: str = "text", send_up_to: int = SEND_UP_TO,
) -> DataFrame:
    """One row per overlap of a document with a benchmark item: doc_id, item_id,
    doc_word, item_word (where it starts, words from 0), n_words, n_agree, share (of
    the item's words that agree).

    Words: runs of letters, digits and characters beyond ASCII, lower-cased. An overlap is an
    ungapped stretch that agrees in ``least_share`` of its words and covers
    ``cover`` of the item and ``least_words`` words, or the whole item if that is shorter; or a stretch with
    ``least_agree`` agreeing words, however long the item is. Shorter stretches of an item on neighbouring
    diagonals (words were inserted or left out) are one overlap if they cover as much together; n_words and n_agree
    then count the item's words. Such a stretch has ten words, or six that agree without a break.
    Items of fewer than ``least_item`` words have none. Null or wordless texts and items have no overlaps; repeated rows and items repeat theirs; null ids pass through.
    items: columns item_id and text. The test side's seeds are counted first: up to
    ``send_up_to`` they go to every task, else both sides are shuffled by seed."""
    docs, items = id_and_text(docs, id_col, text_col), items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = items.schema["item_id"]
    items = written(_hashed_items(items).where(F.size("words") >= max(1, least_item)), "test-items")
    tests = written(_test_seeds(items, masks), "test-seeds")
    fields = [("doc_word", T.LongType()), ("item_word", T.LongType()), ("n_words", T.LongType()), ("n_agree", T.LongType()), ("share", T.DoubleType())]
    schema = T.StructType([docs.schema["doc_id"], kind, *(T.StructField(n, t) for n, t in fields)])
    shapes = [r[0] for r in tests.select("mask").distinct().collect()]  # the masks, and short items' lengths
    rule = _Overlaps(least_share, least_words, cover, least_agree)
    way = _sent if tests.count() <= send_up_to else _shuffled
    return way(docs, items, tests, shapes, rule, schema)


def _frame(rows: list[tuple], ids: pa.DataType, items: pa.DataType, names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 7
    types = [ids, items, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names)


def _sent(docs: DataFrame, items: DataFrame, tests: DataFrame, shapes: list[str], rule: _Overlaps, schema: T.StructType) -> DataFrame:
    """Few test seeds, by count: every task holds them, documents aren't shuffled."""
    table = tests.select("seed", "item", "at").toPandas().sort_values(["seed", "item", "at"])
    keys, own, ats = (table[c].to_numpy() for c in ("seed", "item", "at"))
    known = {r["item"]: (r["item_id"], np.array(r["words"], dtype=np.int64)) for r in items.toLocalIterator()}
    held = docs.sparkSession.sparkContext.broadcast((keys, own, ats, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, own, ats, known = held.value
        sieve = np.zeros(1 << 20, dtype=bool)
        sieve[keys.view(np.uint64) >> np.uint64(44)] = True
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for a, texts in passes(batch.column(1)):
                hashed = word_hashes(texts)
                # Windows over all texts of the pass at once; what crosses an end is dropped.
                size = np.array([len(h) for h in hashed])
                ends = np.cumsum(size)
                flat = np.concatenate(hashed) if len(hashed) else np.zeros(0, np.uint64)
                hits: dict[int, list] = {}
                for mask in shapes:
                    h = seed_hashes(flat, mask)
                    near = np.flatnonzero(sieve[h >> np.uint64(44)])
                    if not len(near):
                        continue
                    seed = _signed(h[near])
                    lo, hi = np.searchsorted(keys, seed, "left"), np.searchsorted(keys, seed, "right")
                    doc = np.searchsorted(ends, near, "right")
                    good = (hi > lo) & (near + len(mask) <= ends[doc])
                    for p, d, x, y in zip(near[good].tolist(), doc[good].tolist(), lo[good].tolist(), hi[good].tolist()):
                        hits.setdefault(d, []).append((p - int(ends[d] - size[d]), x, y))
                for d, found in hits.items():
                    each = ((int(own[k]), known[own[k]][1], p - int(ats[k])) for p, x, y in found for k in range(x, y))
                    rows += [(ids[a + d], known[o[0]][0], *o[1:]) for o in rule.of(_signed(hashed[d]), each)]
            yield _frame(rows, batch.schema.field(0).type, to_arrow_type(schema["item_id"].dataType), schema.names)

    return docs.mapInArrow(run, schema)


def _shuffled(docs: DataFrame, items: DataFrame, tests: DataFrame, shapes: list[str], rule: _Overlaps, schema: T.StructType) -> DataFrame:
    """Many test seeds: training seeds are joined with them by a shuffle. A document's hits
    meet again with its words by a key of the row."""
    keyed = written(docs.withColumn("row", F.monotonically_increasing_id()), "keyed-docs")
    seeds = T.StructType([T.StructField("row", T.LongType()), T.StructField("place", T.LongType()), T.StructField("seed", T.LongType())])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, h in zip(batch.column(0).to_pylist(), word_hashes(batch.column(1).to_pylist())):
                for mask in shapes:
                    s = _signed(seed_hashes(h, mask))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), row)), pa.array(np.arange(len(s))), pa.array(s)], seeds.names)

    hits = keyed.select("row", "text").mapInArrow(train, seeds).join(tests.select("seed", "item", "at"), "seed")
    shifts = hits.groupBy("row", "item").agg(F.collect_set(F.col("place") - F.col("at")).alias("shifts"))
    both = written(shifts, "shifts").join(keyed, "row").join(items, "item").select("doc_id", "text", "item", "item_id", "words", "shifts")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, h, item, item_id, words, shifts in zip(batch.column(0).to_pylist(), word_hashes(batch.column(1).to_pylist()), *(batch.column(i).to_pylist() for i in (2, 3, 4, 5))):
                rows += [(doc_id, item_id, *o[1:]) for o in rule.of(_signed(h), ((item, np.array(words, dtype=np.int64), s) for s in shifts))]
            yield _frame(rows, batch.schema.field(0).type, batch.schema.field(3).type, schema.names)

    return both.mapInArrow(check, schema)
