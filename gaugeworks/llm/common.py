"""What the training-data operators share: column guards, sums over keys in order, and word hashing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import new_path, shared_dir, written

__all__ = ["PASS_CHARS", "id_and_text", "mix", "new_path", "passes", "shared_dir", "slices", "sums_before", "sums_in_order", "values", "word_hashes", "written"]

#: Characters of text that one numpy pass holds at a time.
PASS_CHARS = 1 << 20


def sums_before(counts: DataFrame, key: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(key, by, before): of each row of ``counts`` (key, by, n), the sum of n over smaller keys within ``by``.
    Keys are gathered by thousands first, so that no order spans all of them in one task."""
    before = "coalesce(sum(n) over ({} order by {} rows between unbounded preceding and 1 preceding), 0)"
    over = lambda *cols: f"partition by {', '.join(cols)}" if cols else ""
    counts = counts.withColumn("_group", F.floor(F.col(key) / 1000))
    groups = counts.groupBy("_group", *by).agg(F.sum("n").alias("n"))
    groups = groups.select("_group", *by, F.expr(before.format(over(*by), "_group")).alias("_base"))
    within = counts.select(key, "_group", *by, F.expr(before.format(over("_group", *by), key)).alias("_inner"))
    return within.join(groups, ["_group", *by]).select(key, *by, (F.col("_base") + F.col("_inner")).alias("before"))


def sums_in_order(df: DataFrame, by: list, n: str) -> DataFrame:
    """``df`` with before: the sum of ``n`` over the rows that come earlier by ``by``. Sorted in parts, so no order spans all in one
    task; written, so that the order stays."""
    placed = written(df.orderBy(*by).withColumn("_at", F.monotonically_increasing_id()), "in-order").withColumn("_part", F.shiftright("_at", 33))
    upto = lambda w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A row for each part of the sort.
    parts = placed.groupBy("_part").agg(F.sum(n).alias(n)).select("_part", upto(Window.orderBy("_part")).alias("_base"))
    within = placed.withColumn("_inner", upto(Window.partitionBy("_part").orderBy("_at")))
    return within.join(parts, "_part").withColumn("before", F.col("_base") + F.col("_inner")).drop("_at", "_part", "_base", "_inner")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, null texts as empty ones; other columns can't clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def slices(texts: list[str], limit: int = PASS_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``limit`` characters, each of one text at least."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def values(column: pa.Array) -> Iterator:
    """The column's values one after another, so that a batch's texts aren't held a second time."""
    return (v.as_py() for v in column)


def passes(column: pa.Array, limit: int = PASS_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(place of the first, texts) of ``column`` in turn, of about ``limit`` bytes each, of one text at least."""
    size = pc.binary_length(column.cast(pa.large_string())).to_pylist()
    start = total = 0
    for i, n in enumerate(size):
        if total and total + n > limit:
            yield start, column.slice(start, i - start).to_pylist()
            start, total = i, 0
        total += n
    if start < len(size):
        yield start, column.slice(start).to_pylist()


#: Bytes of a lower-cased UTF-8 text that belong to words: digits, letters, and all beyond ASCII.
WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[ord("0") : ord("9") + 1] = True
WORD_BYTE[ord("a") : ord("z") + 1] = True
WORD_BYTE[128:] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every bit of ``h`` over all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hash_buffer(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words of one lower-cased UTF-8 buffer, in order.

    Horner sums over each word's bytes, taken from two-byte to n-byte words at once:
    one vector step per byte position, over the words that are that long."""
    data = np.frombuffer(raw, dtype=np.uint8)
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = WORD_BYTE[data]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    length = end - start
    order = np.argsort(-length, kind="stable")
    first, size = start[order], length[order]
    h = size.astype(np.uint64)
    live = np.searchsorted(-size, -np.arange(1, min(int(size[0]), 64) + 1), side="right")
    base = np.uint64(_BASE)
    for j, n in enumerate(live):
        h[:n] = h[:n] * base + data[first[:n] + j].astype(np.uint64)
    for k in np.flatnonzero(size > 64):  # rare: the rest of a very long word
        h[k] ^= np.uint64(hash_tail(raw[first[k] + 64 : first[k] + size[k]]))
    out = np.empty_like(h)
    out[order] = mix(h)
    return out


def hash_tail(rest: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(rest)


def word_hashes(texts: Iterable[str]) -> list[np.ndarray]:
    """For each text, the 64-bit hashes of its lower-cased words (runs of letters,
    digits and characters beyond ASCII). Texts are hashed together, a pass of at
    most about PASS_CHARS at a time; a longer text is cut between words."""
    texts = [t or "" for t in texts]
    out: list[np.ndarray] = []
    for a, b in slices(texts):
        raws = [t.lower().encode("utf-8", "replace") for t in texts[a:b]]
        if b - a == 1 and len(raws[0]) > 4 * PASS_CHARS:
            out.append(np.concatenate([_hash_buffer(p) for p in _cut(raws[0])] or [np.zeros(0, np.uint64)]))
            continue
        buffer = b"\n".join(raws)
        h = _hash_buffer(buffer)
        data = np.frombuffer(buffer, dtype=np.uint8)
        word = np.zeros(len(data) + 1, dtype=bool)
        word[1:] = WORD_BYTE[data]
        begins = word[1:] & ~word[:-1]
        upto = np.concatenate([[0], np.cumsum(begins)])
        at = 0
        for raw in raws:
            out.append(h[upto[at] : upto[at + len(raw)]])
            at += len(raw) + 1
    return out


def _cut(raw: bytes) -> Iterator[bytes]:
    """``raw`` in parts of about 4 PASS_CHARS bytes that end where no word goes on."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + 4 * PASS_CHARS)
        while end < len(raw) and WORD_BYTE[raw[end - 1]] and WORD_BYTE[raw[end]]:
            end += 1
        yield raw[at:end]
        at = end
