"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are laid out in tiles by population counts. Only tiles whose
counts can lie within the radius meet; there numpy compares every pair with
exclusive-or and bit counts. A tile is cut into chunks of bounded size, and what
leaves a comparison is a spanning forest of its links, never all pairs of a group."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_and_text, mix, values, written
from .components import Forest, connected_components

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Bits of each byte value, most significant first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)
#: Fingerprints in one chunk, about; a block of rows that is compared with a chunk at once.
CHUNK, ROWS = 8192, 256
#: Nodes in one chunk where their sets go with them.
SET_CHUNK = 512
#: Bytes of such sets in one chunk, about.
SET_BYTES = 64 << 20
#: Shingles of a text that are held as such at a time.
BLOCK = 1 << 16
#: Up to this radius, tiles are made of the population counts of four parts.
PARTS_UP_TO = 4


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of the ``words``-word shingles of ``text`` with A-Z lower-cased, space-joined, in order with
    repeats; of fewer words of the whole sequence; of none nothing. A long text's shingles are made a block at a time."""
    digest = xxhash.xxh64_digest
    found = text.encode("utf-8", "replace").translate(LOWER).split()
    joined = b" ".join(found)
    if len(found) <= words:
        return np.frombuffer(digest(joined, 42) if found else b"", dtype=">u8")
    size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    del found
    end = np.cumsum(size + 1) - 1
    start, end = (end - size)[: len(size) - words + 1], end[words - 1 :]
    out = np.empty(len(start), dtype=">u8")
    for at in range(0, len(out), BLOCK):
        part = [digest(joined[a:b], 42) for a, b in zip(start[at : at + BLOCK].tolist(), end[at : at + BLOCK].tolist())]
        out[at : at + BLOCK] = np.frombuffer(b"".join(part), dtype=">u8")
    return out


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of ``hashes`` (zero for none)."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(2048, dtype=np.int64)
    for at in range(0, n, BLOCK):
        own = hashes[at : at + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
        counts += np.bincount(own.ravel(), minlength=2048)
    bits = counts.reshape(8, 256).astype(np.float64) @ _BITS
    return int.from_bytes(np.packbits(2 * bits.ravel() > n).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(
    docs: DataFrame, words: int = 3, lanes: int = 1, repeats: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, f0 .. f<lanes-1> long, n_shingles long, set_hash long), one row per row.

    f0 is the SimHash of XXH64 (seed 42) over the shingles; further lanes widen it
    with hashes derived from the same ones. repeats: count repeated shingles each
    time. Null text: as empty, all zero. Null ids pass through."""
    docs = id_and_text(docs, id_col, text_col)
    names = [f"f{i}" for i in range(lanes)]
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in [*names, "n_shingles", "set_hash"])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in values(batch.column(1)):
                h = shingle_hashes(text, words).astype(np.uint64)
                distinct = h if repeats and lanes == 1 else np.unique(h)
                use = h if repeats else distinct
                row = [_signed(majority(use))]
                row += [_signed(majority(mix(use + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)))) for k in range(1, lanes)]
                rows.append([*row, len(use), _signed(int(mix(distinct).sum()) if len(h) else 0)])
            cols = list(zip(*rows)) if rows else [[]] * (lanes + 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", *names, "n_shingles", "set_hash"])

    return docs.mapInArrow(run, schema)


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int, first: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of the rows of ``a`` and ``b`` (uint64, rows x lanes) that differ
    in ``radius`` bits or fewer, and in ``first`` or fewer in the first lane. same: ``a`` is ``b``,
    pairs once. Rows are ordered by population count, and blocks whose counts
    differ by more than the radius are skipped."""
    pa_, pb = np.bitwise_count(a).sum(1, dtype=np.int64), np.bitwise_count(b).sum(1, dtype=np.int64)
    oa, ob = np.argsort(pa_, kind="stable"), np.argsort(pb, kind="stable")
    sa, sb, ca, cb = a[oa], b[ob], pa_[oa], pb[ob]
    for s in range(0, len(sa), ROWS):
        rows = sa[s : s + ROWS]
        lo = np.searchsorted(cb, ca[s] - radius, "left")
        hi = np.searchsorted(cb, ca[s + len(rows) - 1] + radius, "right")
        if hi <= lo:
            continue
        d = np.bitwise_count(rows[:, :1] ^ sb[None, lo:hi, 0])
        i, j = np.nonzero(d <= first)
        if not len(i):
            continue
        dist = d[i, j].astype(np.int64)
        for k in range(1, a.shape[1]):
            dist += np.bitwise_count(rows[i, k] ^ sb[lo + j, k])
        keep = dist <= radius
        i, j, dist = oa[s + i[keep]], ob[lo + j[keep]], dist[keep]
        if same:
            once = i < j
            i, j, dist = i[once], j[once], dist[once]
        if len(i):
            yield i, j, dist


def _tiles(classes: DataFrame, radius: int, ratio: float | None) -> tuple[DataFrame, list[int]]:
    """``classes`` with a column tile, and the differences of the tiles that may hold
    pairs within reach: by population counts, and by size where a ratio bounds it."""
    if radius <= PARTS_UP_TO:
        parts = [F.bit_count(F.shiftrightunsigned("f0", 16 * i).bitwiseAND(F.lit(0xFFFF))) for i in range(4)]
        tile = sum((((p + 4) * (1 << 5 * i)).cast("long") for i, p in enumerate(parts)), F.lit(0).cast("long"))
        reach = [d for d in itertools.product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius]
        steps = [sum(x << 5 * i for i, x in enumerate(d)) for d in reach]
    else:
        lanes = [c for c in classes.columns if c.startswith("f") and c[1:].isdigit()]
        counts = sum((F.bit_count(c) for c in lanes), F.lit(0))
        width = math.log(1 / ratio) * (1 + 1e-9) if ratio else 1e9
        band = F.floor(F.log(F.greatest("n_shingles", F.lit(1)).cast("double")) / width)
        tile = (band * 1024 + F.floor(counts / (radius + 1)) + 2).cast("long")
        steps = [b * 1024 + p for b in ((-1, 0, 1) if ratio else (0,)) for p in (-1, 0, 1)]
    return classes.withColumn("tile", tile), [s for s in steps if s >= 0]


def _chunk_pairs(ids: DataFrame, steps: list[int]) -> DataFrame:
    """(tile, cut, tile_b, cut_b): each pair of chunks whose tiles are one of ``steps`` apart, once. Names alone: the chunks' contents join later."""
    away = F.explode(F.transform(F.array(*(F.lit(s).cast("long") for s in steps)), lambda s: s + F.col("tile")))
    left = ids.select("tile", "cut", away.alias("tile_b"))
    return left.join(ids.select(F.col("tile").alias("tile_b"), F.col("cut").alias("cut_b")), "tile_b").where("tile_b > tile or cut_b >= cut")


def forest_links(
    classes: DataFrame, radius: int, first: int | None = None, ratio: float | None = None, each_pair: bool = False, chunk: int = CHUNK
) -> DataFrame:
    """Links (u, v, distance) between rows of ``classes`` (node, f0.., n_shingles) whose
    fingerprints differ in ``radius`` bits or fewer: a spanning forest of them for
    each task (each_pair: for each pair of chunks, closest links first), so that the
    components are those of all links and the rows stay in proportion to the nodes.

    first: bound for the first lane alone. ratio: only nodes are compared whose sizes can be within it.
    If ``classes`` has columns part and set (packed shingle hashes), links are between nodes of different parts whose sets are
    within ``ratio``: each candidate is checked where it is found, and links that join parts anew in a task are given."""
    lanes = sorted(c for c in classes.columns if c.startswith("f") and c[1:].isdigit())
    tiled, steps = _tiles(classes, radius, ratio)
    # One row per tile: at most 23^4 of them by construction, whatever the input.
    by_bytes = F.ceil(F.sum(F.length("set")) / SET_BYTES) if "set" in tiled.columns else F.lit(1)
    sizes = tiled.groupBy("tile").agg(F.greatest(F.ceil(F.count("*") / chunk), by_bytes).alias("cuts"))
    cut = tiled.join(F.broadcast(sizes), "tile").withColumn("cut", F.pmod(F.xxhash64(*lanes, "node"), F.col("cuts")))
    apart = "part" in classes.columns
    cols = ["node", *lanes, *(["part", "set"] if apart else [])]
    chunks = cut.groupBy("tile", "cut").agg(F.collect_list(F.struct(*cols)).alias("rows"))
    chunks = written(chunks.select("tile", "cut", *(F.col(f"rows.{c}").alias(c) for c in cols)), "chunks")
    pairs = _chunk_pairs(chunks.select("tile", "cut"), steps)
    other = chunks.select(F.col("tile").alias("tile_b"), F.col("cut").alias("cut_b"), *(F.col(c).alias(f"{c}_b") for c in cols))
    # Pairs of chunks are few bytes for the work they make: dealt out by one chunk, whatever their size, to as many tasks
    # as shuffles have. A tile's pairs stay together, so that they share a forest, unless it was cut.
    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = pairs.join(other, ["tile_b", "cut_b"]).repartition(n, "tile", "cut").join(chunks, ["tile", "cut"])
    pairs = both.select((F.expr("tile_b = tile and cut = cut_b")).alias("same"), *cols, *(f"{c}_b" for c in cols))
    node_type = classes.schema["node"].dataType
    schema = T.StructType([T.StructField("u", node_type), T.StructField("v", node_type), T.StructField("distance", T.LongType())])
    first = radius if first is None else first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Forest()
        for batch in batches:
            out: list[tuple] = []
            same = batch.column(0).to_pylist()
            side = [[(col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()) for col in map(batch.column, at)] for at in (range(1, 1 + len(cols)), range(1 + len(cols), 1 + 2 * len(cols)))]
            for r in range(batch.num_rows):
                cut = [[x[o[r] : o[r + 1]] for x, o in v] for v in side]
                (na, a), (nb, b) = ((v[0], np.stack(v[1 : 1 + len(lanes)], 1).view(np.uint64)) for v in cut)
                if apart:  # block by block, as candidates are not bounded by the number of nodes
                    (pa_, sa), (pb, sb) = (v[-2:] for v in cut)
                    for i, j, d in close_pairs(a, b, radius, first, same[r]):
                        for x, y, z in zip(i.tolist(), j.tolist(), d.tolist()):
                            p, q = int(pa_[x]), int(pb[y])
                            if known.root(p) != known.root(q) and _alike(*(np.frombuffer(s, np.uint64) for s in (sa[x], sb[y])), ratio):
                                known.join(p, q)
                                out.append((int(na[x]), int(nb[y]), z))
                    continue
                found = list(close_pairs(a, b, radius, first, same[r]))
                if not found:
                    continue
                i, j, d = (np.concatenate(x) for x in zip(*found))
                forest = known
                if each_pair:
                    order, forest = np.argsort(d, kind="stable"), Forest()
                    i, j, d = i[order], j[order], d[order]
                out += [(x, y, z) for x, y, z in zip(na[i].tolist(), nb[j].tolist(), d.tolist()) if forest.join(x, y)]
            yield links(*zip(*out) if out else ((), (), ()))

    def links(u, v, d) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u, type=arrow), pa.array(v, type=arrow), pa.array(d, pa.int64())], ["u", "v", "distance"])

    arrow = pa.int64() if isinstance(node_type, T.LongType) else pa.int32()
    return pairs.mapInArrow(run, schema)


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, f0 (the fingerprint), n_shingles,
    component_id: the smallest doc_id that links within ``radius`` bits reach.

    Nulls: a null text counts as empty; a text without words has fingerprint zero
    and links like any other; a null doc_id is never a component's name unless
    all ids there are null. Repeated rows each give a row. Empty table: no rows."""
    prints = written(fingerprints(docs, words, 1, True, id_col, text_col), "fingerprints")
    nodes = prints.groupBy(F.col("f0").alias("node")).agg(F.min("doc_id").alias("least"))
    nodes = written(nodes, "nodes")
    links = forest_links(nodes.select("node", F.col("node").alias("f0")), radius)
    parts = connected_components(links.select("u", "v"))
    placed = nodes.join(parts, "node", "left").select("node", "least", F.coalesce("component", "node").alias("part"))
    least = placed.groupBy("part").agg(F.min("least").alias("component_id"))
    named = placed.join(least, "part").select(F.col("node").alias("f0"), "component_id")
    return prints.select("doc_id", "f0", "n_shingles").join(named, "f0")


def _shingle_set(text: str, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words).astype(np.uint64))


def _alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sets (sorted, distinct) have a Jaccard similarity of ``similarity`` or more; two empty ones have 1."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both)


def _texts_of(docs: DataFrame, ids: DataFrame, small: int) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``ids``; these are sent to every task only if they were counted and are few."""
    few = ids.count() <= small
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def _with_sets(nodes: DataFrame, docs: DataFrame, words: int, small: int) -> DataFrame:
    """``nodes`` with set: the packed shingle hashes of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [_shingle_set(t, words).tobytes() for t in values(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "set"])

    schema = T.StructType([T.StructField("node", nodes.schema["node"].dataType), T.StructField("set", T.BinaryType())])
    texts = _texts_of(docs, nodes.select(F.col("node").alias("doc_id")), small)
    return nodes.join(texts.mapInArrow(run, schema), "node")


def _checked(links: DataFrame, docs: DataFrame, words: int, similarity: float, small: int) -> DataFrame:
    """``links`` (u, v) with good: whether their texts' shingle sets are similar enough."""
    ends = links.select(F.col("u").alias("doc_id")).unionAll(links.select("v")).distinct()
    texts = written(_texts_of(docs, ends, small), "linked")
    a, b = (texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"text_{k}")) for k in "uv")
    both = links.join(a, "u").join(b, "v").select("u", "v", "text_u", "text_v")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [_alike(_shingle_set(x, words), _shingle_set(y, words), similarity) for x, y in zip(values(batch.column(2)), values(batch.column(3)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good, pa.bool_())], ["u", "v", "good"])

    return written(both.mapInArrow(check, T.StructType([*links.schema.fields, T.StructField("good", T.BooleanType())])), "checked")


def near_duplicates(
    docs: DataFrame, words: int = 5, similarity: float = 0.8, lanes: int = 4, slack: float = 3.0, id_col: str = "doc_id", text_col: str = "text", small: int = 200_000
) -> DataFrame:
    """One row (doc_id, component_id) per id; component_id is the smallest id of its group.
    Groups are joined by pairs whose ``words``-word shingle sets have a Jaccard similarity of
    ``similarity`` or more.

    Candidates are pairs of wide SimHash fingerprints (64 x lanes bits) within the
    distance expected at that similarity plus ``slack`` standard deviations, found
    by tiled comparison between texts of compatible sizes. A spanning forest of them is checked
    on the texts' own shingle sets; where the links that pass don't join all that the candidates join, every
    candidate between what is still apart is checked too. Null text: empty; texts without words form one
    group. Rows with a null id are left out. Repeated rows share one row here."""
    docs = id_and_text(docs, id_col, text_col).where("doc_id is not null")
    prints = written(fingerprints(docs, words, lanes, False), "fingerprints")
    f = [f"f{i}" for i in range(lanes)]
    nodes = prints.groupBy(*f, "n_shingles", "set_hash").agg(F.min("doc_id").alias("node"))
    nodes = written(nodes, "nodes")
    cosine = 2 * similarity / (1 + similarity)
    p = math.acos(cosine) / math.pi
    reach = lambda bits: math.ceil(bits * p + slack * math.sqrt(bits * p * (1 - p)))
    compare = lambda of, **how: forest_links(of, reach(64 * lanes), reach(64), similarity, **how).select("u", "v").distinct()
    links = written(compare(nodes, each_pair=True), "links")
    checked = _checked(links, docs, words, similarity, small)
    # Written, as several plans below read it.
    parts = written(connected_components(checked.where("good").select("u", "v")), "parts")
    # Candidates that closed a circle were left out, and a link they were left out for may have failed: what a failed link
    # leaves apart is compared again, part against part, with every candidate checked.
    part = lambda of, end, name: of.join(parts.select(F.col("node").alias(end), F.col("component").alias("_c")), end, "left").withColumn(name, F.coalesce("_c", end)).drop("_c")
    failed = part(part(checked.where("not good").select("u", "v"), "u", "a"), "v", "b").where("a <> b")
    apart = written(failed.select(F.explode(F.array("a", "b")).alias("part")).distinct(), "apart")
    final = parts.select("node", F.col("component").alias("part"))
    if not apart.isEmpty():
        unsettled = written(part(nodes, "node", "part").join(apart, "part", "left_semi"), "unsettled")
        more = part(part(written(compare(_with_sets(unsettled, docs, words, small), chunk=SET_CHUNK), "links"), "u", "a"), "v", "b")
        merged = connected_components(more.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
        every = part(nodes.select("node"), "node", "part")
        final = every.join(merged.withColumnRenamed("node", "part"), "part", "left").select("node", F.coalesce("component", "part").alias("part"))
    same = prints.join(nodes.withColumnRenamed("node", "least"), [*f, "n_shingles", "set_hash"]).select("doc_id", "least").distinct()
    grouped = same.join(final, same.least == final.node, "left").select("doc_id", F.coalesce("part", "least").alias("component_id"))
    return grouped.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
