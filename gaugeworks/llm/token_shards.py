"""Training-order materialisation of token ids.

The ids of all documents, each followed by an end id, form one stream in the order of the table. It is cut
into sequences of one length; sequence number i gets the slot that a keyed Feistel permutation of the N sequences,
with cycle-walking, gives i. Equal ranges of slots are the shards, written as records of one stride, so a slot's
shard and place follow from the slot alone and a reader can go on anywhere.

Ids are made once and stored; then their number is known, and they are moved once, to their shards."""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, new_path, sums_in_order, values, written
from .tokens import encoder, vocabulary

SEQUENCE, END_ID, ROUNDS = 1024, 0, 6
#: Records in a shard: with two bytes an id, 32 MB.
PER_SHARD = 16 * 1024
#: Ids in a stored stretch of the stream; level of compression of what is stored and moved on the way.
STRETCH, LEVEL = 8 * 1024, 3
#: Words that a task remembers: all it does is encode, so there is room for more of them than elsewhere.
WORDS = 450_000
#: Parts of the input whose places are sent to every task; beyond it both sides are shuffled.
PARTS_UP_TO = 200_000


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slots of ``index`` (0 to n - 1) under a keyed permutation of n numbers: a balanced Feistel
    network on the least even number of bits that holds n, walked on while it is outside."""
    if n > 1 << 62:
        raise ValueError("more than 2^62 sequences")
    half = np.uint64(max(1, ((max(n - 1, 1)).bit_length() + 1) // 2))
    low = (np.uint64(1) << half) - np.uint64(1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (1 << 64) - 1))
    out = np.asarray(index).astype(np.uint64)
    walk = np.arange(len(out))
    while len(walk):
        x = out[walk]
        left, right = x >> half, x & low
        for k in keys:
            left, right = right, left ^ (mix(right + k) & low)
        x = (left << half) | right
        out[walk] = x
        walk = walk[x >= n]
    return out.astype(np.int64)


def _origin(docs: DataFrame) -> list[Column]:
    """What names the part of the table that a row was read with, in table order: a file and the place of a block in it,
    however files are split; nothing where rows don't come from files."""
    try:
        docs.select("_metadata.file_path", "_metadata.file_block_start")
    except AnalysisException:
        return [F.lit("").alias("file"), F.lit(0).cast("long").alias("start")]
    return [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]


def stretches(docs: DataFrame, path: str, end_id: int, id_width: int, id_col: str, text_col: str, added: bool, size: int = STRETCH) -> DataFrame:
    """(file, start, task, turn, at, n, docs, doc_at, ids): each part's ids in order, cut at every ``size`` ids. A part is what one task
    reads of a block without a break; task, turn: which task and its how manieth part. at: the ids of the part
    before. docs, doc_at: the documents that begin in the stretch or reach into it, and where in the part they begin."""
    src = docs.select(*_origin(docs), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = src.schema["doc_id"].dataType
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([
        T.StructField("file", T.StringType()), T.StructField("start", T.LongType()), T.StructField("task", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("at", T.LongType()), T.StructField("n", T.LongType()),
        T.StructField("docs", T.ArrayType(kind)), T.StructField("doc_at", longs), T.StructField("ids", T.BinaryType()),
    ])
    end = end_id.to_bytes(id_width, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, at, held, marks = encoder(path, added, WORDS), None, 0, bytearray(), []
        arrow, task, turn = None, TaskContext.get().partitionId(), 0

        def cut(least: int) -> Iterator[tuple]:
            nonlocal at, marks
            while len(held) >= max(1, least) * id_width:
                n = min(size, len(held) // id_width)
                own = [m for m in marks if m[1] < at + n]
                yield (*part, task, turn, at, n, [m[0] for m in own], [m[1] for m in own], bytes(held[: n * id_width]))
                del held[: n * id_width]
                at += n
                marks = own[-1:] + marks[len(own) :]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [[]] * 9
            types = [pa.string(), *[pa.int64()] * 5, pa.list_(arrow), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], schema.names)

        for batch in batches:
            arrow, rows = batch.column(2).type, []
            for file, start, doc, text in zip(*map(values, batch.columns)):
                if (file, start) != part:
                    if part is not None:
                        rows += cut(1)
                    part, at, marks, turn = (file, start), 0, [], turn + 1
                marks.append((doc, at + len(held) // id_width))
                held += _packed(enc.ids(text), id_width) + end
                rows += cut(size)
            yield made(rows)
        if held:
            yield made(list(cut(1)))

    return src.mapInArrow(run, schema)


def _before(stored: DataFrame) -> DataFrame:
    """(task, turn, before), written: the ids of the stream before each part. The stream follows files and blocks if each block was
    read by one task without a break; else rows were moved after reading, and it follows tasks and their turns."""
    parts = written(stored.groupBy("file", "start", "task", "turn").agg(F.sum("n").alias("n")), "parts")
    moved = not parts.groupBy("file", "start").count().where("count > 1").isEmpty()
    order = ["task", "turn"] if moved else ["file", "start"]
    return written(sums_in_order(parts, order, "n").select("task", "turn", "before"), "parts-before")


def _moved(placed: DataFrame, length: int, id_width: int, n: int, per_shard: int, key: int) -> DataFrame:
    """(shard, slots, indices, within, sizes, first_docs, first_starts, ids): the pieces of a batch's sequences by shard. A sequence
    that a stretch's end cuts has several pieces; ids: theirs, one after another, compressed."""
    kind = placed.schema["docs"].dataType
    longs = T.ArrayType(T.LongType())
    names = ["slots", "indices", "within", "sizes"]
    schema = T.StructType([
        T.StructField("shard", T.IntegerType()), *(T.StructField(c, longs) for c in names), T.StructField("first_docs", kind), T.StructField("first_starts", longs), T.StructField("ids", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            by: dict[int, tuple[list, ...]] = {}
            arrow = batch.column(3).type
            rows = list(zip(*map(values, batch.columns)))
            cuts = [[0, *range(length - (before + at) % length, size, length), size] for before, at, size, *_ in rows]
            indices = [range((row[0] + row[1]) // length, (row[0] + row[1]) // length + len(c) - 1) for row, c in zip(rows, cuts)]
            slots = iter(permute(np.array([i for own in indices for i in own], dtype=np.int64), n, key).tolist())  # of the whole batch at once
            for (before, at, size, docs, doc_at, ids), cut, index in zip(rows, cuts, indices):
                pos = before + at
                for i, a, b in zip(index, cut, cut[1:]):
                    slot = next(slots)
                    within, k = (pos + a) % length, bisect_right(doc_at, at + a) - 1
                    own = by.setdefault(slot // per_shard, ([], [], [], [], [], [], []))
                    first = (docs[k], at + a - doc_at[k]) if within == 0 else (None, None)
                    for col, v in zip(own, (slot, i, within, b - a, *first, ids[a * id_width : b * id_width])):
                        col.append(v)
            rows = [(shard, *own[:6], pack.compress(b"".join(own[6]))) for shard, own in by.items()]
            cols = list(zip(*rows)) if rows else [[]] * 8
            types = [pa.int32(), *[pa.list_(pa.int64())] * 4, arrow, pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], schema.names)

    return placed.select("before", "at", "n", "docs", "doc_at", "ids").mapInArrow(run, schema)


def write_shards(
    docs: DataFrame, out_dir: str | None = None, length: int = SEQUENCE, key: int = 20_240_601, per_shard: int = PER_SHARD, path: str | None = None, end_id: int = END_ID,
    id_width: int = 2, id_col: str = "doc_id", text_col: str = "text", added: bool = False,
) -> DataFrame:
    """One row per sequence: slot, shard, place (in its shard), sequence (its number in the stream), first_doc, first_start (the document
    of the first id and its place in it), n_ids, crc32 (of the record).

    Writes `shard-<number>.bin` files of ``per_shard`` records of length x id_width bytes into ``out_dir`` (a new folder of the
    shared one if not given): slot = permute(sequence, N, key), shard = slot // per_shard, place = slot % per_shard. A task holds one
    shard. Files appear by a rename when whole, so a task that runs again leaves the same file. Every
    sequence is full but the stream's last one, which is filled up with the end id; a sequence that isn't covered once is an error. The stream follows the table's files
    and their rows, so other splits or cores give the same shards; rows that don't come straight from files (made, shuffled or sorted) follow
    their partitions. added: as of Encoder. Null text: empty, the end id alone; null ids and repeated rows are
    written like others; other columns don't matter; empty table: no rows, no shards."""
    spark = docs.sparkSession
    out_dir = out_dir or new_path(spark, "shards")
    store = new_path(spark, "ids")
    made = stretches(docs, path or vocabulary(), end_id, id_width, id_col, text_col, added)
    made.write.option("compression", "zstd").parquet(store)
    stored = spark.read.schema(made.schema).parquet(store)
    parts = _before(stored)
    total = stored.agg(F.sum("n")).first()[0] or 0
    n = -(-total // length)
    shards = max(1, -(-n // per_shard))
    _write_note(out_dir, {"length": length, "id_width": id_width, "key": key, "end_id": end_id, "per_shard": per_shard, "n": n})
    # A row for each split of the input.
    placed = stored.join(F.broadcast(parts) if parts.count() <= PARTS_UP_TO else parts, ["task", "turn"])
    moved = _moved(placed, length, id_width, n, per_shard, key)
    kind = moved.schema["first_docs"].dataType.elementType
    longs = lambda *names: [T.StructField(c, T.LongType()) for c in names]
    schema = T.StructType([*longs("slot", "shard", "place", "sequence"), T.StructField("first_doc", kind), *longs("first_start", "n_ids", "crc32")])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, _Shard] = {}
        arrow = None
        for batch in batches:
            arrow = batch.column(5).type.value_type
            for shard, *row in zip(*map(values, batch.columns)):
                if shard not in open_:
                    open_[shard] = _Shard(shard, min(per_shard, n - shard * per_shard), length, f"<u{id_width}", end_id, total)
                open_[shard].put(shard * per_shard, *row)
        for shard, own in sorted(open_.items()):
            own.save(out_dir)
            rows = [(shard * per_shard + k, shard, k, own.index[k], own.first[k][0], own.first[k][1], int(own.n_ids[k]), zlib.crc32(own.records[k])) for k in range(len(own.records))]
            cols = list(zip(*rows))
            types = [*[pa.int64()] * 4, arrow, *[pa.int64()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], schema.names)

    return written(moved.repartitionById(shards, "shard").mapInArrow(write, schema), "sequences")


def _packed(ids: bytes, width: int) -> bytes:
    """``ids`` (four bytes each) as ``width`` bytes each; ids that don't fit are an error."""
    wide = np.frombuffer(ids, "<u4")
    if width == 2 and len(wide) and wide.max() >= 1 << 16:
        raise ValueError("ids beyond 65,535 need id_width=4")
    return wide.astype(f"<u{width}").tobytes()


class _Shard:
    """The records of a shard, put together from pieces."""

    def __init__(self, number: int, n: int, length: int, kind: str, end_id: int, total: int):
        self.number, self.width, self.total = number, np.dtype(kind).itemsize, total
        self.pieces: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        self.records = np.full((n, length), end_id, dtype=kind)
        self.index, self.first, self.n_ids = [0] * n, [(None, None)] * n, np.zeros(n, dtype=np.int64)

    def put(self, base: int, slots, indices, within, sizes, docs, starts, ids) -> None:
        flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(ids), self.records.dtype)
        at = 0
        for slot, i, w, size, doc, start in zip(slots, indices, within, sizes, docs, starts):
            k = slot - base
            self.records[k, w : w + size] = flat[at : at + size]
            self.index[k] = i
            self.n_ids[k] += size
            self.pieces[k].append((w, size))
            if start is not None:
                self.first[k] = (doc, start)
            at += size

    def check(self) -> None:
        """Each record was covered once, without a gap: whole, but for the stream's last one."""
        length = self.records.shape[1]
        for index, pieces in zip(self.index, self.pieces):
            upto = 0
            for within, size in sorted(pieces):
                if within != upto:
                    raise RuntimeError(f"sequence {index} of shard {self.number} isn't covered once at {min(within, upto)}")
                upto += size
            if upto != min(length, self.total - index * length):
                raise RuntimeError(f"sequence {index} of shard {self.number} has {upto} ids")

    def save(self, out_dir: str) -> None:
        self.check()
        from pyarrow import fs
        from pyspark import TaskContext

        files, folder = _place(out_dir)
        name = f"{folder}/shard-{self.number:08d}.bin"
        temporary = f"{folder}/.shard-{self.number:08d}-{TaskContext.get().taskAttemptId()}"
        files.create_dir(folder, recursive=True)
        with files.open_output_stream(temporary) as out:
            out.write(self.records.tobytes())
        if files.get_file_info(name).type != fs.FileType.NotFound:  # of an earlier attempt; some stores don't move onto a file
            files.delete_file(name)
        files.move(temporary, name)


def _place(out_dir: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(out_dir) if "://" in out_dir or out_dir.startswith("file:") else (fs.LocalFileSystem(), out_dir)


def _write_note(out_dir: str, note: dict) -> None:
    files, folder = _place(out_dir)
    files.create_dir(folder, recursive=True)
    with files.open_output_stream(f"{folder}/order.json") as out:
        out.write(json.dumps(note).encode())


def read_slots(out_dir: str, first: int = 0, n: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, ids) from slot ``first`` on, in training order: sequential reads of the shards, one seek at the start."""
    files, folder = _place(out_dir)
    with files.open_input_stream(f"{folder}/order.json") as f:
        note = json.loads(f.read())
    stride, kind, per = note["length"] * note["id_width"], f"<u{note['id_width']}", note["per_shard"]
    last = note["n"] if n is None else min(note["n"], first + n)
    while first < last:
        shard, place = divmod(first, per)
        with files.open_input_file(f"{folder}/shard-{shard:08d}.bin") as f:
            f.seek(place * stride)
            for slot in range(first, min(last, (shard + 1) * per)):
                yield slot, np.frombuffer(f.read(stride), kind)
        first = (shard + 1) * per
