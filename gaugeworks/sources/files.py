"""Files as bytes, in ranges: a reader that cuts files where no pattern can lie over the cut, and a writer of small files.

`ranges` reads each file in pieces that tasks share. A piece ends at a byte that no pattern holds, so every byte, and every match, is
in one piece, however files are cut. A task takes many small pieces, of one or several files. Paths are of any store that pyarrow or
Spark's shared folders name by URI."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.text import SECRET_RULES, secret_hits
from ..shared import written

#: Bytes that may stand in a match of the rules; a file is never cut between two of them.
WITHIN = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_- "
#: Bytes of a piece, about, and of one read beyond its end.
PIECE, STEP = 8 << 20, 64 << 10
#: Bytes that a task reads at least, unless there are fewer; tasks that small inputs are dealt out to, about; bytes that a batch of rows has, about.
LEAST, TASKS, BATCH = 1 << 20, 64, 1 << 20
#: Rules whose matches may hold other bytes, line ends among them; they are for whole texts.
WHOLE_TEXT_RULES = ("named_literal",)


def place(path: str):
    """(file system, path in it) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int]]:
    """(path below ``path``, size) of all files under a folder but hidden ones, sorted."""
    from pyarrow import fs

    files, root = place(path.rstrip("/"))
    found = files.get_file_info(fs.FileSelector(root, recursive=True))
    names = ((f.path[len(root) :].lstrip("/"), f.size) for f in found if f.type == fs.FileType.File)
    return sorted((n, size) for n, size in names if not any(part.startswith((".", "_")) for part in n.split("/")))


@dataclass
class Range(InputPartition):
    name: str
    low: int
    high: int
    size: int


@dataclass
class Share(InputPartition):
    """What one task reads: ranges of one or several files, each of one or more pieces."""

    ranges: list[Range] = field(default_factory=list)


class RangeReader(DataSourceReader):
    """A range a task."""

    def __init__(self, options: dict):
        self.path, self.piece = options["path"], int(options.get("piece", PIECE))

    def partitions(self) -> list[Range]:
        return _ranges(listed(self.path), self.piece)

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        return self.batches([part])

    def batches(self, ranges: list[Range]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for row in self._pieces(ranges):
            rows.append(row)
            held += len(row[2])
            if held >= BATCH:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _pieces(self, ranges: list[Range]) -> Iterator[tuple[str, int, str]]:
        files, root = place(self.path.rstrip("/"))
        for r in ranges:
            with files.open_input_file(f"{root}/{r.name}") as f:
                for at in range(r.low, r.high, self.piece):
                    own, start = _piece(f, replace(r, low=at, high=min(r.high, at + self.piece)))
                    if own:
                        yield r.name, start, own.decode("ascii", "replace")  # a character a byte


class SharedReader(RangeReader):
    """A share of the ranges a task. The pieces are those of ``RangeReader``, however ranges are dealt out."""

    def partitions(self) -> list[Share]:
        files = listed(self.path)
        most = min(PIECE, max(LEAST, sum(size for _, size in files) // TASKS))
        shares, room = [], 0
        for r in _ranges(files, max(1, most // self.piece) * self.piece):
            if room <= 0:
                shares.append(Share())
                room = most
            shares[-1].ranges.append(r)
            room -= r.high - r.low + STEP  # opening a file counts too
        return shares

    def read(self, part: Share) -> Iterator[pa.RecordBatch]:
        return self.batches(part.ranges)


def _ranges(files: list[tuple[str, int]], length: int) -> list[Range]:
    return [Range(name, at, min(size, at + length), size) for name, size in files for at in range(0, size, length)]


def _batch(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
    name, start, text = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(name), pa.array(start, pa.int64()), pa.array(text, pa.large_string()).cast(pa.string())], ["name", "start", "text"])


def _piece(f, part: Range) -> tuple[bytes, int]:
    """The bytes of a range's piece and where they start: from its first byte that may be cut at, to the first such byte behind the range."""
    f.seek(max(0, part.low - 1))
    own = f.read(part.high - max(0, part.low - 1))
    start = part.low
    if part.low:
        head = own.lstrip(WITHIN)  # what the range before has begun
        skipped = len(own) - len(head)
        if skipped == len(own):
            return b"", start
        own, start = (head, part.low - 1 + skipped) if skipped else (own[1:], part.low)
    if own and own[-1] in WITHIN and part.high < part.size:
        beyond, step = [own], STEP >> 6
        while more := f.read(step):
            rest = more.lstrip(WITHIN)
            beyond.append(more[: len(more) - len(rest)])
            if rest:
                break
            step = min(2 * step, STEP)
        own = b"".join(beyond)
    return own, start


class RangeSource(DataSource):
    """``ranges``: name, start and text of the pieces of all files under ``path``. Bytes beyond ASCII are one replacement character
    each. Options: path, piece (bytes of a range)."""

    @classmethod
    def name(cls) -> str:
        return "ranges"

    def schema(self) -> str:
        return "name string, start long, text string"

    def reader(self, schema: StructType) -> SharedReader:
        return SharedReader(self.options)


def read_ranges(spark: SparkSession, path: str, piece: int = PIECE) -> DataFrame:
    spark.dataSource.register(RangeSource)
    return spark.read.format("ranges").option("path", path).option("piece", piece).load()


def secret_findings(pieces: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """(name, rule, line, n): how many matches of each rule start on each line of the files that ``pieces`` (name, start, text) make up.

    The same for any cut: the line of a match is that within its piece and the line ends of the pieces before. An empty file has none."""
    rules = {k: v for k, v in (rules or SECRET_RULES).items() if k not in WHOLE_TEXT_RULES}
    breaks = (F.length("text") - F.length(F.replace("text", F.lit("\n")))).cast("long")
    seen = written(pieces.select("name", "start", breaks.alias("breaks"), secret_hits(F.col("text"), rules).alias("hits")), "piece-hits")
    # A row for each piece of a file, without its text.
    before = F.coalesce(F.sum("breaks").over(Window.partitionBy("name").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hits = seen.withColumn("before", before).where(F.size("hits") > 0).select("name", "before", F.explode("hits").alias("h"))
    return hits.groupBy("name", F.col("h.rule").alias("rule"), (F.col("before") + F.col("h.line")).alias("line")).agg(F.count("*").alias("n"))


def write_files(rows: DataFrame, directory: str) -> int:
    """Writes each row (path, value) as a file below ``directory``, each by a rename when whole, and gives their number. A row that
    is written again, as when a task is repeated, leaves the same file; two rows of one path are an error before anything is written."""
    rows = written(rows.select("path", "value"), "files-to-write")
    twice = rows.groupBy("path").count().where("count > 1 or path is null").limit(1).collect()
    if twice:
        raise ValueError(f"several rows for the file {twice[0]['path']}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, root = place(directory.rstrip("/"))
        for batch in batches:
            for path, value in zip(*(c.to_pylist() for c in batch.columns)):
                folder, _, name = f"{root}/{path}".rpartition("/")
                files.create_dir(folder, recursive=True)
                temporary = f"{folder}/.{name}-{TaskContext.get().taskAttemptId()}"
                with files.open_output_stream(temporary) as out:
                    out.write((value or "").encode())
                files.move(temporary, f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return rows.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
