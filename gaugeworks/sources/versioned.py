"""Tables whose versions appear whole or not at all.

Tasks write Parquet files of a version that nobody reads yet. When all are done, one small note makes them the next version; if the write fails,
the version before stays as it was, and the files are removed (one that a task still ends afterwards is in no note, so nobody reads it). A writer says which version it read: if another one is the newest by
then, it is refused. A table also has a layout number, and one of another layout is neither read nor written over."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .files import place


class VersionConflict(RuntimeError):
    pass


def newest(path: str) -> dict:
    """The note of the newest version: version, layout, schema, files, rows. Version 0 if there is none."""
    from pyarrow import fs

    files, root = place(path.rstrip("/"))
    if files.get_file_info(root).type == fs.FileType.NotFound:
        return {"version": 0, "layout": None, "schema": None, "files": [], "rows": 0}
    notes = sorted(f.path for f in files.get_file_info(fs.FileSelector(root)) if f.base_name.startswith("version-"))
    if not notes:
        return {"version": 0, "layout": None, "schema": None, "files": [], "rows": 0}
    with files.open_input_stream(notes[-1]) as f:
        return json.loads(f.read())


def _check_layout(note: dict, layout: int, path: str) -> None:
    if note["version"] and note["layout"] != layout:
        raise VersionConflict(f"{path} has layout {note['layout']}, not {layout}")


@dataclass
class Part(InputPartition):
    file: str


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int


class VersionedReader(DataSourceReader):
    def __init__(self, path: str, note: dict, names: list[str]):
        self.path, self.note, self.names = path, note, names

    def partitions(self) -> list[Part]:
        return [Part(f) for f in self.note["files"]] or [Part("")]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part.file:
            files, root = place(self.path)
            with files.open_input_file(f"{root}/{part.file}") as f:
                yield from pq.ParquetFile(f).iter_batches(columns=self.names)


class VersionedWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, expect: int, layout: int):
        self.path, self.schema, self.expect, self.layout, self.own = path, schema, expect, layout, uuid.uuid4().hex
        note = newest(path)
        _check_layout(note, layout, path)
        if note["version"] != expect:
            raise VersionConflict(f"{path} is at version {note['version']}, not {expect}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = place(self.path)
        name, rows, out = f"data/{self.own}-{uuid.uuid4().hex}.parquet", 0, None
        try:
            for batch in iterator:
                if out is None:
                    files.create_dir(f"{root}/data", recursive=True)
                    out = pq.ParquetWriter(files.open_output_stream(f"{root}/{name}"), batch.schema, compression="zstd")
                out.write_batch(batch)
                rows += batch.num_rows
        finally:
            if out is not None:
                out.close()
        return Written(name if out is not None else None, rows)

    def commit(self, messages: list) -> None:
        files, root = place(self.path)
        note = newest(self.path)
        if note["version"] != self.expect:
            self.abort(messages)
            raise VersionConflict(f"{self.path} came to version {note['version']} while version {self.expect + 1} was written")
        parts = [m for m in messages if m is not None and m.file]
        made = {"version": self.expect + 1, "layout": self.layout, "schema": self.schema.json(), "files": sorted(m.file for m in parts), "rows": sum(m.rows for m in parts)}
        files.create_dir(root, recursive=True)
        with files.open_output_stream(f"{root}/.note-{self.own}") as out:
            out.write(json.dumps(made).encode())
        files.move(f"{root}/.note-{self.own}", f"{root}/version-{made['version']:012d}.json")

    def abort(self, messages: list) -> None:
        """Removes what this write has left so far, of tasks that ended and of those that didn't."""
        from pyarrow import fs

        files, root = place(self.path)
        if files.get_file_info(f"{root}/data").type != fs.FileType.NotFound:
            for f in files.get_file_info(fs.FileSelector(f"{root}/data")):
                if f.base_name.startswith(self.own):
                    files.delete_file(f.path)


class VersionedSource(DataSource):
    """``versioned``: the newest version of the table under ``path``. Options: path, layout, and to write expect, the version that was read."""

    @classmethod
    def name(cls) -> str:
        return "versioned"

    @property
    def _path(self) -> str:
        return self.options["path"].rstrip("/")

    def schema(self) -> StructType:
        note = newest(self._path)
        if not note["version"]:
            raise FileNotFoundError(f"{self._path} has no version")
        return StructType.fromJson(json.loads(note["schema"]))

    def reader(self, schema: StructType) -> VersionedReader:
        note = newest(self._path)
        _check_layout(note, int(self.options["layout"]), self._path)
        return VersionedReader(self._path, note, schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> VersionedWriter:
        return VersionedWriter(self._path, schema, int(self.options["expect"]), int(self.options["layout"]))


def read(spark: SparkSession, path: str, layout: int = 1) -> DataFrame:
    spark.dataSource.register(VersionedSource)
    return spark.read.format("versioned").option("path", path).option("layout", layout).load()


def publish(df: DataFrame, path: str, expect: int, layout: int = 1) -> int:
    """Writes ``df`` as the version after ``expect``, and gives its number."""
    df.sparkSession.dataSource.register(VersionedSource)
    df.write.format("versioned").option("path", path).option("layout", layout).option("expect", expect).mode("append").save()
    return expect + 1
