"""Unified diffs as tables of files, hunks and lines.

A diff's text becomes one row per line, with its file, hunk and line numbers. Hunk contents are told from headers by the counts that
the hunk header announces, so a removed line that looks like a header stays a line."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import normalise

#: What makes a path a test, and one that the runner collects.
TEST_DIRS = ("test", "tests", "testing")
TEST_NAME = r"^(?:test_.+|.+_test|conftest)\.py$"
COLLECTED_NAME = r"^(?:test_.+|.+_test)\.py$"

_GIT = r"^diff --git (.+)$"
_HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def is_test(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, TEST_DIRS))) | F.element_at(parts, -1).rlike(TEST_NAME)


def is_collected(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1).rlike(COLLECTED_NAME)


@F.pandas_udf(T.StringType())
def unquoted(paths: pd.Series) -> pd.Series:
    """Paths in C quotes, as git writes names with bytes beyond ASCII; others unchanged."""
    simple = {"\\": b"\\", '"': b'"', "t": b"\t", "n": b"\n", "r": b"\r"}

    def one(path: str | None) -> str | None:
        if path is None or len(path) < 2 or path[0] != '"' or path[-1] != '"':
            return path
        body, out, i = path[1:-1], b"", 0
        while i < len(body):
            c = body[i]
            if c == "\\" and body[i + 1 : i + 4].isdigit() and len(body[i + 1 : i + 4]) == 3:
                out += bytes([int(body[i + 1 : i + 4], 8) & 255])
                i += 4
            elif c == "\\" and body[i + 1 : i + 2] in simple:
                out += simple[body[i + 1]]
                i += 2
            else:
                out += c.encode()
                i += 1
        return out.decode("utf-8", "replace")

    return paths.map(one)


def _named(raw: Column) -> Column:
    """The part of a header that names a path, in its quotes if it has any."""
    return F.trim(F.when(raw.startswith('"'), F.regexp_extract(raw, r'^(".*")', 1)).otherwise(F.element_at(F.split(raw, "\t"), 1)))


def _path(raw: Column, quotes: bool = True) -> Column:
    """A header's path without its side's prefix."""
    plain = unquoted(_named(raw)) if quotes else _named(raw)
    return F.when(plain == "/dev/null", plain).otherwise(F.regexp_replace(plain, "^[ab]/", ""))


def _git_paths(rest: Column) -> tuple[Column, Column]:
    """Old and new path of a `diff --git` line: of the cuts at ` b/` the one that makes both equal, else the first and the last."""
    same = F.regexp_extract(rest, r"^a/(.+) b/\1$", 1)
    quoted = r'^("(?:[^"\\]|\\.)*"|a/.*?) ("(?:[^"\\]|\\.)*"|b/.*)$'
    old = F.when(same != "", same).when(rest.contains('"'), _path(F.regexp_extract(rest, quoted, 1))).otherwise(_path(F.regexp_extract(rest, r"^(.*?) b/", 1), quotes=False))
    new = F.when(same != "", same).when(rest.contains('"'), _path(F.regexp_extract(rest, quoted, 2))).otherwise(F.regexp_extract(rest, r"^.* b/(.*)$", 1))
    return old, new


#: What ends a line, as in functions.text.lines.
_ENDS = re.compile("\r\n|[\n\r\v\f\x1c\x1d\x1e\x85\u2028\u2029]")
#: Lines of diffs that are sent on at once.
SEND_LINES = 10_000
_FIELDS = [("ix", T.IntegerType()), ("raw", T.StringType()), ("role", T.StringType()), ("file_ix", T.IntegerType()), ("hunk_ix", T.IntegerType()), ("kind", T.StringType()), ("old_no", T.LongType()), ("new_no", T.LongType())]


def parse(df: DataFrame, key: str, diff: str) -> DataFrame:
    """One row per line of the diffs' hunks and per header line: key, ix, raw, role, file_ix, hunk_ix, kind, text, old_no, new_no.

    role: git, hunk, line or meta. Lines before the first file header, and nulls, give none. Numbers of files and
    hunks count from 1 within a diff. A diff is one text and is walked through where it lies: nothing is shuffled."""
    src = df.select(F.col(key).alias("key"), F.col(diff).cast("string").alias("diff"))
    schema = T.StructType([src.schema["key"], *(T.StructField(n, t) for n, t in _FIELDS)])
    types = [to_arrow_type(t) for _, t in _FIELDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = [], []
            for k in range(batch.num_rows):
                before = len(rows)
                rows += _walk(batch.column(1)[k].as_py() or "")
                at += [k] * (len(rows) - before)
                # Small diffs go out together.
                if rows and (len(rows) >= SEND_LINES or k == batch.num_rows - 1):
                    keys = batch.column(0).take(pa.array(at, pa.int64()))
                    yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, t) for c, t in zip(zip(*rows), types))], schema.names)
                    rows, at = [], []

    return src.mapInArrow(run, schema).withColumn("text", F.when(F.col("role") == "line", F.substring("raw", 2, 1 << 30)))


def _walk(text: str) -> Iterator[tuple]:
    """Rows of one diff. How many old and new lines a hunk still has room for decides whether a row is content."""
    git, mark = re.compile(_GIT), re.compile(_HUNK)
    rows = _ENDS.split(text)
    if rows[-1] == "":
        rows.pop()
    file_ix = hunk_ix = old = new = old_left = new_left = 0
    for ix, raw in enumerate(rows):
        role, kind, a, b = "meta", None, None, None
        first = raw[:1] or " "
        if (old_left > 0 or new_left > 0) and first in "+- ":
            role, kind = "line", first
            if first != "+":
                a, old, old_left = old, old + 1, old_left - 1
            if first != "-":
                b, new, new_left = new, new + 1, new_left - 1
        elif git.match(raw):
            role, file_ix, hunk_ix, old_left, new_left = "git", file_ix + 1, 0, 0, 0
        elif file_ix and (m := mark.match(raw)):
            role, hunk_ix = "hunk", hunk_ix + 1
            old, new = int(m[1]), int(m[3])
            old_left, new_left = int(m[2] or 1), int(m[4] or 1)
        if file_ix:
            yield ix, raw, role, file_ix, hunk_ix, kind, a, b


def files(parsed: DataFrame) -> DataFrame:
    """One row per file: key, file_ix, path, old_path, is_new, is_deleted, is_binary, is_rename, and what the paths say of tests."""
    rest = F.regexp_extract("raw", _GIT, 1)
    old, new = _git_paths(rest)
    is_git, meta = F.col("role") == "git", (F.col("role") == "meta") & (F.col("hunk_ix") == 0)
    at = lambda cond, value: F.max_by(F.when(cond, value), F.when(cond, F.col("ix")))
    starts = lambda s: meta & F.col("raw").startswith(s)
    header = lambda s: starts(s) & (F.col("named") != "/dev/null")
    any_ = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    none = lambda s: starts(s) & (F.col("named") == "/dev/null")
    # Quotes are taken off once, whatever the header.
    named = F.when(starts("--- ") | starts("+++ "), _named(F.substring("raw", 5, 1 << 30))).when(starts("rename from "), F.trim(F.substring("raw", 13, 1 << 30))).when(starts("rename to "), F.trim(F.substring("raw", 11, 1 << 30)))
    side = F.regexp_replace("named", "^[ab]/", "")
    f = parsed.where(F.col("role") != "line").withColumn("named", unquoted(named)).groupBy("key", "file_ix").agg(
        at(is_git, new).alias("git_new"), at(is_git, old).alias("git_old"),
        at(header("--- "), side).alias("minus"), at(header("+++ "), side).alias("plus"),
        at(starts("rename from "), F.col("named")).alias("moved_from"), at(starts("rename to "), F.col("named")).alias("moved_to"),
        any_(starts("new file mode") | none("--- ")).alias("is_new"), any_(starts("deleted file mode") | none("+++ ")).alias("is_deleted"),
        any_(starts("Binary files ") | starts("GIT binary patch")).alias("is_binary"), any_(starts("rename from ") | starts("rename to ")).alias("is_rename"),
    )
    f = f.select("key", "file_ix", F.coalesce("plus", "moved_to", "git_new").alias("path"), F.coalesce("minus", "moved_from", "git_old").alias("old_path"), "is_new", "is_deleted", "is_binary", "is_rename")
    was = F.coalesce(F.nullif("old_path", F.lit("")), F.col("path"))
    f = f.withColumns({"is_test": is_test(F.col("path")), "was_test": is_test(was), "is_collected": is_collected(F.col("path")), "was_collected": is_collected(was)})
    return f.withColumn("hides_tests", F.col("is_rename") & F.col("was_collected") & ~F.col("is_collected"))


def hunks(parsed: DataFrame) -> DataFrame:
    """One row per hunk: key, file_ix, hunk_ix and what its header says."""
    part = lambda i, absent: F.coalesce(F.nullif(F.regexp_extract("raw", _HUNK, i), F.lit("")).cast("long"), F.lit(absent))
    return parsed.where("role = 'hunk'").select("key", "file_ix", "hunk_ix", part(1, 0).alias("old_start"), part(2, 1).alias("old_count"), part(3, 0).alias("new_start"), part(4, 1).alias("new_count"))


def diff_lines(parsed: DataFrame) -> DataFrame:
    """One row per line of a hunk: key, file_ix, hunk_ix, ix, kind, text, norm, old_no, new_no."""
    return parsed.where("role = 'line'").select("key", "file_ix", "hunk_ix", "ix", "kind", "text", normalise(F.col("text")).alias("norm"), "old_no", "new_no")


def signature(parsed: DataFrame) -> DataFrame:
    """The distinct changed lines of each file: key, path, kind, norm."""
    named = diff_lines(parsed).join(files(parsed).select("key", "file_ix", "path"), ["key", "file_ix"])
    return named.where("kind in ('+', '-') and norm <> ''").select("key", "path", "kind", "norm").distinct()
