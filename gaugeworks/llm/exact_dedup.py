"""Exact dedup by deterministic block naming.

Each normalised text is cut into blocks of fixed size. The distinct blocks are sorted
and numbered; then adjacent numbers are paired, and the distinct pairs sorted and
numbered in turn, until one number is left per document. Documents of as many
blocks have equal texts exactly if they have equal numbers: names come from
comparing contents, not from hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Code points in a block.
BLOCK = 4096
WHITE = r"[\x20\x09-\x0D]+"


def _digest(block: Column) -> Column:
    return F.xxhash64(block)


def _numbered(values: DataFrame, *cols: str) -> DataFrame:
    """Distinct ``values`` sorted within their shuffle partitions, with a column
    ``name``: partition and place, an integer of its own for each value."""
    return values.distinct().sortWithinPartitions(*cols).withColumn("name", F.monotonically_increasing_id())


def _block_names(blocks: DataFrame, digest) -> DataFrame:
    """(row, at, name): occurrences of blocks with the blocks' names.

    Contents are shuffled once, to be sorted and named. Occurrences find their
    name by a 64-bit digest; blocks whose digest another block shares are named anew, below zero, and found by content."""
    named = _numbered(blocks.select("block"), "block").select("name", digest(F.col("block")).alias("digest"))
    named = written(named, "block-names")
    shared = written(named.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "shared-digests")
    places = blocks.select("row", "at", digest(F.col("block")).alias("digest"), "block")
    found = places.drop("block").join(named, "digest").select("row", "at", "name")
    if shared.isEmpty():
        return found
    alone = places.drop("block").join(named.join(shared, "digest", "left_anti"), "digest").select("row", "at", "name")
    clash = places.join(shared, "digest", "left_semi")
    fresh = written(_numbered(clash.select("block"), "block").withColumn("name", -1 - F.col("name")), "clash-names")
    return alone.unionAll(clash.join(fresh, "block").select("row", "at", "name"))


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, digest=_digest, row_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: row (a key of its own), doc_id, n_chars (code points of the
    original), text_sha256 (of the text without white space), n_blocks and name.

    (n_blocks, name) is the identity: equal exactly where the texts are equal after
    deleting white space. Null text: empty; the empty text is one empty block.
    block: code points per block. digest: how occurrences look up their blocks;
    any choice gives the same groups. row_col: a column that numbers the rows already."""
    plain = F.regexp_replace("text", WHITE, "")
    row = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    base = docs.select(row.alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.select("row", "doc_id", F.length("text").cast("long").alias("n_chars"), plain.alias("plain"))
    cut = F.regexp_extract_all("plain", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    base = base.withColumn("blocks", F.when(F.col("plain") == "", F.array(F.lit(""))).otherwise(cut))
    rows = written(
        base.select("row", "doc_id", "n_chars", F.sha2("plain", 256).alias("text_sha256"), F.size("blocks").alias("n_blocks"), "blocks"), "blocked"
    )
    blocks = rows.select("row", F.posexplode("blocks").alias("at", "block"))
    places = written(_block_names(blocks, digest), "names")
    heads = rows.select("row", "doc_id", "n_chars", "text_sha256", "n_blocks")
    # One row per document from here on: a document's own names, in order.
    done = places.join(heads.where("n_blocks = 1").select("row"), "row", "left_semi").select("row", "name")
    many = heads.where("n_blocks > 1").select("row")
    open_ = places.join(many, "row", "left_semi").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("s"))
    open_ = written(open_.select("row", F.col("s.name").alias("names")), "open")
    longest = open_.agg(F.max(F.size("names"))).first()[0] or 1
    while longest > 1:
        pairs = open_.select(
            "row", F.posexplode(F.expr("transform(sequence(0, size(names) - 1, 2), i -> struct(names[i] AS a, coalesce(try_element_at(names, i + 2), -1L) AS b))")).alias("at", "pair")
        ).select("row", "at", "pair.a", "pair.b")
        fresh = written(_numbered(pairs.select("a", "b"), "a", "b"), "pair-names")
        again = pairs.join(fresh, ["a", "b"]).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("s"))
        again = written(again.select("row", F.col("s.name").alias("names")), "open")
        done = done.unionAll(again.where("size(names) = 1").select("row", F.col("names")[0].alias("name")))
        open_ = again.where("size(names) > 1")
        longest = (longest + 1) // 2
    return heads.join(done, "row")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, keep_id, group_size, kept, text_sha256, n_chars.

    Of equal texts the row with the most code points in its original text stays,
    then the smallest doc_id (null last); of repeated rows one. keep_id is the doc_id
    of the row that stays. Null text: empty, equal to texts of white space alone. Other columns don't matter; empty table: no rows.
    how: as of identities."""
    rows = written(identities(docs, id_col, text_col, **how), "identities")
    best = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("null_id"), "doc_id", "row"))
    groups = rows.groupBy("n_blocks", "name").agg(best.alias("best"), F.count("*").alias("group_size"))
    groups = groups.select("n_blocks", "name", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"))
    # Written, so that both sides of the join are plain shuffles and a group of very many rows can be split.
    groups = written(groups, "groups")
    return rows.join(groups, ["n_blocks", "name"]).select(
        "row", "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256", "n_chars"
    )
