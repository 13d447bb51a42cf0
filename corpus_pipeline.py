"""From raw documents to packed training sequences, in five written stages.

Every stage but the last takes and gives the columns of documents; other columns of its input are left out. Null and
empty texts are documents like others; a stage works row by row, so rows that share a doc_id keep their own texts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import new_path, written
from gaugeworks.llm.decontamination import overlaps
from gaugeworks.llm.exact_dedup import exact_duplicates
from gaugeworks.llm.packing import pack
from gaugeworks.llm.quality import THRESHOLD, score_quality, train_quality
from gaugeworks.llm.simhash import near_duplicates

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Rows to leave out that are sent to every task (8 bytes each); beyond it both sides are shuffled.
SEND_UP_TO = 200_000


def _only(docs: DataFrame) -> DataFrame:
    return docs.select(*(c for c in COLUMNS if c in docs.columns))


def _by_place(docs: DataFrame) -> DataFrame | None:
    """``docs`` with _row, made of the file (by its place among the sorted paths) and the row's place in it, if each row of
    ``docs`` is one of a file's: nothing is copied, and a task that is run again finds the same numbers."""
    try:
        placed = docs.select(*(c for c in COLUMNS if c in docs.columns), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    except AnalysisException:  # not read from files
        return None
    # One row per file, whose names the driver has listed anyway.
    files = placed.select("_file").distinct().select("_file", (F.row_number().over(Window.orderBy("_file")) * F.lit(1 << 40)).alias("_base"))
    numbered = placed.join(F.broadcast(written(files, "files")), "_file").withColumn("_row", F.col("_base") + F.col("_at")).drop("_file", "_base", "_at")
    repeated = numbered.groupBy("_row").count().where("count > 1")  # rows that were multiplied after reading
    return numbered if repeated.isEmpty() else None


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number _row of its own for each row, that stays: by place in the files they are read from, else written."""
    placed = _by_place(docs)
    if placed is not None:
        return placed
    numbered, path = _only(docs).withColumn("_row", F.monotonically_increasing_id()), new_path(docs.sparkSession, "numbered")
    numbered.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(numbered.schema).parquet(path)


def _without(numbered: DataFrame, gone: DataFrame) -> DataFrame:
    gone = written(gone.select("_row").distinct(), "gone")
    few = gone.count() <= SEND_UP_TO
    return numbered.join(F.broadcast(gone) if few else gone, "_row", "left_anti").drop("_row")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at the threshold or above. The model learns from the labelled rows of ``docs`` outside
    fold 0; null and empty texts get the score of a text without indicators, repeated rows the same score. No rows: none."""
    docs = _only(docs)
    model = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model).where(F.col("quality_score") >= THRESHOLD).drop("quality_score")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal but for white space: the longest, then the
    smallest doc_id (null last), of repeated rows one. Null and empty texts are one group. No rows: none."""
    numbered = _numbered(docs)
    return _without(numbered, exact_duplicates(numbered, row_col="_row").where("not kept").select(F.col("row").alias("_row")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five words, similarity 0.8): the smallest doc_id (null last), of
    repeated rows one. Texts without words, null ones too, are one group. No rows: none."""
    numbered = _numbered(docs)
    groups = near_duplicates(numbered, id_col="_row").select(F.col("doc_id").alias("_row"), "component_id")
    named = groups.join(numbered.select("_row", "doc_id"), "_row")
    best = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("best"), F.count("*").alias("n"))
    best = best.where("n > 1").select("component_id", F.col("best._row").alias("stays"))
    return _without(numbered, named.join(best, "component_id").where(F.col("_row") != F.col("stays")))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap with a benchmark item. Null and empty texts have none; of rows that share a doc_id
    only those go that overlap. No rows: none."""
    numbered = _numbered(docs)
    hit = overlaps(numbered, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="_row")
    return _without(numbered, hit.select(F.col("doc_id").alias("_row")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what stayed, in sequences of at most 1024 tokens, with the columns of ``pack``. Null and empty texts are
    an end token alone; null ids and repeated rows are packed like others. No rows: none."""
    return pack(docs, added=True)


STAGES = [("quality", quality), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("decontamination", decontaminate), ("packing", packing)]

#: No stage but exact dedup can be put in SQL whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
