"""License scans as an exact set-similarity join, in DataFrame operations alone.

Blocks are windows of words of every document, templates are license texts and notices. Both
are token sets in one global order, rarest first by counts over all documents. A
block meets a template only through a token in both prefixes; length and
positional filters drop pairs that can't share enough tokens, and the rest is compared exactly."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, written
from .license_texts import NOTICES, PHRASES, Template

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CONTAINMENT = 0.8
LEAST_STRIDE = 8
_UPPER, _LOWER = (bytes(range(a, a + 26)).decode() for a in (ord("A"), ord("a")))


def needed(t: Template, containment: float) -> int:
    """The distinct tokens of ``t`` that a block has to hold."""
    n = len(set(t.words))
    return n if t.base else math.ceil(containment * n - 1e-9)


def stride(t: Template) -> int:
    """Blocks for ``t`` start every so many words and hold twice as many: the least power of two that holds the template."""
    return max(LEAST_STRIDE, 1 << (len(t.words) - 1).bit_length())


def _strings(values) -> Column:
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<string>")


def _tokenised(docs: DataFrame, templates: Sequence[Template], containment: float) -> DataFrame:
    """(row, doc_id, n_words, own, strides, words), written: texts are split into words once. own: the templates' tokens that a document
    has; strides: those of the templates of which the whole document has enough tokens; words: kept only where there are such."""
    words = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(WORD), F.lit(0))
    vocabulary = sorted({w for t in templates for w in t.words})
    own = F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary)))
    enough = lambda t: F.size(F.array_intersect("own", _strings(sorted(set(t.words))))) >= needed(t, containment)
    held = F.array_distinct(F.array_compact(F.array(*(F.when(enough(t), F.lit(stride(t))) for t in templates))))
    worded = docs.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", words.alias("words"))
    worded = worded.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), own.alias("own"), "words")
    least = min((needed(t, containment) for t in templates), default=0)
    worded = worded.withColumn("strides", F.when(F.size("own") >= max(1, least), held).otherwise(F.array().cast("array<int>")))
    return written(worded.withColumn("words", F.when(F.size("strides") > 0, F.col("words"))), "license-words")


def document_counts(worded: DataFrame) -> dict[str, int]:
    """In how many documents each token of the templates stands; one row a token reaches the driver."""
    found = worded.select(F.explode("own").alias("token")).groupBy("token").count()
    return {r["token"]: r["count"] for r in found.collect()}


def _prefix(t: Template, containment: float, order: dict[str, int]) -> tuple[list[str], int]:
    """Its tokens, rarest first, and how many of them a block that meets it can't all lack."""
    tokens = sorted(set(t.words), key=order.__getitem__)
    return tokens, len(tokens) - needed(t, containment) + 1


def _index(spark: SparkSession, templates: Sequence[Template], containment: float, order: dict[str, int]) -> DataFrame:
    """A row for each template and token of its prefix."""
    rows = []
    for k, t in enumerate(templates):
        tokens, n = _prefix(t, containment, order)
        for j, token in enumerate(tokens[:n]):
            rows.append((token, stride(t), k, t.label, t.base, t.words, tokens, needed(t, containment), j, list(t.must), list(t.never)))
    schema = "token string, stride int, template int, label string, base boolean, phrase array<string>, tokens array<string>, least int, place int, must array<string>, never array<string>"
    return spark.createDataFrame(rows, schema)


def _blocks(worded: DataFrame, templates: Sequence[Template], containment: float, order: dict[str, int]) -> DataFrame:
    """(row, stride, start, block): windows of the documents' words that hold a token of a prefix."""
    by: dict[int, set[str]] = {}
    for t in templates:
        tokens, n = _prefix(t, containment, order)
        by.setdefault(stride(t), set()).update(tokens[:n])

    def windows(size: int, prefix: list[str]) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)).cast("int"), F.lit(size))
        cut = F.transform(starts, lambda s: F.struct(F.lit(size).alias("stride"), s.alias("start"), F.slice("words", s + 1, 2 * size).alias("block")))
        cut = F.filter(cut, lambda b: F.exists(b["block"], lambda w: w.isin(prefix)))
        return F.when(F.array_contains("strides", size), cut).otherwise(F.array().cast("array<struct<stride:int,start:int,block:array<string>>>"))

    all_ = F.concat(*(windows(size, sorted(prefix)) for size, prefix in sorted(by.items())))
    return worded.where("words is not null").select("row", F.explode(all_).alias("b")).select("row", "b.*")


def _met(blocks: DataFrame, index: DataFrame, ordered: list[str]) -> DataFrame:
    """(row, base, label, share, k, lo, hi): templates that a block meets; k, lo, hi: how often a base phrase stands in it, and where first and last."""
    own = blocks.withColumn("own", F.array_intersect(_strings(ordered), F.col("block")))  # rarest first
    each = own.select("*", F.explode("own").alias("token"))
    # The templates are a fixed list; each row of the index is one token of a template's prefix.
    pairs = each.join(F.broadcast(index), ["token", "stride"])
    at = F.array_position("own", F.col("token")) - 1
    fits = (F.size("own") >= F.col("least")) & (F.least(F.size("own") - at, F.size("tokens") - F.col("place")) >= F.col("least"))
    pairs = pairs.where(fits).withColumn("common", F.array_intersect("own", "tokens"))
    # A pair that shares several prefix tokens is kept once, by the rarest.
    good = (F.size("common") >= F.col("least")) & (F.element_at("common", 1) == F.col("token"))
    good &= (F.size(F.array_except("must", "own")) == 0) & (F.size(F.array_except("never", "block")) == F.size("never"))
    places = F.filter(F.sequence(F.lit(0), F.col("stride") - 1), lambda p: F.slice("block", p + 1, F.size("phrase")) == F.col("phrase"))
    pairs = pairs.where(good).withColumn("places", F.when(F.col("base"), places).otherwise(F.array().cast("array<int>")))
    pairs = pairs.where(~F.col("base") | (F.size("places") > 0))
    start, share = F.col("start").cast("long"), F.size("common") / F.size("tokens")
    return pairs.select("row", "base", "label", share.alias("share"), F.size("places").cast("long").alias("k"), (start + F.array_min("places")).alias("lo"), (start + F.array_max("places")).alias("hi"))


def scan_licenses(docs: DataFrame, templates: Sequence[Template] = PHRASES + NOTICES, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word (of the base phrases' places),
    base_labels, labels (arrays, sorted), score (the greatest containment of a template that is met, else 0).

    A template is met by a window of words that holds at least ``containment`` of its distinct tokens, among them those it
    must have and none that it never has; windows are as long as two to four times the template. A base
    phrase is met where its words stand consecutively. Words: runs of a-z, 0-9 and characters beyond ASCII of the text with
    A-Z lower-cased. Null text: empty. Null ids and repeated rows keep their own row; other columns don't matter. Empty table: no rows."""
    templates = tuple(templates)
    worded = _tokenised(id_and_text(docs, id_col, text_col), templates, containment)
    counts = document_counts(worded)
    ordered = sorted({w for t in templates for w in t.words}, key=lambda w: (counts.get(w, 0), w))
    order = {w: k for k, w in enumerate(ordered)}
    met = _met(_blocks(worded, templates, containment, order), _index(docs.sparkSession, templates, containment, order), ordered)
    found = met.groupBy("row").agg(
        F.sum("k").alias("n_base"), F.min("lo").alias("first_word"), F.max("hi").alias("last_word"), F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))).alias("base_labels"),
        F.sort_array(F.collect_set("label")).alias("labels"), F.max("share").alias("score"),
    )
    none = F.array().cast("array<string>")
    # Documents without enough of any template's tokens don't take part in the join.
    rest = worded.where("words is null").select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_base"), F.lit(None).cast("long").alias("first_word"), F.lit(None).cast("long").alias("last_word"), none.alias("base_labels"), none.alias("labels"), F.lit(0.0).alias("score")
    )
    held = worded.where("words is not null").select("row", "doc_id", "n_words").join(found, "row", "left")
    return rest.unionByName(held.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    ))
