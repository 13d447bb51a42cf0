"""Frames of audits: building them with content hashes, and checking that they can be built again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frame(df: DataFrame, id_: str, content: str, flag: str) -> DataFrame:
    """(record, sha256, flagged) of each row."""
    return df.select(F.col(id_).alias("record"), F.sha2(F.col(content), 256).alias("sha256"), F.coalesce(F.col(flag), F.lit(False)).alias("flagged"))


def differences(old: DataFrame, new: DataFrame, key: str = "record", facets: Sequence[str] = ("sha256", "flagged")) -> DataFrame:
    """Records whose frames differ: gone, new, or changed in a facet. No rows: the frame is reproducible."""
    a = old.select(key, F.lit(True).alias("_old"), *(F.col(c).alias(f"{c}_old") for c in facets))
    b = new.select(key, F.lit(True).alias("_new"), *(F.col(c).alias(f"{c}_new") for c in facets))
    both = a.join(b, key, "full")
    changed = F.array_compact(F.array(*(F.when(~F.col(f"{c}_old").eqNullSafe(F.col(f"{c}_new")), c) for c in facets)))
    what = F.when(F.col("_new").isNull(), F.array(F.lit("gone"))).when(F.col("_old").isNull(), F.array(F.lit("new"))).otherwise(changed)
    return both.select(key, what.alias("what")).where("size(what) > 0")


def recalled(named: DataFrame, reference: DataFrame, by: str, path: str) -> DataFrame:
    """(by, path) of reference files whose base name was named; of reference files with one base name the last counts."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    wanted = reference.groupBy(by, base(F.col(path)).alias("base")).agg(F.max(path).alias(path))
    return wanted.join(named.select(by, base(F.col(path)).alias("base")).distinct(), [by, "base"], "left_semi").select(by, path)


def pin_changes(lines: DataFrame, by: str, kind: str, text: str) -> DataFrame:
    """Per group the packages whose requirement lines were only removed, and only added."""
    package = F.lower(F.regexp_extract(F.trim(text), r"""^["']?([A-Za-z0-9][A-Za-z0-9._-]*)""", 1))
    own = lines.where(F.col(kind).isin("+", "-")).select(by, F.col(kind).alias("_kind"), package.alias("_package")).where("_package <> ''")
    of = lambda sign: F.collect_set(F.when(F.col("_kind") == sign, F.col("_package")))
    sets = own.groupBy(by).agg(of("-").alias("gone"), of("+").alias("come"))
    return sets.select(by, F.array_sort(F.array_except("gone", "come")).alias("removed"), F.array_sort(F.array_except("come", "gone")).alias("added"))
