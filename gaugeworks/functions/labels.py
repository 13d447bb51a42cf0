"""Labels derived from other labels and numbers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Verdicts and their binary class; other labels are no verdicts.
COLLAPSE = {
    "equivalent": "acceptable",
    "agent_wider": "acceptable",
    "agent_narrower": "deficient",
    "agent_different": "deficient",
    "agent_wrong": "deficient",
    "reference_wrong": "deficient",
}
#: Labels that are no verdict.
NON_VERDICTS = ("unclear", "unparseable", "")
#: Least kappa of each standing; above which kappa a band begins.
STANDINGS = ((0.60, "quotable"), (0.40, "screening-only"))
BANDS = ((0.80, "almost perfect"), (0.60, "substantial"), (0.40, "moderate"), (0.20, "fair"))


def mapped(x: Column, table: Mapping[str, str]) -> Column:
    """The value of ``x`` in ``table``, null for any other."""
    return F.create_map(*(F.lit(v) for pair in table.items() for v in pair))[x]


def collapse(verdict: Column) -> Column:
    return mapped(verdict, COLLAPSE)


def is_verdict(label: Column) -> Column:
    return label.isNotNull() & ~label.isin(*NON_VERDICTS)


def standing(kappa: Column) -> Column:
    """What a headline kappa licenses; null for null."""
    (a, first), (b, second) = STANDINGS
    return F.when(kappa >= a, first).when(kappa >= b, second).when(kappa.isNotNull(), "failed")


def kappa_band(kappa: Column) -> Column:
    out = F.when(kappa.isNull(), F.lit(None).cast("string"))
    for floor, name in BANDS:
        out = out.when(kappa > floor, name)
    return out.otherwise("slight")


def outcome_class(valid: Column, progress: Column) -> Column:
    """unscoreable, solved, partial or none. A valid row without progress is an error: absent is never zero."""
    return (
        F.when(~F.coalesce(valid, F.lit(False)), "unscoreable")
        .when(progress.isNull(), F.raise_error(F.lit("a valid score has no progress")))
        .when(progress >= 1, "solved").when(progress > 0, "partial").otherwise("none")
    )


def classify(value: Column, table: Mapping[str, str]) -> Column:
    """The class of a label; one that ``table`` doesn't have is an error."""
    found = mapped(value, table)
    return F.when(found.isNotNull() | value.isNull(), found).otherwise(F.raise_error(F.concat(F.lit("unknown label "), value)))


def first_not_empty(*values: Column) -> Column:
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def route(value: Column) -> Column:
    """Where a call went: absent, empty and named routes stay apart."""
    return F.when(value.isNull(), "not recorded").when(value == "", "direct").otherwise(value)


def chargeable(known: Column, cost: Column, cap: Column, sunk: Column | None = None) -> Column:
    """The cost if known, else the most it can have been. With ``sunk``, what earlier attempts of the cell cost, it
    comes on top, and an attempt that left no record costs nothing more."""
    own = F.when(known, cost).otherwise(cap)
    return own if sunk is None else F.coalesce(sunk, F.lit(0.0)) + F.coalesce(own, F.lit(0.0))


def priced(input_: Column, output: Column, cache_read: Column, cache_write: Column, in_price: Column, out_price: Column) -> Column:
    """Cost of a usage in tokens, prices per million; reads from the cache cost a tenth of input, writes
    a quarter more."""
    return ((input_ + cache_read * 0.10 + cache_write * 1.25) * in_price + output * out_price) / 1_000_000


def credible(valid: Column, n_cheats: Column, progress: Column) -> Column:
    return F.when(valid & (n_cheats == 0), progress).otherwise(0.0)
