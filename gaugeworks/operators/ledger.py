"""A spend ledger as a fold over operations.

One ledger's operations depend on one another through its budget, so a ledger is folded in order, in one task; many
ledgers fold in parallel. A task reads its ledgers' sorted operations in batches and holds no more than one ledger's amounts by key."""

from __future__ import annotations

from collections.abc import Callable, Iterator, MutableMapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPERATIONS = ("reserve", "settle", "release", "retire", "adopt")


@dataclass
class Ledger:
    budget: float
    settled: MutableMapping[str, float] = field(default_factory=dict)
    reserved: MutableMapping[str, float] = field(default_factory=dict)
    #: Sums, and how many reservations are open, kept along.
    spent: float = 0.0
    held: float = 0.0
    open: int = 0
    #: Per key a number below which all names of retired amounts are taken.
    retired: MutableMapping[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.budget < 0:
            raise ValueError("a budget must not be negative")

    def _put(self, key: str, amount: float) -> None:
        self.spent += amount - self.settled.get(key, 0.0)
        self.settled[key] = amount

    def _free(self, key: str) -> None:
        if key in self.reserved:
            self.held -= self.reserved.pop(key)
            self.open -= 1

    def apply(self, op: str, key: str, amount: float | None) -> tuple[bool, str]:
        """(whether it took effect, why not)."""
        if op not in OPERATIONS:
            return False, "unknown operation"
        if op in ("reserve", "settle", "adopt") and (amount is None or amount < 0):
            return False, "no amount" if amount is None else "negative amount"
        if op == "reserve":
            if key in self.settled:
                return False, "already settled"
            if self.spent + self.held + amount > self.budget:
                return False, "over budget"
            self._free(key)
            self.reserved[key] = amount
            self.held += amount
            self.open += 1
        elif op in ("settle", "adopt"):
            self._free(key)
            self._put(key, amount)
        elif op == "release":
            self._free(key)
        elif (old := self.settled.pop(key, 0.0)):  # retire: the amount stays under a name of its own
            base, mark, number = key.rpartition("#retired-")
            if mark and number.isdigit():  # a name that was given before is free again
                self.retired[base] = min(self.retired.get(base, 1), int(number))
            n = self.retired.get(key, 1)
            while f"{key}#retired-{n}" in self.settled:
                n += 1
            self.settled[f"{key}#retired-{n}"] = old
            self.retired[key] = n
        return True, ""


def columns_of(operations: DataFrame, ledger: str, seq: str, op: str, key: str, amount: str) -> tuple[DataFrame, str]:
    """The operations under the fold's own names, and the types of ledger and seq for a schema."""
    src = operations.select(F.col(ledger).alias("ledger"), F.col(seq).alias("seq"), F.col(op).alias("op"), F.col(key).cast("string").alias("key"), F.col(amount).cast("double").alias("amount"))
    kind = {f.name: f.dataType.simpleString() for f in src.schema}
    return src, f"ledger {kind['ledger']}, seq {kind['seq']}"


#: Columns after an operation, behind ledger and seq; the order of operations, ties included.
AFTER = "granted boolean, reason string, settled double, reserved double, remaining double, open bigint"
ORDER = ["seq", "op", "key", "amount"]


def after(book: Ledger, ledger, r) -> tuple:
    """The row that the fold gives for the operation ``r``, once it is applied."""
    granted, why = book.apply(r.op, r.key, None if pd.isna(r.amount) else r.amount)
    return ledger, r.seq, granted, why, book.spent, book.held, book.budget - book.spent - book.held, book.open


def _none(x):
    return None if pd.isna(x) else x


def _pass(src: DataFrame, budget: float, schema: str, each: Callable | None, end: Callable | None) -> DataFrame:
    """One sorted pass: ``each`` (book, ledger, operation) gives a row, ``end`` (book, ledger) the rows of a ledger that is over."""
    if budget < 0:
        raise ValueError("a budget must not be negative")
    names = [x.split()[0] for x in schema.split(", ")]
    sorted_ = src.repartition("ledger").sortWithinPartitions("ledger", *ORDER)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book, now, rows = None, None, []
        for pdf in frames:
            for r in pdf.itertuples():
                at = _none(r.ledger)
                if book is None or at != now:
                    if book is not None and end:
                        rows.extend(end(book, now))
                    book, now = Ledger(budget), at
                if each:
                    rows.append(each(book, now, r))
                else:
                    after(book, now, r)
            yield pd.DataFrame(rows, columns=names)
            rows = []
        if book is not None and end:
            yield pd.DataFrame(list(end(book, now)), columns=names)

    return sorted_.mapInPandas(run, schema)


def fold(operations: DataFrame, ledger: str, budget: float, seq: str = "seq", op: str = "op", key: str = "key", amount: str = "amount") -> DataFrame:
    """One row per operation: ledger, seq, granted, reason, settled, reserved, remaining, open (reservations) after it.
    Operations that tie in ``seq`` follow by op, key and amount; rows without a ledger are one ledger of their own."""
    src, kinds = columns_of(operations, ledger, seq, op, key, amount)
    return _pass(src, budget, f"{kinds}, {AFTER}", after, None)


def entries(operations: DataFrame, ledger: str, budget: float, seq: str = "seq", op: str = "op", key: str = "key", amount: str = "amount") -> DataFrame:
    """(ledger, key, settled, reserved): what each ledger holds at its end, retired amounts under their own names."""
    src, kinds = columns_of(operations, ledger, seq, op, key, amount)

    def end(book: Ledger, now) -> Iterator[tuple]:
        for k in {**book.settled, **book.reserved}:
            yield now, k, book.settled.get(k), book.reserved.get(k)

    return _pass(src, budget, f"{kinds.split(', ')[0]}, key string, settled double, reserved double", None, end)


def snapshot(entries: DataFrame, budget: float) -> DataFrame:
    """A row a ledger from its ``entries``, of the batch or of a stream's state: ledger, budget, settled, reserved, open, n_settled, committed, remaining."""
    zero = F.lit(0.0)
    out = entries.groupBy("ledger").agg(F.coalesce(F.sum("settled"), zero).alias("settled"), F.coalesce(F.sum("reserved"), zero).alias("reserved"), F.count("reserved").alias("open"), F.count("settled").alias("n_settled"))
    committed = F.col("settled") + F.col("reserved")
    return out.withColumns({"budget": F.lit(float(budget)), "committed": committed, "remaining": F.lit(float(budget)) - committed})


def balances(operations: DataFrame, ledger: str, seq: str = "seq", op: str = "op", key: str = "key", amount: str = "amount") -> DataFrame:
    """What is settled per ledger where reservations don't matter: the last settled amount of each key, in plain aggregation."""
    done = operations.where(F.col(op).isin("settle", "adopt"))
    last = done.groupBy(F.col(ledger).alias("ledger"), F.col(key).alias("key")).agg(F.max_by(amount, seq).alias("amount"))
    return last.groupBy("ledger").agg(F.sum("amount").alias("settled"), F.count("*").alias("n_keys"))
