"""The ledger fold on a stream of operations, with state by ledger and key.

A ledger's amounts lie in maps of the state store, one entry a key, so a micro-batch reads and writes only the keys it
touches. What a stream has come to is read from its checkpoint with the ``statestore`` source."""

from __future__ import annotations

from collections.abc import Iterator, MutableMapping
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ledger import AFTER, ORDER, Ledger, after, columns_of

#: The state store that keyed state needs: setting and value.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start within it keep their state where keyed state can lie."""
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        yield
    finally:
        spark.conf.unset(STORE[0]) if before is None else spark.conf.set(STORE[0], before)


class _Entries(MutableMapping):
    """A map of the state store as a mapping: entries are read when asked for, and written back by ``keep``."""

    def __init__(self, state) -> None:
        self.state, self.own, self.was = state, {}, {}

    def _load(self, key: str):
        if key not in self.own:
            found = self.state.getValue((key,)) if self.state.containsKey((key,)) else None
            self.own[key] = self.was[key] = found[0] if found else None
        return self.own[key]

    def __contains__(self, key) -> bool:
        return self._load(key) is not None

    def __getitem__(self, key):
        found = self._load(key)
        if found is None:
            raise KeyError(key)
        return found

    def __setitem__(self, key, value) -> None:
        self._load(key)
        self.own[key] = value

    def __delitem__(self, key) -> None:
        self[key]
        self.own[key] = None

    def __iter__(self):
        raise TypeError("the entries of a state are not listed")

    __len__ = __iter__

    def keep(self) -> None:
        for key, value in self.own.items():
            if value == self.was[key]:
                continue
            if value is None:
                self.state.removeKey((key,))
            else:
                self.state.updateValue((key,), (value,))


class _Fold(StatefulProcessor):
    def __init__(self, budget: float, names: list[str]) -> None:
        self.budget, self.names = budget, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.settled = handle.getMapState("settled", "key string", "amount double")
        self.reserved = handle.getMapState("reserved", "key string", "amount double")
        self.retired = handle.getMapState("retired", "key string", "n int")
        self.sums = handle.getValueState("sums", "spent double, held double, open bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        maps = [_Entries(s) for s in (self.settled, self.reserved, self.retired)]
        spent, held, open_ = self.sums.get() if self.sums.exists() else (0.0, 0.0, 0)
        book = Ledger(self.budget, maps[0], maps[1], spent, held, open_, maps[2])
        own = pd.concat(list(rows)).sort_values(ORDER, kind="stable", na_position="first")  # one ledger's part of one micro-batch
        out = [after(book, key[0], r) for r in own.itertuples()]
        for m in maps:
            m.keep()
        self.sums.update((book.spent, book.held, book.open))
        yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def fold_stream(operations: DataFrame, ledger: str, budget: float, seq: str = "seq", op: str = "op", key: str = "key", amount: str = "amount") -> DataFrame:
    """As ``operators.ledger.fold``, for a streaming frame; to be started within ``keyed_state``. Operations of a ledger are
    applied by micro-batch, and in the fold's order within one."""
    if budget < 0:
        raise ValueError("a budget must not be negative")
    src, kinds = columns_of(operations, ledger, seq, op, key, amount)
    schema = f"{kinds}, {AFTER}"
    names = [x.split()[0] for x in schema.split(", ")]
    return src.groupBy("ledger").transformWithStateInPandas(_Fold(budget, names), schema, "append", "none")


def kept_entries(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """(ledger, key, settled, reserved) of the stream whose checkpoint lies there, after its last micro-batch or after ``batch``: what
    ``operators.ledger.entries`` gives, and ``operators.ledger.snapshot`` takes."""

    def state(name: str) -> DataFrame:
        reader = spark.read.format("statestore").option("stateVarName", name)
        found = (reader if batch is None else reader.option("batchId", batch)).load(checkpoint)
        null = F.lit(None).cast("double")
        value = F.col("user_map_value.amount")
        return found.select(F.col("key.ledger").alias("ledger"), F.col("user_map_key.key").alias("key"), *((value if name == n else null).alias(n) for n in ("settled", "reserved")))

    both = state("settled").unionByName(state("reserved"))
    return both.groupBy("ledger", "key").agg(F.max("settled").alias("settled"), F.max("reserved").alias("reserved"))
