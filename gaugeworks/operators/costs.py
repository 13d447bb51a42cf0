"""Costs of calls from their token usage and a price table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def estimated_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """``usage`` (model, input_tokens, output_tokens, cache_read, cache_write) with cost and priced.

    prices: model, input, output (for a million tokens), supports_caching; a small dimension table, one row per model. Cache
    reads cost a tenth of input, writes a quarter more, where the model has a cache. A model without a price is billed
    at the dearest rates, and priced is false. Usage with one of the two token counts missing is an error, with
    both missing it costs nothing."""
    dearest = prices.agg(F.max("input").alias("_in"), F.max("output").alias("_out"))  # one row
    known = usage.join(prices.withColumn("priced", F.lit(True)), "model", "left").crossJoin(F.broadcast(dearest))
    zero = lambda c: F.coalesce(c, F.lit(0))
    partial = F.col("input_tokens").isNull() != F.col("output_tokens").isNull()
    pin, pout = F.coalesce("input", "_in"), F.coalesce("output", "_out")
    cached = F.coalesce("supports_caching", F.lit(False))
    read, write = (F.when(cached, zero(F.col(c))).otherwise(0) for c in ("cache_read", "cache_write"))
    fresh = F.greatest(F.lit(0), zero(F.col("input_tokens")) - read - write)
    cost = ((fresh + write * 1.25 + read * 0.10) * pin + zero(F.col("output_tokens")) * pout) / 1_000_000
    cost = F.when(partial, F.raise_error(F.lit("incomplete token usage")).cast("double")).otherwise(cost)
    return known.withColumns({"cost": cost, "priced": F.coalesce("priced", F.lit(False))}).select(*usage.columns, "cost", "priced")


def families(df: DataFrame, model: str, specs: DataFrame) -> DataFrame:
    """``df`` with family: the model's family by ``specs`` (id, family), its own id if that is empty or unknown."""
    own = specs.select(F.col("id").alias(model), F.nullif("family", F.lit("")).alias("family"))
    return df.join(own, model, "left").withColumn("family", F.coalesce("family", F.col(model)))


def tool_calls(runs: DataFrame, key: str, trajectory: str) -> DataFrame:
    """(key, tool, n) of nested calls: trajectory array<struct<.., tool_calls: array<struct<name, ..>>>>."""
    names = F.flatten(F.transform(F.col(trajectory), lambda s: F.coalesce(F.transform(s["tool_calls"], lambda c: c["name"]), F.array().cast("array<string>"))))
    return runs.select(F.col(key), F.explode(names).alias("tool")).groupBy(key, "tool").agg(F.count("*").alias("n"))
