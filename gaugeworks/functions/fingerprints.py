"""What a run's configuration comes to: a digest of all that changes what a run does, and one of all but the model.

Configurations are equal however their JSON orders keys or tools, writes numbers, or leaves out what has a default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fields of a configuration that must be there, by type, and those that have a default.
TEXTS = ("model_id", "system_prompt", "test_command", "image_id")
COUNTS = ("max_iterations", "max_tokens", "max_file_lines", "max_search_hits")
#: Amounts, and the places they are rounded to.
AMOUNTS = {"max_cost_usd": 6, "max_wall_seconds": 3}
MODEL = "model_id"


def _once(value: Column, then) -> Column:
    """``then`` of a value that is worked out once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def settings(config: Column) -> Column:
    """``config`` (JSON text) as a struct of typed fields in one order, tools sorted; null if it is no object or lacks a field."""

    def typed(v: Column) -> Column:
        get = lambda k, t: F.try_variant_get(v, f"$.{k}", t)
        own = {k: get(k, "string") for k in TEXTS} | {"tools": F.array_sort(get("tool_signature", "array<array<string>>"))} | {k: get(k, "bigint") for k in COUNTS}
        own |= {k: F.round(get(k, "double"), places) for k, places in AMOUNTS.items()}
        rest = {"provider_route": F.coalesce(get("provider_route", "string"), F.lit("")), "announce_budget": F.coalesce(get("announce_budget", "boolean"), F.lit(False))}
        return F.struct(*(c.alias(k) for k, c in (own | rest).items()))

    def complete(s: Column) -> Column:
        there = F.lit(True)
        for k in (*TEXTS, "tools", *COUNTS, *AMOUNTS):
            there = there & s[k].isNotNull()
        return F.when(there, s)

    return _once(_once(F.try_parse_json(config), typed), complete)


def fingerprint(config: Column) -> Column:
    """Twelve hex digits that tell configurations apart; null for an incomplete one."""
    return F.substring(F.sha2(F.to_json(settings(config)), 256), 1, 12)


def fingerprint_less_model(config: Column) -> Column:
    """The same of all fields but the model: equal where runs of two models can be compared."""
    return F.substring(F.sha2(F.to_json(_once(settings(config), lambda s: s.dropFields(MODEL))), 256), 1, 12)
