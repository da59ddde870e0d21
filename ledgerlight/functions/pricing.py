"""Model prices and names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: USD per million tokens (input, output, cache read); the first match wins.
PRICES = [
    ("opus-4-6", 5.0, 25.0, 0.50),
    ("opus-4-5", 5.0, 25.0, 0.50),
    ("opus-4-1", 15.0, 75.0, 1.50),
    ("opus-4-0", 15.0, 75.0, 1.50),
    ("opus-4-2", 15.0, 75.0, 1.50),
    ("3-opus", 15.0, 75.0, 1.50),
    ("sonnet", 3.0, 15.0, 0.30),
    ("haiku-4-5", 1.0, 5.0, 0.10),
    ("3-5-haiku", 0.80, 4.0, 0.08),
    ("3-haiku", 0.25, 1.25, 0.03),
]
FALLBACK = (3.0, 15.0, 0.30)
FAMILIES = ["opus", "sonnet", "haiku"]
MODEL_ORDER = [*FAMILIES, "other"]


def _lookup(model: Column, k: int) -> Column:
    out = None
    for name, *price in PRICES:
        hit, value = model.contains(name), F.lit(price[k])
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(F.lit(FALLBACK[k]))


def compute_cost(model: Column, given: Column, tokens_in: Column, tokens_out: Column, cache_read: Column) -> Column:
    """A positive stated cost wins; else the price table, cached input priced apart."""
    fresh = F.greatest(tokens_in - cache_read, F.lit(0))
    priced = (fresh * _lookup(model, 0) + cache_read * _lookup(model, 2) + tokens_out * _lookup(model, 1)) / 1e6
    return F.when(given > 0, given).otherwise(priced)


def normalize_model(model: Column) -> Column:
    out = None
    for f in FAMILIES:
        out = F.when(model.contains(f), f) if out is None else out.when(model.contains(f), f)
    return out.otherwise("other")


def model_order(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in MODEL_ORDER]), name)


def _sql(model: str, k: int) -> str:
    return "CASE " + " ".join(f"WHEN contains({model}, '{n}') THEN {float(p[k])!r}::DOUBLE" for n, *p in PRICES) + f" ELSE {FALLBACK[k]!r}::DOUBLE END"


def cost_sql(model: str, given: str, tin: str, tout: str, cached: str) -> str:
    return f"CASE WHEN {given} > 0 THEN {given} ELSE (greatest({tin} - {cached}, 0) * {_sql(model, 0)} + {cached} * {_sql(model, 2)} + {tout} * {_sql(model, 1)}) / 1000000.0::DOUBLE END"


def family_sql(model: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({model}, '{f}') THEN '{f}'" for f in FAMILIES) + " ELSE 'other' END"
