"""Multiset line difference of long texts, by explode and aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions.lines import text_lines


def diff_lines(pairs: DataFrame, key: list[str], old: str, new: str) -> DataFrame:
    """key, added, removed. Counts combine before the shuffle; keys must be unique."""
    signed = lambda c, s: pairs.select(*key, F.explode(text_lines(F.col(c))).alias("line"), F.lit(s).alias("d"))
    net = signed(new, 1).unionByName(signed(old, -1)).groupBy(*key, "line").agg(F.sum("d").alias("d"))
    per = net.groupBy(*key).agg(F.sum(F.greatest("d", F.lit(0))).alias("added"), F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("removed"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return pairs.select(*key).join(per, key, "left").select(*key, zero("added"), zero("removed"))
