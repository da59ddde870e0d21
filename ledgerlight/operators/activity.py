"""Active minutes: clusters of minutes with gaps of at most ``gap``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS = ["root", "cwd", "date"]


def sums(names: Sequence[str]) -> list[Column]:
    return [F.sum(m).alias(m) for m in names]


def intervals(rows: DataFrame, keys: list[str], gap: int, measures: Sequence[str] = ()) -> DataFrame:
    """keys, s, e: maximal runs of distinct minutes, with the sums of ``measures`` over their rows."""
    at = W.partitionBy(*keys).orderBy("minute")
    new = F.when(F.col("minute") - F.lag("minute").over(at) <= gap, 0).otherwise(1)
    per = rows.groupBy(*keys, "minute").agg(*sums(measures)) if measures else rows.select(*keys, "minute").distinct()
    runs = per.withColumn("new", new).withColumn("run", F.sum("new").over(at))
    return runs.groupBy(*keys, "run").agg(F.min("minute").alias("s"), F.max("minute").alias("e"), *sums(measures)).drop("run")


def active_minutes(rows: DataFrame, gap: int = 5, measures: Sequence[str] = ()) -> DataFrame:
    """root, cwd, date, ``measures`` summed, active_minutes: clusters per session, then their union.

    Partitions are a session's or a project's day, so a window holds at most 1440 minutes
    per session. The sums travel with the clusters, so rows are read and shuffled once for both.
    """
    iv = intervals(rows, [*KEYS, "session"], gap, measures)
    by = W.partitionBy(*KEYS).orderBy("s", "e")
    reach = F.max("e").over(by.rowsBetween(W.unboundedPreceding, -1))
    isle = F.sum(F.when(F.col("s") <= F.col("reach") + 1, 0).otherwise(1)).over(by)
    iv = iv.withColumn("reach", reach).withColumn("isle", isle)
    merged = iv.groupBy(*KEYS, "isle").agg((F.max("e") - F.min("s") + 1).alias("n"), *sums(measures))
    return merged.groupBy(*KEYS).agg(*sums(measures), F.sum("n").cast("bigint").alias("active_minutes"))


def pooled_active_minutes(rows: DataFrame, gap: int = 5, measures: Sequence[str] = ()) -> DataFrame:
    """The same with all sessions of a project's day pooled first."""
    iv = intervals(rows, KEYS, gap, measures)
    return iv.groupBy(*KEYS).agg(*sums(measures), F.sum(F.col("e") - F.col("s") + 1).cast("bigint").alias("active_minutes"))


def session_window_minutes(rows: DataFrame, gap: int = 5) -> DataFrame:
    """The pooled form by ``session_window``, as a stream computes it; ``ts`` is the minute."""
    w = F.session_window("ts", f"{gap} minutes")
    per = rows.withColumn("ts", F.date_trunc("minute", "ts")).groupBy(*KEYS, w.alias("w")).agg(F.count("*").alias("n"))
    span = (F.unix_seconds(F.col("w.end").cast("timestamp")) - F.unix_seconds(F.col("w.start").cast("timestamp"))) / 60 - gap + 1
    return per.groupBy(*KEYS).agg(F.sum(span).cast("bigint").alias("active_minutes"))
