"""Key figures of a daily series: one row."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions.scalars import span_days


def _streak(as_of: datetime) -> Column:
    """An aggregate: consecutive active days back from the reporting day; 0 if it is idle.

    It holds the active dates, of which a series of any number of events has a few thousand.
    """
    today = F.lit(as_of.date())
    active = F.when((F.coalesce("input", F.lit(0)) + F.coalesce("output", F.lit(0)) > 0) & (F.col("date") <= today), F.col("date"))
    back = F.sort_array(F.collect_set(active), asc=False)
    return F.size(F.filter(back, lambda d, i: F.date_add(d, i) == today)).cast("bigint")


def streak(daily: DataFrame, as_of: datetime) -> DataFrame:
    """One row: the streak of a daily series."""
    return daily.agg(_streak(as_of).alias("streak"))


def kpis(daily: DataFrame, as_of: datetime) -> DataFrame:
    """One row, from one pass over the series."""
    total = F.coalesce(F.sum("input"), F.lit(0)) + F.coalesce(F.sum("output"), F.lit(0))
    lines = F.coalesce(F.sum("added"), F.lit(0)) + F.coalesce(F.sum("deleted"), F.lit(0))
    days = F.count_distinct("date")
    sug, every = F.sum("suggested"), F.coalesce(F.sum("accepted"), F.lit(0))
    return daily.agg(
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total_cost"),
        F.when(sug > 0, F.least(every / sug * 100, F.lit(100.0))).otherwise(F.lit(0.0)).alias("accept_rate"),
        days.alias("active_days"),
        F.coalesce(span_days(F.min("date"), F.max("date")), F.lit(0)).cast("bigint").alias("total_days"),
        F.when(days > 0, F.floor(total / days)).otherwise(F.lit(0)).cast("bigint").alias("avg_tokens"),
        F.when(lines > 0, total / lines).otherwise(F.lit(0.0)).alias("efficiency"),
        _streak(as_of).alias("streak"),
    )
