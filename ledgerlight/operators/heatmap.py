"""Heatmaps: thresholds, intraday, weekly and calendar cells, and the trend line.

Cells are bucket rows of fixed number (days or minutes of one window); the data side is
aggregated by bucket before it meets them.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlight.functions.scalars import bucket_rate, token_level

NO_DATA = (1, 2, 3, 4)
CELLS = ["input", "output", "accepted", "suggested"]


def quartiles(value: Column) -> Column:
    """Nearest-rank quartiles of the positive values; an aggregate."""
    v = F.array_sort(F.collect_list(F.when(value > 0, value.cast("bigint"))))
    n = F.size(v)
    at = lambda i: F.element_at(v, i.cast("int"))
    picks = F.array(at(F.floor(n / 4) + 1), at(F.floor(n / 2) + 1), at(F.floor(n * 3 / 4) + 1), at(n))
    return F.when(n > 0, picks).otherwise(F.array(*[F.lit(x).cast("bigint") for x in NO_DATA]))


def thresholds(daily: DataFrame) -> DataFrame:
    """One row: quartiles of daily input, output and accepted lines."""
    return daily.agg(*[quartiles(F.col(c)).alias(c) for c in ("input", "output", "accepted")])


@dataclass(frozen=True)
class Intraday:
    minutes: int
    buckets: int
    columns: int

    def start(self, as_of: datetime) -> datetime:
        if self is TODAY:
            return as_of.replace(hour=0, minute=0, second=0, microsecond=0)
        if self is HOURS12:
            return (as_of - timedelta(hours=11)).replace(minute=0, second=0, microsecond=0)
        return (as_of - timedelta(minutes=59)).replace(second=0, microsecond=0)

    def active(self, as_of: datetime) -> int:
        past = int((as_of - self.start(as_of)).total_seconds() // 60)
        return min(max(past, 0) // self.minutes + 1, self.buckets)


TODAY, HOURS12, HOUR1 = Intraday(10, 144, 24), Intraday(10, 72, 12), Intraday(1, 60, 10)


def _dense(spark: SparkSession, n: int, sums: DataFrame) -> DataFrame:
    cells = spark.range(n).select(F.col("id").cast("int").alias("bucket"))
    return cells.join(sums, "bucket", "left").select("bucket", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in CELLS]).withColumn("rate", bucket_rate(F.col("accepted"), F.col("suggested")))


def _of(rows: DataFrame, bucket: Column, n: int) -> DataFrame:
    placed = rows.withColumn("bucket", bucket).where((F.col("bucket") >= 0) & (F.col("bucket") < n))
    return placed.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in CELLS])


def intraday(minute: DataFrame, mode: Intraday, as_of: datetime) -> DataFrame:
    """bucket, row, col, active and the cell values; zero-filled."""
    s = mode.start(as_of)
    since = F.datediff(F.col("date"), F.lit(s.date())) * 1440 + F.col("minute") - (s.hour * 60 + s.minute)
    near = minute.where((F.col("date") >= F.lit(s.date())) & (F.col("date") <= F.lit(s.date() + timedelta(days=1))))
    b = _dense(minute.sparkSession, mode.buckets, _of(near, F.floor(since / mode.minutes).cast("int"), mode.buckets))
    i = F.col("bucket")
    row, col = (F.floor(i / 10), i % 10) if mode is HOUR1 else (i % 6, F.floor(i / 6))
    return b.withColumns({"row": row.cast("int"), "col": col.cast("int"), "active": i < mode.active(as_of)})


def weekly(minute: DataFrame, as_of: datetime) -> DataFrame:
    """Seven days of six four-hour blocks, the last day being today."""
    start = as_of.date() - timedelta(days=6)
    day = F.datediff(F.col("date"), F.lit(start))
    near = minute.where((F.col("date") >= F.lit(start)) & (F.col("date") <= F.lit(as_of.date())))
    b = _dense(minute.sparkSession, 42, _of(near, (day * 6 + F.floor(F.col("minute") / 240)).cast("int"), 42))
    i = F.col("bucket")
    return b.withColumns({"row": (i % 6).cast("int"), "col": F.floor(i / 6).cast("int"), "active": i < 36 + as_of.hour // 4 + 1})


def panel(cells: DataFrame) -> DataFrame:
    """One row over the active cells: totals, rate and thresholds."""
    a = cells.where("active")
    total = lambda c: F.sum(c).alias(f"{c}_total")
    rate = F.when(F.sum("suggested") > 0, F.least(F.sum("accepted") / F.sum("suggested") * 100, F.lit(100.0))).otherwise(F.lit(0.0))
    return a.agg(*[total(c) for c in CELLS], rate.alias("rate"), *[quartiles(F.col(c)).alias(f"{c}_thresholds") for c in ("input", "output", "accepted")])


def calendar(daily: DataFrame, measure: str, first: date, last: date, as_of: datetime, limit_rows: DataFrame, screen_weeks: int = 53) -> DataFrame:
    """date, week, weekday (0 is Sunday), value, level; a date without data has nulls.

    ``limit_rows``: the row of ``thresholds``. Future dates are left out.
    """
    today = as_of.date()
    days = max((last - first).days, 0) + 1
    weeks = min(screen_weeks, -(-days // 7) + 1)
    sunday = today - timedelta(days=(today.weekday() + 1) % 7)
    start = sunday - timedelta(days=7 * (weeks - 1))
    spark = daily.sparkSession
    grid = spark.range((today - start).days + 1).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("date"))
    cells = grid.join(daily.select("date", F.col(measure).alias("value")), "date", "left").crossJoin(limit_rows.select(F.col(measure).alias("t")))  # one row
    pos = F.datediff("date", F.lit(start))
    return cells.select("date", F.floor(pos / 7).cast("int").alias("week"), (pos % 7).cast("int").alias("weekday"), "value", F.when(F.col("value").isNotNull(), token_level(F.col("value"), F.col("t"))).alias("level"))


def trend(daily: DataFrame, measure: str, days: int, as_of: datetime) -> DataFrame:
    """i, date, value, smoothed (three-point mean), scaled (its cube root), top (at least 1)."""
    start = as_of.date() - timedelta(days=days - 1)
    grid = daily.sparkSession.range(days).select(F.col("id").cast("int").alias("i"), F.date_add(F.lit(start), F.col("id").cast("int")).alias("date"))
    v = grid.join(daily.select("date", F.col(measure).alias("v")), "date", "left").select("i", "date", F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("value"))
    mean = F.avg("value").over(W.orderBy("i").rowsBetween(-1, 1))  # a row per day of the grid
    v = v.withColumn("smoothed", mean).withColumn("scaled", F.cbrt("smoothed"))
    return v.withColumn("top", F.greatest(F.max("scaled").over(W.partitionBy()), F.lit(1.0)))
