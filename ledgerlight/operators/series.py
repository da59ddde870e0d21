"""Chart series: dense days, rebucketing to a width, minute buckets, stacked layers."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlight.functions.pricing import MODEL_ORDER, model_order
from ledgerlight.functions.scalars import spark_level
from ledgerlight.functions.timewin import TimeFilter


@dataclass(frozen=True)
class Granularity:
    """``bucket`` 0 is daily."""

    bucket: int = 0
    total: int = 0


GRANULARITY = {TimeFilter.HOUR1: Granularity(6, 60), TimeFilter.HOUR12: Granularity(30, 720), TimeFilter.TODAY: Granularity(60, 1440)}


def granularity(f: TimeFilter) -> Granularity:
    return GRANULARITY.get(f, Granularity())


def dense_daily(rows: DataFrame, value: str, first: date, last: date, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, i, value for every day of the range; missing days are 0."""
    n = max((last - first).days, 0) + 1
    grid = rows.sparkSession.range(n).select(F.col("id").cast("int").alias("i"), F.date_add(F.lit(first), F.col("id").cast("int")).alias("date"))
    if keys:
        grid = rows.select(*keys).distinct().crossJoin(grid)  # projects x days of one chart
    data = rows.groupBy(*keys, "date").agg(F.sum(value).cast("double").alias("value"))
    return grid.join(data, [*keys, "date"], "left").select(*keys, "i", F.coalesce("value", F.lit(0.0)).alias("value"))


def rebucket(rows: DataFrame, length: int, width: int, keys: tuple[str, ...] = (), upsample: bool = True) -> DataFrame:
    """keys, i, value: ``length`` points as ``width``: sums when there are more, nearest repeats when fewer."""
    if width <= 0 or length <= 0:
        return rows.select(*keys, "i", "value").where(F.lit(False))
    if length == width or (length < width and not upsample):
        return rows.select(*keys, "i", "value")
    if length < width:
        spans = [(k, i) for i, k in enumerate(min(i * length // width, length - 1) for i in range(width))]
    else:
        step = length / width
        spans = [(k, i) for i in range(width) for k in range(int(i * step), min(int((i + 1) * step), length))]
    plan = rows.sparkSession.createDataFrame(spans, "i int, o int")  # a row per point of one chart
    return rows.join(plan, "i").groupBy(*keys, "o").agg(F.sum("value").alias("value")).withColumnRenamed("o", "i").select(*keys, "i", "value")


def minute_buckets(minute: DataFrame, value: str, g: Granularity, as_of: datetime, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, i, value over today only, from ``total`` minutes back but not before midnight."""
    start = max(as_of.hour * 60 + as_of.minute - g.total, 0)
    n = g.total // g.bucket
    today = minute.where((F.col("date") == F.lit(as_of.date())) & (F.col("minute") >= start))
    sums = today.withColumn("i", F.floor((F.col("minute") - start) / g.bucket).cast("int")).where(F.col("i") < n).groupBy(*keys, "i").agg(F.sum(value).cast("double").alias("value"))
    grid = minute.sparkSession.range(n).select(F.col("id").cast("int").alias("i"))
    if keys:
        grid = minute.select(*keys).distinct().crossJoin(grid)  # projects x buckets of one chart
    return grid.join(sums, [*keys, "i"], "left").select(*keys, "i", F.coalesce("value", F.lit(0.0)).alias("value"))


def sparkline(points: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``level`` 0 to 7 of each point after cube-root scaling."""
    s = points.withColumn("scaled", F.cbrt("value"))
    top = F.max("scaled").over(W.partitionBy(*keys))
    return s.withColumn("level", spark_level(F.col("value"), F.col("scaled"), top)).drop("scaled")


def stacked(points: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, i, model, value, total and layer: the running sum over the model order by the chart's top."""
    w = W.partitionBy(*keys, "i")
    p = points.withColumn("ord", model_order(F.col("model"))).withColumn("total", F.sum("value").over(w)).withColumn("run", F.sum("value").over(w.orderBy("ord").rowsBetween(W.unboundedPreceding, 0)))
    top = F.max("total").over(W.partitionBy(*keys))
    return p.withColumn("layer", F.col("run") / F.when(top > 0, top).otherwise(F.lit(1.0))).drop("ord", "run")


MODELS = MODEL_ORDER
