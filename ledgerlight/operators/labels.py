"""Labels below charts and above heatmaps: where they stand, and which are left out.

A row of ``charts`` is one chart (a project, a user, a session); its labels are made from its
own columns, so any number of charts is labelled in one plan. A chart has at most as many candidates as columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions.fmt import month_abbrev
from ledgerlight.operators.heatmap import HOURS12, Intraday

DATE_SLOT, DATE_SIZE = 8, 6
TIME_SLOT, HOUR_GAP = 6, 3
LABEL = "struct<i:int,col:int,label:string>"


def _spread(i: Column, n: Column, points: Column) -> Column:
    """The ``i``-th of ``n`` points at even distances, the first and the last included."""
    return F.when(n <= 1, 0).otherwise(F.floor(i * (points - 1) / F.greatest(n - 1, F.lit(1)))).cast("int")


def _middle(point: Column, points: Column, width: int, size: Column) -> Column:
    """The column of a point's middle, moved left where a label of ``size`` would pass the edge."""
    at = F.floor((point + 0.5) * (F.lit(float(width)) / points)).cast("int")
    return F.least(at, F.greatest(F.lit(width) - size, F.lit(0)))


def placed(candidates: DataFrame, keys: tuple[str, ...], gap: int) -> DataFrame:
    """keys, i, col, label: in the order of i, each label that leaves ``gap`` columns to the last one kept.

    The first is always kept. Whether a label stays depends on all before it, so a chart's candidates are folded in order.
    """
    ordered = candidates.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "col", "label"))).alias("c"))
    start = F.struct(F.lit(-gap).alias("end"), F.array().cast(f"array<{LABEL}>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        taken = F.struct((x["col"] + F.length(x["label"])).alias("end"), F.concat(acc["kept"], F.array(x)).alias("kept"))
        return F.when(x["col"] >= acc["end"] + gap, taken).otherwise(acc)

    return ordered.select(*keys, F.explode(F.aggregate("c", start, step, lambda a: a["kept"])).alias("l")).select(*keys, "l.i", "l.col", "l.label")


def _cut(labels: DataFrame, keys: tuple[str, ...], width: int | None) -> DataFrame:
    """What is visible of each label in a line of ``width`` columns."""
    if width is None:
        return labels
    return labels.where(F.col("col") < width).select(*keys, "i", "col", F.expr(f"left(label, {width} - col)").alias("label"))


def date_axis(charts: DataFrame, width: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, i, col, label (``Jan 02``): days at even distances over ``first`` to ``last`` of each chart."""
    if width < DATE_SIZE:
        return charts.select(*keys, F.lit(0).alias("i"), F.lit(0).alias("col"), F.lit("").alias("label")).where(F.lit(False))
    days = F.greatest(F.datediff("last", "first"), F.lit(0)) + 1
    n = F.least(F.lit(max(width // DATE_SLOT, 1)), days)
    c = charts.select(*keys, "first", days.alias("days"), n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    c = c.withColumn("point", _spread(F.col("i"), F.col("n"), F.col("days")))
    day = F.date_add("first", F.col("point"))
    return c.select(*keys, "i", _middle(F.col("point"), F.col("days"), width, F.lit(DATE_SIZE)).alias("col"), F.concat_ws(" ", month_abbrev(day), F.date_format(day, "dd")).alias("label"))


def time_axis(charts: DataFrame, bucket: int, buckets: int, width: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, i, col, label for ``buckets`` of ``bucket`` minutes from minute ``start`` of each chart.

    Buckets of half an hour and more are labelled by the hour where there is room, shorter ones by ``HH:MM`` at even distances.
    """
    hourly = bucket >= 30
    n = buckets if hourly else min(max(width // TIME_SLOT, 1), buckets)
    if buckets <= 0 or (not hourly and width < TIME_SLOT):
        return charts.select(*keys, F.lit(0).alias("i"), F.lit(0).alias("col"), F.lit("").alias("label")).where(F.lit(False))
    c = charts.select(*keys, "start", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    point = F.col("i") if hourly else _spread(F.col("i"), F.lit(n), F.lit(buckets))
    c = c.withColumn("point", point).withColumn("minute", F.col("start") + F.col("point") * bucket)
    hour, minute = F.floor(F.col("minute") / 60), F.col("minute") % 60
    if hourly:
        c = c.where(minute < 30).withColumn("label", hour.cast("string"))
    else:
        c = c.withColumn("label", F.format_string("%02d:%02d", hour.cast("int"), minute.cast("int")))
    c = c.withColumn("col", _middle(F.col("point"), F.lit(buckets), width, F.length("label"))).select(*keys, "i", "col", "label")
    return placed(c, keys, HOUR_GAP) if hourly else c


def months(charts: DataFrame, offset: int, cell: int, keys: tuple[str, ...] = (), width: int | None = None) -> DataFrame:
    """keys, i (week), col, label: the month above the first week shown and above each week whose Sunday begins a month's weeks.

    A chart has ``start`` (a Sunday) and ``weeks``.
    """
    c = charts.where("weeks > 0").select(*keys, "start", F.explode(F.sequence(F.lit(0), F.col("weeks") - 1)).alias("i"))
    week = F.date_add("start", (F.col("i") * 7).cast("int"))
    c = c.where((F.col("i") == 0) | (F.month(week) != F.month(F.date_sub(week, 7))))
    c = c.select(*keys, F.col("i").cast("int").alias("i"), (F.lit(offset) + F.col("i") * cell).cast("int").alias("col"), month_abbrev(week).alias("label"))
    return _cut(placed(c, keys, 1), keys, width)


def columns(charts: DataFrame, mode: Intraday, offset: int, cell: int, keys: tuple[str, ...] = (), width: int | None = None) -> DataFrame:
    """keys, i, col, label of an intraday heatmap's columns: hours, the hours from ``start`` on, or the last digit of minutes."""
    c = charts.select(*keys, "start", F.explode(F.sequence(F.lit(0), F.lit(mode.columns - 1))).alias("i"))
    label = (F.hour("start") + F.col("i")) % 24 if mode is HOURS12 else F.col("i")
    c = c.select(*keys, "i", (F.lit(offset) + F.col("i") * cell).cast("int").alias("col"), label.cast("string").alias("label"))
    return _cut(placed(c, keys, 1), keys, width)
