"""Rollups of events by day and by minute and model, and the series made of them.

Joins carry no broadcast hint: the session map and bridges are broadcast by Spark
where their measured size is under its threshold, and shuffled beyond it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions.pricing import normalize_model
from ledgerlight.functions.scalars import local_date, local_minute
from ledgerlight.functions.timewin import Window
from ledgerlight.operators.activity import active_minutes, pooled_active_minutes, sums
from ledgerlight.schema import LINES, MEASURES, SERIES


def dated(events: DataFrame) -> DataFrame:
    """Events with their local date and minute."""
    return events.withColumns({"date": local_date(F.col("ts")), "minute": local_minute(F.col("ts"))})


def attach(events: DataFrame, session_map: DataFrame) -> DataFrame:
    """Events with their root, cwd, local date and minute; unknown sessions are dropped."""
    return dated(events.join(session_map, "session_file"))


def scoped(df: DataFrame, root: str | None, cwds: Sequence[str] | None) -> DataFrame:
    """Rows of one root and of a project's cwds; an unknown root gives no rows."""
    if root is not None:
        df = df.where(F.col("root") == root)
    if cwds is not None:
        df = df.where(F.col("cwd").isin(list(cwds)))
    return df


def session_rollup(events: DataFrame, session_map: DataFrame) -> DataFrame:
    """root, cwd, model family, date, session, minute: sums of nine measures; what every other rollup can be made of."""
    e = attach(events, session_map).withColumn("model", normalize_model(F.col("model")))
    return e.groupBy("root", "cwd", "model", "date", F.col("session_file").alias("session"), "minute").agg(*sums(MEASURES))


def days(rows: DataFrame, gap: int = 5) -> DataFrame:
    """The day rollup of rows with root, cwd, date, session, minute and the measures."""
    return active_minutes(rows, gap, MEASURES)


def day_rollup(events: DataFrame, session_map: DataFrame, gap: int = 5) -> DataFrame:
    """root, cwd, date: sums of nine measures and the active minutes."""
    return days(attach(events, session_map).withColumnRenamed("session_file", "session"), gap)


def day_sums(events: DataFrame, session_map: DataFrame) -> DataFrame:
    """The day rollup without active minutes: one aggregate, no windows; all that the daily series needs."""
    return attach(events, session_map).groupBy("root", "cwd", "date").agg(*sums(MEASURES))


def by_minute(rows: DataFrame) -> DataFrame:
    """The minute rollup of rows with root, cwd, model, date, minute and the measures."""
    return rows.groupBy("root", "cwd", "model", "date", "minute").agg(*sums(MEASURES))


def minute_rollup(events: DataFrame, session_map: DataFrame) -> DataFrame:
    """root, cwd, model family, date, minute: sums of nine measures."""
    return by_minute(attach(events, session_map).withColumn("model", normalize_model(F.col("model"))))


def daily(day: DataFrame, root: str | None = None, cwds: Sequence[str] | None = None) -> DataFrame:
    """date: seven sums; a line count of 0 is absent, not 0."""
    d = scoped(day, root, cwds).where("date IS NOT NULL").groupBy("date").agg(*sums(SERIES))
    return d.withColumns({m: F.nullif(m, F.lit(0)) for m in LINES})


def minutes(index: DataFrame, root: str | None = None, cwds: Sequence[str] | None = None) -> DataFrame:
    """date, minute: seven sums, zeros kept."""
    return scoped(index, root, cwds).groupBy("date", "minute").agg(*sums(SERIES))


def daily_from_minutes(minute: DataFrame, w: Window) -> DataFrame:
    return minute.where(w.has_minute(F.col("date"), F.col("minute"))).groupBy("date").agg(*sums(SERIES))


def subday(index: DataFrame, w: Window, gap: int = 5) -> DataFrame:
    """The day rollup of a window that starts inside a day; sessions are pooled."""
    rows = index.where(w.has_minute(F.col("date"), F.col("minute")))
    return pooled_active_minutes(rows, gap, MEASURES)


def root_map(session_map: DataFrame) -> DataFrame:
    """root: its distinct cwds."""
    return session_map.groupBy("root").agg(F.array_sort(F.collect_set("cwd")).alias("cwds"))
