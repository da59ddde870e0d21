"""Project cards: one row per visible project with activity in the window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlight.functions.scalars import detail_accept_pct, gauge_bars, span_days
from ledgerlight.functions.timewin import Window
from ledgerlight.operators.modelstats import daily_series, shares

#: Efficiency quartiles where no card has an efficiency.
DEFAULT_QUARTILES = (500.0, 1000.0, 1500.0)


def visible(groups: DataFrame, overrides: DataFrame, cwds: Sequence[str] | None = None) -> DataFrame:
    """Groups that are not hidden and, with ``cwds``, share one with it; renamed and starred.

    ``overrides``: root_key, name, starred, hidden.
    """
    g = groups.join(overrides.withColumnRenamed("name", "custom"), "root_key", "left").where(~F.coalesce("hidden", F.lit(False)))
    if cwds is not None:
        g = g.where(F.arrays_overlap("cwds", F.array(*[F.lit(c) for c in cwds])))
    return g.select("root_key", F.coalesce("custom", "name").alias("name"), F.coalesce("starred", F.lit(False)).alias("starred"), "pos", "cwds", "sessions")


def card_totals(shown: DataFrame, day: DataFrame, w: Window, root: str | None = None) -> DataFrame:
    """Totals, dates and series per group; a shared cwd counts in each of its groups."""
    d = day if root is None else day.where(F.col("root") == root)
    d = d.where(F.col("date").isNotNull() & w.has_date(F.col("date")))
    bridge = shown.select("root_key", F.explode(F.array_distinct("cwds")).alias("cwd"))
    by_day = bridge.join(d, "cwd").groupBy("root_key", "date").agg(
        F.sum("cost").alias("cost"), F.sum("input").alias("input"), F.sum("output").alias("output"),
        F.sum(F.col("cache_read") + F.col("cache_creation")).alias("cache"),
        F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.sum("suggested").alias("suggested"), F.sum("accepted").alias("accepted"),
        F.sum("active_minutes").alias("minutes"),
    )
    total = lambda c, a: F.sum(c).alias(a)
    series = lambda c: F.array_sort(F.collect_list(F.struct("date", F.col(c).alias("value")))).alias(f"daily_{c}")
    return by_day.groupBy("root_key").agg(
        total("cost", "total_cost"), total("input", "tokens_in"), total("output", "tokens_out"), total("cache", "tokens_cache"),
        total("added", "lines_added"), total("deleted", "lines_deleted"), total("suggested", "lines_suggested"), total("accepted", "lines_accepted"),
        F.min("date").alias("first_activity"), F.max("date").alias("last_activity"), F.count("date").alias("active_days"),
        total("minutes", "time_minutes"), series("cost"), series("input"), series("output"),
    )


def cards(groups: DataFrame, overrides: DataFrame, day: DataFrame, stats: dict[str, DataFrame], w: Window, root: str | None = None, cwds: Sequence[str] | None = None) -> DataFrame:
    shown = visible(groups, overrides, cwds)
    lines = F.col("lines_added") + F.col("lines_deleted")
    c = shown.join(card_totals(shown, day, w, root), "root_key").withColumn("efficiency", F.when(lines > 0, (F.col("tokens_in") + F.col("tokens_out")) / lines).otherwise(F.lit(0.0)))
    sh = shares(stats["tokens"]).groupBy("root_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "model", "share"))), lambda x: F.struct(x["model"].alias("model"), x["share"].alias("share"))).alias("model_shares"))
    c = c.join(sh, "root_key", "left").join(daily_series(stats["daily"]), "root_key", "left")
    return c.withColumns({
        "net_lines": F.col("lines_added") - F.col("lines_deleted"),
        "total_lines": lines,
        "span_days": span_days(F.col("first_activity"), F.col("last_activity")),
        "accept_pct": detail_accept_pct(F.col("lines_accepted"), F.col("lines_suggested")),
    })


def ordered(c: DataFrame) -> DataFrame:
    """With ``rank``: starred first, dearest first, then the order of groups."""
    return c.withColumn("rank", F.row_number().over(W.orderBy(F.desc("starred"), F.desc("total_cost"), "pos")))


def _quartiles(over: WindowSpec | None = None) -> Column:
    """The interpolated quartiles of positive efficiencies, over a window or as an aggregate."""
    q = F.percentile(F.when(F.col("efficiency") > 0, F.col("efficiency")), F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75)]))
    return F.coalesce(q if over is None else q.over(over), F.array(*[F.lit(x) for x in DEFAULT_QUARTILES]))


def efficiency_quartiles(c: DataFrame) -> DataFrame:
    """One row: q, the interpolated quartiles of positive efficiencies."""
    return c.agg(_quartiles().alias("q"))


def with_gauge(c: DataFrame) -> DataFrame:
    """``bars`` against the quartiles of all cards, before any paging; a row per project meets one window, so cards are made once."""
    return c.withColumn("bars", gauge_bars(F.col("efficiency"), _quartiles(W.partitionBy())))


def page(c: DataFrame, offset: int, size: int) -> DataFrame:
    return ordered(c).where((F.col("rank") > offset) & (F.col("rank") <= offset + size))
