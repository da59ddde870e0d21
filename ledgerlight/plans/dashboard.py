"""The query front end: lazily planned views of one reporting instant."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace
from datetime import date, datetime
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions.timewin import TimeFilter, Window, display_range, window
from ledgerlight.operators import cards, heatmap, history, kpi, modelstats, rollup, series
from ledgerlight.operators.overrides import Overrides, apply_overrides
from ledgerlight.plans.index import MinuteIndex
from ledgerlight.sources.shared import shared_dir


@dataclass(frozen=True)
class Dashboard:
    """Live events, history and groups at ``as_of``; ``view`` sets filter, root and project.

    Day windows read the merged history, windows inside a day the live minute rollup; model
    statistics are always live. The log is read once for all views: the rollup that they share is
    written to the shared folder at the first question. With ``index_path``, it is the maintained index there, of which
    only the dates whose events have changed are written.
    """

    events: DataFrame
    session_map: DataFrame
    groups: DataFrame
    as_of: datetime
    history: DataFrame | None = None
    overrides: Overrides | None = None
    time_filter: TimeFilter = TimeFilter.ALL
    root: str | None = None
    cwds: tuple[str, ...] | None = None
    index_path: str | None = None
    #: What all views of one instant share.
    kept: dict[str, DataFrame] = field(default_factory=dict, repr=False, compare=False)

    def view(self, time_filter: TimeFilter | None = None, root: str | None = None, project: str | None = None) -> Dashboard:
        cwds = None
        if project is not None:
            rows = self.shown_groups.where(F.col("root_key") == project).select("cwds").collect()  # one project
            cwds = tuple(sorted({c for r in rows for c in r.cwds}))
        return replace(self, time_filter=time_filter or self.time_filter, root=root, cwds=cwds)

    def roots(self) -> DataFrame:
        """Log roots by path."""
        return self.session_map.select("root").distinct().orderBy("root")

    @cached_property
    def window(self) -> Window:
        return window(self.time_filter, self.as_of)

    @cached_property
    def settings(self) -> Overrides:
        return self.overrides or Overrides()

    @cached_property
    def shown_groups(self) -> DataFrame:
        return apply_overrides(self.groups, self.settings) if self.settings.any else self.groups

    @property
    def rolled(self) -> DataFrame:
        """The session rollup, written once."""
        if "rolled" not in self.kept and self.index_path is not None:
            index = MinuteIndex(self.events.sparkSession, self.index_path)
            index.refresh(self.events, self.session_map)
            self.kept["rolled"] = index.rows()
        if "rolled" not in self.kept:
            spark, at = self.events.sparkSession, f"{shared_dir(self.events.sparkSession)}/rollup-{uuid.uuid4().hex}"
            df = rollup.session_rollup(self.events, self.session_map)
            df.write.parquet(at)
            self.kept["rolled"] = spark.read.schema(df.schema).parquet(at)
        return self.kept["rolled"]

    @cached_property
    def day(self) -> DataFrame:
        live = rollup.days(self.rolled)
        return live if self.history is None else history.merge(self.history, live)

    @cached_property
    def index(self) -> DataFrame:
        """The minute rollup."""
        return rollup.by_minute(self.rolled)

    @cached_property
    def minutes(self) -> DataFrame:
        return rollup.minutes(self.index, self.root, self.cwds)

    @cached_property
    def daily(self) -> DataFrame:
        """The daily series of the window."""
        if self.time_filter.is_subday:
            return rollup.daily_from_minutes(self.minutes, self.window)
        return rollup.daily(self.day, self.root, self.cwds).where(self.window.has_date(F.col("date")))

    def kpis(self) -> DataFrame:
        return kpi.kpis(self.daily, self.as_of)

    def thresholds(self) -> DataFrame:
        """Over all dates of the root and project, whatever the window."""
        return heatmap.thresholds(rollup.daily(self.day, self.root, self.cwds))

    def model_stats(self) -> dict[str, DataFrame]:
        inside = self.time_filter.is_subday or self.time_filter is TimeFilter.TODAY
        return modelstats.model_stats(self.index, modelstats.cwd_bridge(self.shown_groups), self.window, self.root, self.cwds, by_minute=inside)

    def cards(self) -> DataFrame:
        day = rollup.subday(self.index, self.window) if self.time_filter.is_subday else self.day
        shown = self.settings.display(self.events.sparkSession)
        return cards.ordered(cards.with_gauge(cards.cards(self.shown_groups, shown, day, self.model_stats(), self.window, self.root, self.cwds)))

    def heatmap(self, measure: str = "input", screen_weeks: int = 53) -> DataFrame:
        mode = {TimeFilter.TODAY: heatmap.TODAY, TimeFilter.HOUR12: heatmap.HOURS12, TimeFilter.HOUR1: heatmap.HOUR1}.get(self.time_filter)
        if mode is not None:
            return heatmap.intraday(self.minutes, mode, self.as_of)
        if self.time_filter is TimeFilter.LAST_WEEK:
            return heatmap.weekly(self.minutes, self.as_of)
        return heatmap.calendar(self.daily, measure, *self.range(), self.as_of, self.thresholds(), screen_weeks)

    def first_date(self) -> date | None:
        """The first day of the root and project, from dates alone: no rollup is made for it."""
        dates = self.rolled.select("root", "cwd", "date")
        if self.history is not None:
            dates = dates.unionByName(self.history.select("root", "cwd", "date"))
        return rollup.scoped(dates, self.root, self.cwds).agg(F.min("date")).first()[0]

    def range(self):
        return display_range(self.time_filter, self.as_of, self.first_date() if self.time_filter is TimeFilter.ALL else None)

    def model_costs(self, width: int) -> DataFrame:
        """root_key, model, i, value: cost per model at the window's granularity, ``width`` points."""
        g = series.granularity(self.time_filter)
        keys = ("root_key", "model")
        stats = self.model_stats()
        if g.bucket:
            return series.rebucket(series.minute_buckets(stats["minute"], "cost", g, self.as_of, keys), g.total // g.bucket, width, keys)
        first, last = self.range()
        return series.rebucket(series.dense_daily(stats["daily"], "cost", first, last, keys), (last - first).days + 1, width, keys)
