"""Reporting windows. The instant is always an argument, never the clock."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F


class TimeFilter(Enum):
    ALL = "All"
    LAST_MONTH = "Last month"
    LAST_WEEK = "Last week"
    TODAY = "Today"
    HOUR12 = "12h"
    HOUR1 = "1h"

    def next(self) -> TimeFilter:
        order = list(TimeFilter)
        return order[(order.index(self) + 1) % len(order)]

    @property
    def is_subday(self) -> bool:
        return self in (TimeFilter.HOUR12, TimeFilter.HOUR1)


_BACK = {TimeFilter.LAST_MONTH: 29, TimeFilter.LAST_WEEK: 6, TimeFilter.TODAY: 0}
_MINUTES = {TimeFilter.HOUR12: 720, TimeFilter.HOUR1: 60}


@dataclass(frozen=True)
class Window:
    """Inclusive dates; None is open. ``start_minute`` cuts the first date only."""

    start: date | None
    end: date | None
    start_minute: int | None = None

    def has_date(self, d: Column) -> Column:
        out = F.lit(True)
        if self.start is not None:
            out = out & (d >= F.lit(self.start))
        if self.end is not None:
            out = out & (d <= F.lit(self.end))
        return out

    def has_minute(self, d: Column, minute: Column) -> Column:
        if self.start_minute is None:
            return self.has_date(d)
        return self.has_date(d) & ~((d == F.lit(self.start)) & (minute < self.start_minute))


def window(f: TimeFilter, as_of: datetime) -> Window:
    if f is TimeFilter.ALL:
        return Window(None, None)
    if f.is_subday:
        at = as_of - timedelta(minutes=_MINUTES[f])
        return Window(at.date(), as_of.date(), at.hour * 60 + at.minute)
    return Window(as_of.date() - timedelta(days=_BACK[f]), as_of.date())


def display_range(f: TimeFilter, as_of: datetime, first: date | None) -> tuple[date, date]:
    """Dates that a chart spans: whole history starts at its first date."""
    today = as_of.date()
    if f is TimeFilter.ALL:
        return first or today, today
    if f in (TimeFilter.LAST_MONTH, TimeFilter.LAST_WEEK):
        return today - timedelta(days=_BACK[f]), today
    return today, today
