"""Levels, rates, paths and the other one-row expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_date(ts: Column) -> Column:
    return F.to_date(ts)


def local_minute(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def accept_rate(accepted: Column, suggested: Column) -> Column:
    """Whole percent, at most 100; null where nothing was suggested."""
    return F.when(suggested > 0, F.least(accepted / suggested * 100, F.lit(100.0)).cast("bigint"))


def bucket_rate(accepted: Column, suggested: Column) -> Column:
    return F.coalesce(accept_rate(accepted, suggested), F.lit(0).cast("bigint"))


def detail_accept_pct(accepted: Column, suggested: Column) -> Column:
    """Percent as a double, not capped; null where nothing was suggested."""
    return F.when(suggested > 0, accepted / suggested * 100)


def token_level(v: Column, thresholds: Column) -> Column:
    """0 for 0; else one more than the first threshold not below ``v``; 4 beyond all."""
    out = F.when(v == 0, 0)
    for i in range(4):
        out = out.when(v <= F.element_at(thresholds, i + 1), i + 1)
    return out.otherwise(4)


def gauge_bars(eff: Column, p: Column) -> Column:
    """4 bars for the most efficient quarter, then 3, 2, 1; null without a value."""
    return F.when(eff > 0, F.when(eff <= p[0], 4).when(eff <= p[1], 3).when(eff <= p[2], 2).otherwise(1))


def group_name(path: Column, home: str) -> Column:
    """The last two components of a path, without the home prefix."""
    own = F.when(path.startswith(home), F.substr(path, F.lit(len(home) + 1))).otherwise(path)
    parts = F.filter(F.split(own, "/"), lambda x: x != "")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "/")


def heuristic_root(path: Column) -> Column:
    """The path before its first ``/worktrees/``, else before ``/Worktrees/``, else itself."""
    out = path
    for mark in ("/Worktrees/", "/worktrees/"):
        at = F.instr(path, mark)
        out = F.when(at > 0, F.left(path, at - 1)).otherwise(out)
    return out


def effective_root(cwd: Column, path: Column) -> Column:
    return F.coalesce(cwd, path)


def source_display(path: Column, home: str) -> Column:
    own = F.when(path.startswith(home), F.substr(path, F.lit(len(home) + 1))).otherwise(path)
    return F.regexp_replace(F.regexp_replace(own, "^/", ""), "/projects$", "")


def source_label(cwd: Column, root: Column, dir_name: Column) -> Column:
    """``./rel`` below the group's root, else the cwd; without a cwd the directory's name."""
    rel = F.concat(F.lit("./"), F.substr(cwd, F.length(root) + 2))
    return F.when(cwd.isNull(), dir_name).when(cwd.startswith(F.concat(root, F.lit("/"))), rel).otherwise(cwd)


def span_days(first: Column, last: Column) -> Column:
    return F.datediff(last, first) + 1


def spark_level(v: Column, scaled: Column, most: Column) -> Column:
    """Height 1 to 7 of a sparkline glyph; 0 is a blank."""
    return F.when((most <= 0) | (v <= 0), 0).otherwise(F.least(F.greatest(F.round(scaled / most * 7), F.lit(1)), F.lit(7)).cast("int"))
