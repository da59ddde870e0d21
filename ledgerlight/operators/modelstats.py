"""Model statistics: tokens, daily and minute costs by project and model family."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlight.functions.pricing import model_order
from ledgerlight.functions.timewin import Window
from ledgerlight.operators.rollup import scoped


def cwd_bridge(groups: DataFrame) -> DataFrame:
    """cwd, root_key: of groups that share a cwd the last one holds it."""
    rows = groups.select("pos", "root_key", F.explode("cwds").alias("cwd"))
    return rows.groupBy("cwd").agg(F.max_by("root_key", "pos").alias("root_key"))


def model_stats(index: DataFrame, bridge: DataFrame, w: Window, root: str | None = None, cwds: Sequence[str] | None = None, by_minute: bool = False) -> dict[str, DataFrame]:
    """``tokens`` (root_key, model), ``daily`` (… date) and, if asked, ``minute`` (… date, minute)."""
    rows = scoped(index, root, cwds).where(w.has_minute(F.col("date"), F.col("minute"))).join(bridge, "cwd")
    total = F.col("input") + F.col("output")
    key = ["root_key", "model"]
    paid = rows.where("cost > 0")
    out = {
        "tokens": rows.where((F.col("model") != "other") | (total > 0)).groupBy(*key).agg(F.sum(total).alias("tokens")),
        "daily": paid.groupBy(*key, "date").agg(F.sum("cost").alias("cost")),
    }
    if by_minute:
        out["minute"] = paid.groupBy(*key, "date", "minute").agg(F.sum("cost").alias("cost"))
    return out


def shares(tokens: DataFrame) -> DataFrame:
    """root_key, model, share, rank: none where a project has no tokens."""
    all_ = F.sum("tokens").over(W.partitionBy("root_key"))
    s = tokens.withColumn("all", all_).where(F.col("all") > 0).withColumn("share", F.col("tokens") / F.col("all"))
    rank = F.row_number().over(W.partitionBy("root_key").orderBy(F.desc("share"), "model"))
    return s.select("root_key", "model", "share", rank.alias("rank"))


def bar_widths(s: DataFrame, cells: int) -> DataFrame:
    """``width`` of each model in a bar of ``cells``: rounded, at least 1; the last takes the rest."""
    w = W.partitionBy("root_key")
    part = F.when(F.col("rank") < F.max("rank").over(w), F.greatest(F.round(F.col("share") * cells), F.lit(1.0)))
    rest = F.greatest(F.lit(float(cells)) - F.coalesce(F.sum("part").over(w), F.lit(0.0)), F.lit(0.0))
    return s.withColumn("part", part).withColumn("width", F.coalesce("part", rest).cast("int")).drop("part")


def daily_series(daily_costs: DataFrame) -> DataFrame:
    """root_key: array of (model, its date-sorted costs) in the fixed model order."""
    per = daily_costs.groupBy("root_key", "model").agg(F.array_sort(F.collect_list(F.struct("date", "cost"))).alias("series"))
    packed = F.array_sort(F.collect_list(F.struct(model_order(F.col("model")).alias("ord"), "model", "series")))
    return per.groupBy("root_key").agg(F.transform(packed, lambda x: F.struct(x["model"].alias("model"), x["series"].alias("series"))).alias("model_daily_costs"))
