"""High-water-mark history: a field-wise maximum over rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.schema import MEASURES


def merge(history: DataFrame, fresh: DataFrame) -> DataFrame:
    """root, cwd, date: the larger value of each measure; replaying a merge changes nothing."""
    cols = ["root", "cwd", "date", *MEASURES, "active_minutes"]
    both = history.select(cols).unionByName(fresh.select(cols))
    return both.groupBy("root", "cwd", "date").agg(*[F.coalesce(F.max(m), F.lit(0)).alias(m) for m in [*MEASURES, "active_minutes"]])
