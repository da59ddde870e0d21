"""The maintained minute index: what a refresh writes, and what a window reads."""

import re
from datetime import timedelta

from pyspark.sql import functions as F

from ledgerlight import adapter as ad
from ledgerlight.functions.timewin import TimeFilter, window
from ledgerlight.operators import rollup
from ledgerlight.plans.dashboard import Dashboard
from ledgerlight.plans.index import MinuteIndex

SF = "/root/testdata/sf0.001"


def plain(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select("root", "cwd", "model", "session", "minute", "date", "input", "output", "cost", "added").collect())


def test_a_refresh_writes_the_dates_that_differ(spark, tmp_path):
    events, sessions, at = ad.usage_events(spark, SF), ad.session_map(spark), ad.as_of(spark, SF)
    index, today = MinuteIndex(spark, f"file://{tmp_path}/i"), at.date()
    early = events.where(F.to_date("ts") < F.lit(today))
    first = index.refresh(early, sessions)
    assert today not in first and len(first) > 7 and plain(index.rows()) == plain(rollup.session_rollup(early, sessions))
    files = lambda: {p.name for p in (tmp_path / "i" / "rows").rglob("*.parquet")}
    before = files()
    assert index.refresh(events, sessions) == [today]
    assert before < files() and plain(index.rows()) == plain(rollup.session_rollup(events, sessions))
    assert index.refresh(events.repartition(3), sessions) == []
    changed = events.withColumn("input", F.col("input") + F.when(F.to_date("ts") == F.lit(today - timedelta(days=3)), 1).otherwise(0)).where(F.to_date("ts") != F.lit(first[2]))
    assert index.refresh(changed, sessions) == sorted([first[2], today - timedelta(days=3)])
    assert plain(index.rows()) == plain(rollup.session_rollup(changed, sessions))
    doubled = changed.unionByName(changed.where(F.to_date("ts") == F.lit(today)))
    assert index.refresh(doubled, sessions) == [today] and plain(index.rows()) == plain(rollup.session_rollup(doubled, sessions))
    assert len(list((tmp_path / "i" / "digests").iterdir())) == 1
    assert len(index.refresh(events.limit(0), sessions)) == len(first) and index.rows().count() == 0


def test_a_refresh_that_dies_before_its_digests_is_done_again(spark, tmp_path, monkeypatch):
    events, sessions, today = ad.usage_events(spark, SF), ad.session_map(spark), ad.as_of(spark, SF).date()
    index = MinuteIndex(spark, f"file://{tmp_path}/i")
    index.refresh(events.where(F.to_date("ts") < F.lit(today)), sessions)
    old = index.digests().collect()
    spark.createDataFrame([(0,)], "junk int").write.parquet(f"file://{tmp_path}/i/digests/lost")  # what a dead refresh leaves
    rollup.session_rollup(events.where(F.to_date("ts") == F.lit(today)), sessions).write.partitionBy("date").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"file://{tmp_path}/i/rows")
    assert sorted(index.digests().collect()) == sorted(old) and index.refresh(events, sessions) == [today]
    assert plain(index.rows()) == plain(rollup.session_rollup(events, sessions))


def test_last_week_reads_seven_partitions(spark, tmp_path):
    at = ad.as_of(spark, SF)
    parts = dict(events=ad.usage_events(spark, SF), session_map=ad.session_map(spark), groups=ad.groups(spark), as_of=at)
    kept, fresh = Dashboard(**parts, index_path=f"file://{tmp_path}/i"), Dashboard(**parts)
    week = MinuteIndex(spark, f"file://{tmp_path}/i")
    a, b = kept.view(TimeFilter.LAST_WEEK), fresh.view(TimeFilter.LAST_WEEK)
    tokens = lambda v: sorted(map(tuple, v.model_stats()["tokens"].collect()))
    assert tokens(a) == tokens(b)
    assert a.kpis().first() == b.kpis().first()
    plan = a.model_stats()["tokens"]._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*date#\d+ >= ", plan), plan
    rows = week.rows(window(TimeFilter.LAST_WEEK, at))
    read = {r[0] for r in rows.select(F.regexp_extract("_metadata.file_path", "date=([0-9-]+)", 1)).distinct().collect()}
    assert read == {str(at.date() - timedelta(days=k)) for k in range(7)}
