"""Bitmaps against interval windows, and the live store against the batch rollup."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerlight.functions.timewin import Window
from ledgerlight.operators import activity, bitmaps
from ledgerlight.operators.rollup import day_rollup
from ledgerlight.schema import EVENT, MEASURES
from ledgerlight.streaming import live

DAYS = [date(2024, 3, d) for d in (1, 2, 3)]
ROWS = "root string, cwd string, date date, session string, minute int"


def generated(seed, n=1500):
    r = random.Random(seed)
    rows = [("r", r.choice("ab"), r.choice(DAYS), r.choice(["s1", "s2", "s3"]), min(1439, int(r.triangular(0, 1439, r.choice([0, 47, 700, 1439]))))) for _ in range(n)]
    return rows + [("r", "edge", DAYS[0], "s1", m) for m in (0, 5, 43, 47, 48, 52, 57, 95, 96, 101, 1434, 1439)]


def sorted_rows(df):
    return sorted(tuple(r) for r in df.select("root", "cwd", "date", "active_minutes").collect())


@pytest.mark.parametrize("gap", [1, 2, 5, 9])
def test_bits_show_what_intervals_show(spark, gap):
    df = spark.createDataFrame(generated(gap, 600), ROWS)
    b = bitmaps.bitmaps(df)
    assert sorted_rows(bitmaps.active_minutes(b, gap)) == sorted_rows(activity.active_minutes(df, gap))
    assert sorted_rows(bitmaps.pooled_active_minutes(b, gap)) == sorted_rows(activity.pooled_active_minutes(df, gap))


def test_parts_merge_in_any_order_and_twice(spark):
    rows = generated(3)
    random.Random(1).shuffle(rows)
    parts = [bitmaps.bitmaps(spark.createDataFrame(rows[i::4], ROWS)) for i in range(4)]
    whole = sorted(map(tuple, bitmaps.bitmaps(spark.createDataFrame(rows, ROWS)).collect()))
    for order in ([0, 1, 2, 3], [3, 1, 0, 2, 3, 3]):
        assert sorted(map(tuple, bitmaps.merged(*[parts[i] for i in order]).collect())) == whole


@pytest.mark.parametrize("start", [0, 47, 48, 701, 1439])
def test_a_window_is_a_mask(spark, start):
    df = spark.createDataFrame(generated(5, 400), ROWS)
    w = Window(DAYS[1], DAYS[2], start)
    inside = df.where(w.has_minute(F.col("date"), F.col("minute")))
    assert sorted_rows(bitmaps.pooled_active_minutes(bitmaps.within(bitmaps.bitmaps(df), w))) == sorted_rows(activity.pooled_active_minutes(inside))


def test_gaps_that_do_not_fit_are_refused(spark):
    with pytest.raises(ValueError, match="gaps"):
        bitmaps.closed(bitmaps.bitmaps(spark.createDataFrame([], ROWS)), ["root"], 10)
    assert bitmaps.active_minutes(bitmaps.bitmaps(spark.createDataFrame([], ROWS))).count() == 0


SESSIONS = "session_file string, root string, cwd string"


def event(session, at, n):
    return (at, "m", n, n, 0, 2**60 if n == 1 else 0, n / 4, 0, 0, n, 0, session)


class Feed:
    """Files of events and sessions that appear one after another; each call of ``run`` is one or more batches."""

    def __init__(self, spark, folder):
        self.spark, self.at = spark, f"file://{folder}"

    def add(self, kind, rows):
        schema = EVENT if kind == "events" else SESSIONS
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.at}/{kind}")

    def run(self):
        read = lambda kind, schema: self.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{self.at}/{kind}")
        live.ingest_live(read("events", EVENT), read("sessions", SESSIONS), f"{self.at}/store", f"{self.at}/checkpoint").awaitTermination()
        return live.live_days(self.spark, f"{self.at}/store")


@pytest.fixture
def feed(spark, tmp_path):
    spark.conf.set(live.PROVIDER, live.ROCKSDB)
    yield Feed(spark, tmp_path)
    spark.conf.unset(live.PROVIDER)


def plain(df):
    return sorted(tuple(r) for r in df.select("root", "cwd", "date", *MEASURES, "active_minutes").collect())


def test_a_session_of_a_later_batch_counts(spark, feed):
    t = datetime(2024, 3, 1, 9)
    sessions = [("a.jsonl", "r", "/a"), ("b.jsonl", "r", "/b"), ("late.jsonl", "r", "/a")]
    first = [event(s, t + timedelta(minutes=3 * i), i) for s in ("a.jsonl", "late.jsonl") for i in range(5)] + [event(None, t, 1), event("never.jsonl", t, 1)]
    second = [event(s, t + timedelta(minutes=3 * i + 40), i) for s in ("a.jsonl", "b.jsonl", "late.jsonl") for i in range(5)]
    feed.add("events", first)
    feed.add("sessions", sessions[:1])
    got = feed.run()
    events = lambda rows: spark.createDataFrame(rows, EVENT)
    known = lambda rows: spark.createDataFrame(rows, SESSIONS)
    assert plain(got) == plain(day_rollup(events(first), known(sessions[:1])))
    feed.add("events", second)
    feed.add("sessions", [*sessions[1:], ("late.jsonl", "r", "/other"), ("a.jsonl", "r", "/other")])  # the first name holds
    want = plain(day_rollup(events(first + second), known(sessions)))
    assert plain(feed.run()) == want
    store = f"{feed.at}/store"
    live.fold(spark, store)
    assert live._folders(spark, store)[1] == [] and plain(live.live_days(spark, store)) == want
    assert plain(feed.run()) == want  # nothing new: nothing changes


def test_a_batch_tried_again_changes_nothing_and_reads_nothing(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    t = datetime(2024, 3, 1, 23, 50)
    parts = [[event(s, t + timedelta(minutes=7 * i + k), i) for i in range(6) for s in ("a.jsonl", "b.jsonl")] for k in range(5)]
    known = spark.createDataFrame([("a.jsonl", "r", "/a"), ("b.jsonl", "r", "/a")], SESSIONS)
    for n in (0, 1, 1, 2, 0):
        live.write_batch(spark.createDataFrame(parts[n], EVENT).join(known, "session_file"), n, store)
    live.fold(spark, store)
    for n in (3, 4, 3):
        live.write_batch(spark.createDataFrame(parts[n], EVENT).join(known, "session_file"), n, store)
    assert live._folders(spark, store) == (2, [3, 4])
    assert plain(live.live_days(spark, store)) == plain(day_rollup(spark.createDataFrame(sum(parts, []), EVENT), known))


def test_activity_stream_is_the_batch_form_and_forgets_days(spark, tmp_path):
    at = f"file://{tmp_path}"
    t = datetime(2024, 3, 1, 9)
    files = [[event(s, t + timedelta(days=d, minutes=4 * i + d), i) for i in range(20) for s in ("a.jsonl", "b.jsonl")] for d in range(4)]
    files.append([event("a.jsonl", t + timedelta(minutes=600), 1)])  # days too late
    for rows in files:
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"{at}/in")
    known = spark.createDataFrame([("a.jsonl", "r", "/a"), ("b.jsonl", "r", "/a")], SESSIONS)
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{at}/in").join(known, "session_file")
    sink = lambda df, n: df.write.mode("overwrite").parquet(f"{at}/out/batch={n}")
    q = live.activity_stream(stream).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    got = bitmaps.active_minutes(bitmaps.merged(spark.read.parquet(f"{at}/out")))
    want = day_rollup(spark.createDataFrame(sum(files[:4], []), EVENT), known)
    assert sorted_rows(got) == sorted_rows(want)
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] < 4 * 4  # earlier days have left
