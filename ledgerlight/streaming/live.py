"""Live ingest: sessions become known while the stream runs, and no touched day is read again.

``attached`` is a keyed-state operator: the state of a session file is its root and cwd, once a row has named
them, and until then the events that wait for them. A session that first appears in a later batch
is rolled up with all the events that came before.

The sink keeps, for each batch, day sums of its events and minute bitmaps. Sums of different batches
add up; bitmaps merge by or. A batch that is tried again overwrites its own folder, so nothing is counted
twice, and no batch reads what others wrote. After ``FOLD`` batches they are folded into
one base, so that the cost of a read doesn't grow with the number of batches.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ledgerlight.functions.scalars import local_date, local_minute
from ledgerlight.operators import bitmaps
from ledgerlight.operators.activity import KEYS, sums
from ledgerlight.schema import DAY, EVENT, MEASURES

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Batches that lie beside a base before they are folded into the next.
FOLD = 20
SUMS = T.StructType([f for f in DAY.fields if f.name != "active_minutes"])
BITS = "root string, cwd string, date date, session string, word int, bits long"
_OUT = "session_file string, root string, cwd string, event string"

#: The processor travels with the query: workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Sessions(StatefulProcessor):
    """Per session file: (root, cwd) from the first row that names them; events wait for it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "root string, cwd string")
        self.waiting = handle.getListState("waiting", "event string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        known = self.known.get() if self.known.exists() else None
        if known is not None:
            for part in rows:
                yield from self._out(key, known, part["event"].dropna())
            return
        for part in rows:
            if known is None:
                named = part[part["event"].isna()]
                if len(named):
                    known = named["root"].iloc[0], named["cwd"].iloc[0]
                    self.known.update(known)
                    if self.waiting.exists():
                        yield from self._out(key, known, (e for (e,) in self.waiting.get()))
                        self.waiting.clear()
            events = part["event"].dropna()
            if known is not None:
                yield from self._out(key, known, events)
            elif len(events):
                self.waiting.appendList([(e,) for e in events])

    @staticmethod
    def _out(key: tuple, known: tuple, events) -> Iterator[pd.DataFrame]:
        events = pd.Series(list(events), dtype=object)
        if len(events):
            same = lambda x: pd.Series([x] * len(events), dtype=object)
            yield pd.DataFrame({"session_file": same(key[0]), "root": same(known[0]), "cwd": same(known[1]), "event": events})

    def close(self) -> None:
        pass


def attached(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """A stream of the events (columns of ``EVENT``) with root and cwd, from a stream of events and one of (session_file, root, cwd).

    Each event comes out once, in the batch that has both it and its session, whichever came first; of several rows for
    a session the first one holds. Events wait in RocksDB, which ``PROVIDER`` must name. Rows without a session file are dropped.
    """
    spark = events.sparkSession
    if spark.conf.get(PROVIDER, "") != ROCKSDB:
        raise ValueError(f"set {PROVIDER} to {ROCKSDB}: waiting events are a list state")
    # Events cross the Python worker as text, with the instant in microseconds, so that no long turns into a float.
    packed = F.to_json(F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), *[c for c in EVENT.names if c not in ("ts", "session_file")]))
    none = F.lit(None).cast("string")
    both = events.select("session_file", none.alias("root"), none.alias("cwd"), packed.alias("event")).unionByName(sessions.select("session_file", "root", "cwd", none.alias("event")))
    out = both.where("session_file IS NOT NULL").groupBy("session_file").transformWithStateInPandas(Sessions(), _OUT, "Append", "None")
    fields = T.StructType([T.StructField("ts", T.LongType()), *[f for f in EVENT.fields if f.name not in ("ts", "session_file")]])
    e = out.select("session_file", "root", "cwd", F.inline(F.array(F.from_json("event", fields))))
    return e.withColumn("ts", F.timestamp_micros("ts"))


def _dated(e: DataFrame) -> DataFrame:
    return e.withColumns({"date": local_date(F.col("ts")), "minute": local_minute(F.col("ts")), "session": F.col("session_file")})


def _folders(spark: SparkSession, store: str) -> tuple[int, list[int]]:
    """(number up to which the newest base holds batches, or -1, numbers of the batches after it); a name per folder since that base."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(store).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path(store)):
        return -1, []
    names = [s.getPath().getName() for s in fs.listStatus(path(store))]
    base = max([int(m[1]) for n in names if (m := re.fullmatch(r"base-(\d+)", n))], default=-1)
    return base, sorted(k for n in names if (m := re.fullmatch(r"batch-(\d+)", n)) and (k := int(m[1])) > base)


def _parts(spark: SparkSession, store: str, kind: str, schema: T.StructType | str) -> DataFrame:
    base, batches = _folders(spark, store)
    paths = [f"{store}/base-{base}/{kind}"] * (base >= 0) + [f"{store}/batch-{n}/{kind}" for n in batches]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def live_sums(spark: SparkSession, store: str) -> DataFrame:
    """root, cwd, date and the sums of nine measures."""
    return _parts(spark, store, "sums", SUMS).groupBy(*KEYS).agg(*sums(MEASURES))


def live_bitmaps(spark: SparkSession, store: str) -> DataFrame:
    return bitmaps.merged(_parts(spark, store, "bits", BITS))


def live_days(spark: SparkSession, store: str, gap: int = 5) -> DataFrame:
    """The day rollup of all batches: sums add up, active minutes are read from the merged bitmaps."""
    return live_sums(spark, store).join(bitmaps.active_minutes(live_bitmaps(spark, store), gap), KEYS)


def write_batch(e: DataFrame, number: int, store: str) -> None:
    """Sums and bitmaps of one batch of attached events, in the batch's own folder, which appears whole."""
    spark = e.sparkSession
    rows, temp = _dated(e), f"{store}/.batch-{number}"
    rows.persist()  # two aggregates of one batch
    try:
        rows.groupBy(*KEYS).agg(*sums(MEASURES)).select(SUMS.names).write.mode("overwrite").parquet(f"{temp}/sums")
        bitmaps.bitmaps(rows).write.mode("overwrite").parquet(f"{temp}/bits")
    finally:
        rows.unpersist()
    _move(spark, temp, f"{store}/batch-{number}")


def _move(spark: SparkSession, temp: str, final: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(final).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(path(final), True)
    if not fs.rename(path(temp), path(final)):
        raise OSError(f"{temp} could not become {final}")


def fold(spark: SparkSession, store: str) -> None:
    """One base of the base and all batches so far; a reader sees the old ones or the new, and what the base holds then goes."""
    base, batches = _folders(spark, store)
    if not batches:
        return
    temp = f"{store}/.base-{batches[-1]}"
    live_sums(spark, store).select(SUMS.names).write.mode("overwrite").parquet(f"{temp}/sums")
    live_bitmaps(spark, store).write.mode("overwrite").parquet(f"{temp}/bits")
    _move(spark, temp, f"{store}/base-{batches[-1]}")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(store).getFileSystem(spark._jsc.hadoopConfiguration())
    for old in [f"base-{base}"] * (base >= 0) + [f"batch-{n}" for n in batches]:
        fs.delete(path(f"{store}/{old}"), True)


def ingest_live(events: DataFrame, sessions: DataFrame, store: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Keep ``store`` up to date from streams of events and of sessions; without ``every``, all that is available is processed once."""

    def batch(df: DataFrame, number: int) -> None:
        base, batches = _folders(df.sparkSession, store)
        if number <= base:  # tried again after it was folded
            return
        write_batch(df, number, store)
        if len(batches) + 1 >= FOLD:
            fold(df.sparkSession, store)

    writer = attached(events, sessions).writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def activity_stream(attached_events: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of minute bitmaps per session and day, in update mode: the stateful union of activity.

    The state of a session's day is its words; each batch puts out those that changed, whole. A day leaves the state once the
    watermark has passed its end, and events later than that are dropped. The clusters of ``bitmaps.active_minutes`` over the last row of each key
    are those of the batch form.
    """
    e = _dated(attached_events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("minute") % bitmaps.WORD).cast("int"))
    word = F.floor(F.col("minute") / bitmaps.WORD).cast("int")
    return e.groupBy(F.window("ts", "1 day").alias("day"), *KEYS, "session", word.alias("word")).agg(F.bit_or(bit).alias("bits")).drop("day")
