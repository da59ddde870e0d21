"""Streaming ingest: whole days recomputed per micro-batch, merged into the history.

A naive sum per batch followed by a maximum would undercount, so the sink keeps the
batch's raw events by day and recomputes each touched day whole; the maximum merge is
idempotent, so a replayed batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerlight.functions.scalars import local_date
from ledgerlight.operators.rollup import day_rollup
from ledgerlight.schema import EVENT
from ledgerlight.sources.logs import parse
from ledgerlight.sources.store import update_history

#: Events as stored: partitioned by batch and day.
STORED = T.StructType([*EVENT.fields, T.StructField("batch", T.LongType()), T.StructField("day", T.DateType())])


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path)
    return parse(raw.select("value", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("session_file")))


def ingest(events: DataFrame, session_map: DataFrame, store: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Keep ``store``/events (by day and batch) and ``store``/history up to date.

    ``every`` is a trigger interval; without one, all that is available is processed once.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        # Overwriting a batch's own folder makes a retry exact.
        df.withColumn("day", local_date(F.col("ts"))).write.mode("overwrite").partitionBy("day").parquet(f"{store}/events/batch={number}")
        days = spark.read.schema(STORED).parquet(f"{store}/events/batch={number}").select("day").distinct() if not df.isEmpty() else None
        if days is not None:  # the touched days prune the partitions that are read
            kept = spark.read.schema(STORED).option("basePath", f"{store}/events").parquet(f"{store}/events").join(days, "day", "left_semi")
            update_history(spark, f"{store}/history", day_rollup(kept.drop("day", "batch"), session_map))

    writer = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def session_activity(events: DataFrame, session_map: DataFrame, gap: int = 5, late: str = "10 minutes") -> DataFrame:
    """A stream of active intervals per project: root, cwd, start, end, minutes."""
    e = events.join(session_map, "session_file").withColumn("ts", F.date_trunc("minute", "ts")).withWatermark("ts", late)
    s = e.groupBy("root", "cwd", local_date(F.col("ts")).alias("date"), F.session_window("ts", f"{gap} minutes").alias("w")).agg(F.count("*").alias("events"))
    n = ((F.unix_seconds(F.col("w.end").cast("timestamp")) - F.unix_seconds(F.col("w.start").cast("timestamp"))) / 60 - gap + 1).cast("bigint")
    return s.select("root", "cwd", "date", F.col("w.start").alias("start"), F.col("w.end").alias("end"), n.alias("minutes"), "events")
