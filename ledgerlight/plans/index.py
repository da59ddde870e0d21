"""A session-minute rollup that is kept from one reporting instant to the next.

The table is partitioned by date. A refresh takes one digest per date of the events, compares it with
the digests of what is stored, and rolls up and replaces only the dates that differ, by dynamic partition
overwrite; dates that have no events any more go. Questions about a window read its partitions alone.

Digests are written after the rows they speak for: a refresh that dies in between is done again for those
dates, and nothing is counted twice. One refresh runs at a time; readers see each date old or new.
"""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.functions.timewin import Window
from ledgerlight.operators import rollup
from ledgerlight.schema import DAY, MEASURES

_MEASURE = {f.name: f for f in DAY.fields}
ROLLED = T.StructType([T.StructField("root", T.StringType()), T.StructField("cwd", T.StringType()), T.StructField("model", T.StringType()), T.StructField("session", T.StringType()), T.StructField("minute", T.IntegerType()), *[_MEASURE[m] for m in MEASURES], T.StructField("date", T.DateType())])
DIGEST = "date date, n long, x long, s long"


class MinuteIndex:
    """The rollup below ``path`` on the shared store."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _stored(self, name: str, schema: T.StructType | str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def rows(self, w: Window | None = None) -> DataFrame:
        """root, cwd, model, session, minute, measures, date: of a window's dates only, if one is given."""
        df = self._stored("rows", ROLLED)
        return df if w is None else df.where(w.has_date(F.col("date")))

    def digests(self) -> DataFrame:
        """The digests of the last refresh: a row per date."""
        names = self._stored("newest", "name string").collect()  # one row
        return self._stored(f"digests/{names[0].name}", DIGEST) if names else self.spark.createDataFrame([], DIGEST)

    @staticmethod
    def digest(events: DataFrame) -> DataFrame:
        """date, n, x, s of attached events: their number, and an xor and a sum of their hashes."""
        h = F.xxhash64(*[F.col(c) for c in ("ts", "root", "cwd", "session_file", "model", *MEASURES)])
        return events.groupBy("date").agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1 << 40))).alias("s"))

    def refresh(self, events: DataFrame, session_map: DataFrame) -> list[date]:
        """Bring the index up to ``events``; returns the dates that were rolled up or removed."""
        here = self.digest(rollup.attach(events, session_map))
        name = uuid.uuid4().hex
        here.write.parquet(f"{self.path}/digests/{name}")  # a row per date
        here, there = self.spark.read.schema(DIGEST).parquet(f"{self.path}/digests/{name}"), self.digests()
        odd = here.alias("a").join(there.alias("b"), "date", "full").where("NOT (a.n <=> b.n AND a.x <=> b.x AND a.s <=> b.s)").select("date", F.col("a.n").isNull().alias("gone")).collect()
        fresh, gone = sorted(r.date for r in odd if not r.gone), sorted(r.date for r in odd if r.gone)
        if fresh:
            # Local dates are not the log's own: an event's date decides, after its time zone.
            near = rollup.dated(events).where(F.col("date").isin(fresh)).drop("date", "minute")
            rows = rollup.session_rollup(near, session_map).select(ROLLED.names)
            rows.hint("rebalance", "date").write.partitionBy("date").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.path}/rows")
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = fs_path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for d in gone:
            fs.delete(fs_path(f"{self.path}/rows/date={d}"), True)
        if odd:
            self.spark.createDataFrame([(name,)], "name string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/newest")
        newest = self._stored("newest", "name string").head(1)
        for old in fs.listStatus(fs_path(f"{self.path}/digests")):
            if not newest or old.getPath().getName() != newest[0].name:
                fs.delete(old.getPath(), True)
        return sorted(fresh + gone)
