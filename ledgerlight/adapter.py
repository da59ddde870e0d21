"""Usage events from the driver's ``events`` table, alike in Spark and SQL.

Sessions, projects and roots come from the user id; tokens, lines and costs from value
and props. One session is left out of the session map, and one project has a cwd under
several roots. All money is rounded on output, so the order of a sum cannot show.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.functions.pricing import compute_cost, cost_sql, family_sql
from ledgerlight.operators.overrides import Overrides

SESSIONS = 36
MODELS = {"click": "opus-4-6", "view": "sonnet-4-5", "purchase": "haiku-4-5", "signup": "experimental-1", "error": ""}


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k").cast("bigint")
    e = e.withColumns({"s": F.col("user_id") % SESSIONS, "k": k, "units": F.floor(F.col("value") * 100).cast("bigint"), "edit": F.col("event_type") == "error"})
    model = F.lit("")
    for kind, m in MODELS.items():
        model = F.when(F.col("event_type") == kind, m).otherwise(model)
    z = F.lit(0).cast("bigint")
    tok = lambda c: F.when(F.col("edit"), z).otherwise(c)
    e = e.withColumns({"model": model, "input": tok(F.col("units")), "output": tok(F.col("k") * 10), "cache_read": tok(F.col("k") * 7), "cache_creation": tok(F.col("k")), "added": F.col("k") % 17, "deleted": F.col("k") % 5})
    given = F.when(F.col("event_id") % 10 == 0, F.col("value") / 100)
    cost = F.when(F.col("edit"), F.lit(0.0)).otherwise(compute_cost(F.col("model"), given, F.col("input"), F.col("output"), F.col("cache_read")))
    done = F.col("added") + F.col("deleted")
    return e.withColumns({"cost": cost, "suggested": F.when(F.col("edit"), z).otherwise(done), "accepted": F.when(F.col("edit"), done).otherwise(z), "session_file": F.concat(F.lit("s"), F.col("s").cast("string"), F.lit(".jsonl"))})


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["ts", "model", "input", "output", "cache_read", "cache_creation", "cost", "suggested", "accepted", "added", "deleted", "session_file"]
    return base(spark, sf_dir).select(cols)


def compressed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events with the minute of day divided by 16, so that activity clusters."""
    minute = (F.hour("ts") * 60 + F.minute("ts")).cast("bigint")
    day = F.date_trunc("day", "ts")
    squeezed = F.timestamp_add("MINUTE", F.floor(minute / 16), day)
    return usage_events(spark, sf_dir).withColumn("ts", squeezed)


def session_map(spark: SparkSession) -> DataFrame:
    rows = [(f"s{s}.jsonl", f"/home/u/.r{s // 12}/projects", f"/home/u/code/p{s % 12}") for s in range(SESSIONS - 1)]
    return spark.createDataFrame(rows, "session_file string, root string, cwd string")


def groups(spark: SparkSession) -> DataFrame:
    """One project per cwd, and one more that shares p0 and p1."""
    rows = [(f"/home/u/code/p{i}", f"code/p{i}", [f"/home/u/code/p{i}"], 3 if i < 11 else 2) for i in range(12)]
    rows.append(("/home/u/code/shared", "code/shared", ["/home/u/code/p0", "/home/u/code/p1"], 6))
    rows = [(r[0], r[1], r[2], r[3], pos) for pos, r in enumerate(sorted(rows, key=lambda r: r[1].lower()))]
    return spark.createDataFrame(rows, "root_key string, name string, cwds array<string>, sessions bigint, pos int")


def overrides() -> Overrides:
    return Overrides(stars={"/home/u/code/p4"}, hidden={"/home/u/code/p3"}, renames={"/home/u/code/p5": "Five"})


def as_of(spark: SparkSession, sf_dir: str) -> datetime:
    """The reporting instant of the queries: the last event, never the clock."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("ts")).first()[0]


_CASE = " ".join(f"WHEN '{k}' THEN '{m}'" for k, m in MODELS.items())
_COST = cost_sql("model", "given", "input", "output", "cache_read")
#: CTEs: u (events), sm (session map), j (joined), g (groups, a row per cwd), now.
SQL = f"""
 u0 AS (SELECT event_id, ts, user_id % {SESSIONS} AS s, event_type = 'error' AS edit, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
    CAST(floor(value * 100) AS BIGINT) AS units, CASE event_type {_CASE} ELSE '' END AS model FROM events),
 u1 AS (SELECT *, CASE WHEN edit THEN 0 ELSE units END AS input, CASE WHEN edit THEN 0 ELSE k * 10 END AS output, CASE WHEN edit THEN 0 ELSE k * 7 END AS cache_read,
    CASE WHEN edit THEN 0 ELSE k END AS cache_creation, k % 17 AS added, k % 5 AS deleted, CASE WHEN event_id % 10 = 0 THEN value / 100 END AS given FROM u0),
 u AS (SELECT *, CASE WHEN edit THEN 0.0::DOUBLE ELSE {_COST} END AS cost, CASE WHEN edit THEN 0 ELSE added + deleted END AS suggested,
    CASE WHEN edit THEN added + deleted ELSE 0 END AS accepted, 's' || s || '.jsonl' AS session_file, CAST(ts AS DATE) AS date, hour(ts) * 60 + minute(ts) AS minute,
    {family_sql('model')} AS family FROM u1),
 sm AS (SELECT 's' || i || '.jsonl' AS session_file, '/home/u/.r' || (i // 12) || '/projects' AS root, '/home/u/code/p' || (i % 12) AS cwd FROM range({SESSIONS - 1}) r(i)),
 j AS (SELECT u.*, root, cwd FROM u JOIN sm USING (session_file)),
 gr AS (SELECT '/home/u/code/p' || i AS root_key, 'code/p' || i AS name, ['/home/u/code/p' || i] AS cwds, CASE WHEN i < 11 THEN 3 ELSE 2 END AS sessions FROM range(12) r(i)
    UNION ALL SELECT '/home/u/code/shared', 'code/shared', ['/home/u/code/p0', '/home/u/code/p1'], 6),
 g AS (SELECT *, row_number() OVER (ORDER BY name) - 1 AS pos FROM gr),
 now AS (SELECT max(ts) AS at_, CAST(max(ts) AS DATE) AS today FROM events)"""
