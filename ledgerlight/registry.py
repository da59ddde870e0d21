"""Queries of the library's own operators, by operator id, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlight import adapter as ad
from ledgerlight.functions import fmt, scalars
from ledgerlight.functions.pricing import MODEL_ORDER, normalize_model
from ledgerlight.functions.timewin import TimeFilter, display_range, window
from ledgerlight.operators import activity, bitmaps, cards, diff, grouping, heatmap, history, kpi, labels, modelstats, overrides, repositories, rollup, series
from ledgerlight.schema import EVENT, LINES, MEASURES, SERIES
from ledgerlight.sources import logs
from ledgerlight.sources.shared import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
_Q: dict[str, Query] = {}
_SQL: dict[str, str] = {}

ROOT = "/home/u/.r1/projects"
CWDS = ["/home/u/code/p0", "/home/u/code/p1", "/home/u/code/p2"]
KEYS = ["root", "cwd", "date"]


def query(name: str, sql: str | None = None, ctes: str = ad.SQL):
    def add(f: Query) -> Query:
        _Q[name] = f
        if sql is not None:
            _SQL[name] = f"WITH {ctes}{sql}" if ctes else sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def money(df: DataFrame, *cols: str, places: int = 9) -> DataFrame:
    """Costs are multiples of 1e-8 or half of that: nine places hold them exactly."""
    return df.withColumns({c: F.round(c, places) for c in cols or ("cost",)})


def _sum(names) -> str:
    return ", ".join(f"round(sum({m}), 9) AS {m}" if m == "cost" else f"CAST(sum({m}) AS BIGINT) AS {m}" for m in names)


def _day(s: SparkSession, d: str) -> DataFrame:
    return rollup.day_rollup(ad.usage_events(s, d), ad.session_map(s))


def _sums(s: SparkSession, d: str) -> DataFrame:
    return rollup.day_sums(ad.usage_events(s, d), ad.session_map(s))


def _index(s: SparkSession, d: str) -> DataFrame:
    return rollup.minute_rollup(ad.usage_events(s, d), ad.session_map(s))


def _first(s: SparkSession, d: str):
    """The first day with events."""
    return rollup.attach(ad.base(s, d), ad.session_map(s)).agg(F.min("date")).first()[0]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily tokens, cost and lines by root and cwd, with active minutes."""
    return money(_day(spark, sf_dir))


# Active minutes: clusters per session, then their union; and with sessions pooled.
_W1 = """,
 m1 AS (SELECT DISTINCT root, cwd, date, {session} AS session, {minute} AS minute FROM {rows}),
 m2 AS (SELECT *, CASE WHEN minute - lag(minute) OVER w <= 5 THEN 0 ELSE 1 END AS brk FROM m1 WINDOW w AS (PARTITION BY root, cwd, date, session ORDER BY minute)),
 m3 AS (SELECT *, sum(brk) OVER (PARTITION BY root, cwd, date, session ORDER BY minute) AS run FROM m2),
 m4 AS (SELECT root, cwd, date, min(minute) AS s, max(minute) AS e FROM m3 GROUP BY root, cwd, date, session, run),
 m5 AS (SELECT *, max(e) OVER (PARTITION BY root, cwd, date ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM m4),
 m6 AS (SELECT *, sum(CASE WHEN s <= reach + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY root, cwd, date ORDER BY s, e) AS isle FROM m5),
 act AS (SELECT root, cwd, date, CAST(sum(n) AS BIGINT) AS active_minutes FROM (SELECT root, cwd, date, max(e) - min(s) + 1 AS n FROM m6 GROUP BY root, cwd, date, isle) GROUP BY root, cwd, date)"""
PER_SESSION = _W1.format(session="session_file", minute="minute", rows="j")
POOLED = _W1.format(session="0", minute="minute", rows="j")
_DAY = f"{PER_SESSION}, day AS (SELECT root, cwd, date, {', '.join(f'sum({m}) AS {m}' for m in MEASURES)} FROM j GROUP BY root, cwd, date)"
_IDX = f", idx AS (SELECT root, cwd, family AS model, date, minute, {', '.join(f'sum({m}) AS {m}' for m in MEASURES)} FROM j GROUP BY root, cwd, family, date, minute)"


@query("j1_attach_sessions", "SELECT event_id, session_file, root, cwd, date, CAST(minute AS INTEGER) AS minute FROM j")
def _j1(s, d):
    return rollup.attach(ad.base(s, d), ad.session_map(s)).select("event_id", "session_file", "root", "cwd", "date", "minute")


@query("x8_x9_cost", "SELECT event_id, model, round(cost, 9) AS cost FROM u")
def _x8(s, d):
    return ad.base(s, d).select("event_id", "model", F.round("cost", 9).alias("cost"))


@query("x10_normalize_model", "SELECT event_id, model, family FROM u")
def _x10(s, d):
    return ad.base(s, d).select("event_id", "model", normalize_model(F.col("model")).alias("family"))


@query("x13_local_date_minute", "SELECT event_id, CAST(ts AS DATE) AS date, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS minute FROM events", "")
def _x13(s, d):
    return s.read.parquet(f"{d}/events.parquet").select("event_id", scalars.local_date(F.col("ts")).alias("date"), scalars.local_minute(F.col("ts")).alias("minute"))


@query("a1_day_rollup", f"{_DAY} SELECT root, cwd, date, {_sum(MEASURES)}, any_value(active_minutes) AS active_minutes FROM day JOIN act USING (root, cwd, date) GROUP BY root, cwd, date")
def _a1(s, d):
    return money(_day(s, d))


@query("a2_minute_rollup", f" SELECT root, cwd, family AS model, date, CAST(minute AS INTEGER) AS minute, {_sum(MEASURES)} FROM j GROUP BY root, cwd, family, date, minute")
def _a2(s, d):
    return money(_index(s, d))


@query("a2_d6_maintained_index", f"{_IDX} SELECT root, cwd, model, date, CAST(minute AS INTEGER) AS minute, {', '.join(f'round({m}, 9) AS {m}' if m == 'cost' else f'CAST({m} AS BIGINT) AS {m}' for m in MEASURES)} FROM idx")
def _a2m(s, d):
    """The index as three instants leave it: the first events, an edit of one day, all events."""
    from ledgerlight.plans.index import MinuteIndex

    index, events, sessions, at = MinuteIndex(s, f"{shared_dir(s)}/index-{uuid.uuid4().hex}"), ad.usage_events(s, d), ad.session_map(s), ad.as_of(s, d)
    index.refresh(events.where(F.col("ts") < F.lit(at - timedelta(days=9))), sessions)
    index.refresh(events.where(F.to_date("ts") != F.lit(at.date() - timedelta(days=12))), sessions)
    index.refresh(events, sessions)
    return money(rollup.by_minute(index.rows()))


def _daily_sql(where: str = "true", source: str = "j") -> str:
    cols = ", ".join(f"CAST(nullif(sum({m}), 0) AS BIGINT) AS {m}" if m in LINES else f"round(sum({m}), 9) AS {m}" if m == "cost" else f"CAST(sum({m}) AS BIGINT) AS {m}" for m in SERIES)
    return f" SELECT date, {cols} FROM {source} WHERE {where} GROUP BY date"


@query("a3_daily_tokens", _daily_sql())
def _a3(s, d):
    return money(rollup.daily(_sums(s, d)))


@query("a3_f1_f2_daily_of_root_and_project", _daily_sql(f"root = '{ROOT}' AND cwd IN ({', '.join(repr(c) for c in CWDS)})"))
def _a3f(s, d):
    return money(rollup.daily(_sums(s, d), ROOT, CWDS))


@query("f3_f4_unknown_root_or_cwd", _daily_sql("false"))
def _f3(s, d):
    return money(rollup.daily(_sums(s, d), "/nowhere").unionByName(rollup.daily(_sums(s, d), None, ["/nowhere"])))


@query("a4_minute_tokens", f" SELECT date, CAST(minute AS INTEGER) AS minute, {_sum(SERIES)} FROM j GROUP BY date, minute")
def _a4(s, d):
    return money(rollup.minutes(_index(s, d)))


_FILTERS = {
    TimeFilter.ALL: "true",
    TimeFilter.LAST_MONTH: "date BETWEEN (SELECT today - 29 FROM now) AND (SELECT today FROM now)",
    TimeFilter.LAST_WEEK: "date BETWEEN (SELECT today - 6 FROM now) AND (SELECT today FROM now)",
    TimeFilter.TODAY: "date = (SELECT today FROM now)",
}
for _f, _n in ((TimeFilter.HOUR12, 720), (TimeFilter.HOUR1, 60)):
    _at = f"(SELECT at_ - INTERVAL {_n} MINUTE FROM now)"
    _FILTERS[_f] = f"date BETWEEN CAST({_at} AS DATE) AND (SELECT today FROM now) AND NOT (date = CAST({_at} AS DATE) AND minute < hour({_at}) * 60 + minute({_at}))"

_IDS = {TimeFilter.ALL: "f5_all", TimeFilter.LAST_MONTH: "f8_last_month", TimeFilter.LAST_WEEK: "f7_last_week", TimeFilter.TODAY: "f6_today", TimeFilter.HOUR12: "f9_f10_hour12", TimeFilter.HOUR1: "f9_f10_hour1"}


def _windowed(f: TimeFilter):
    def run(s: SparkSession, d: str) -> DataFrame:
        w = window(f, ad.as_of(s, d))
        out = rollup.daily_from_minutes(rollup.minutes(_index(s, d)), w) if f.is_subday else rollup.daily(_sums(s, d)).where(w.has_date(F.col("date")))
        return money(out)

    return run


for _f, _id in _IDS.items():
    _sub = f" SELECT date, {_sum(SERIES)} FROM j WHERE {_FILTERS[_f]} GROUP BY date"
    query(f"{_id}_daily", _sub if _f.is_subday else _daily_sql(_FILTERS[_f]))(_windowed(_f))


def _pooled(where: str, ctes: str = POOLED) -> str:
    return ctes.replace("FROM j)", f"FROM j WHERE {where})", 1)


@query("a6_subday_rollup", f"{_pooled(_FILTERS[TimeFilter.HOUR12])}, d AS (SELECT * FROM j WHERE {_FILTERS[TimeFilter.HOUR12]}) SELECT root, cwd, date, {_sum(MEASURES)}, any_value(active_minutes) AS active_minutes FROM d JOIN act USING (root, cwd, date) GROUP BY root, cwd, date")
def _a6(s, d):
    return money(rollup.subday(_index(s, d), window(TimeFilter.HOUR12, ad.as_of(s, d))))


_SQUEEZE = "(minute // 16)"


@query("w1_active_minutes", _W1.format(session="session_file", minute=_SQUEEZE, rows="j") + " SELECT * FROM act")
def _w1(s, d):
    return rollup.day_rollup(ad.compressed_events(s, d), ad.session_map(s)).select(*KEYS, "active_minutes")


@query("w2_pooled_active_minutes", _W1.format(session="0", minute=_SQUEEZE, rows="j") + " SELECT * FROM act")
def _w2(s, d):
    return activity.pooled_active_minutes(rollup.attach(ad.compressed_events(s, d), ad.session_map(s)).select(*KEYS, "minute"))


@query("w2b_session_window_minutes", _W1.format(session="0", minute=_SQUEEZE, rows="j") + " SELECT * FROM act")
def _w2b(s, d):
    return activity.session_window_minutes(rollup.attach(ad.compressed_events(s, d), ad.session_map(s)).select(*KEYS, "ts"))


def _bits(s: SparkSession, d: str) -> DataFrame:
    """Minute bitmaps of the compressed events, merged from four parts, two of which overlap."""
    e = rollup.attach(ad.compressed_events(s, d), ad.session_map(s)).withColumn("session", F.col("session_file"))
    return bitmaps.merged(*[bitmaps.bitmaps(e.where(F.col("input") % 5 >= i).where(F.col("input") % 5 <= i + 2)) for i in (0, 1, 2)], bitmaps.bitmaps(e.where("input % 5 = 4")))


@query("w1_bitmap_active_minutes", _W1.format(session="session_file", minute=_SQUEEZE, rows="j") + " SELECT * FROM act")
def _w1b(s, d):
    return bitmaps.active_minutes(_bits(s, d))


@query("w2_bitmap_pooled_minutes", _W1.format(session="0", minute=_SQUEEZE, rows="j") + " SELECT * FROM act")
def _w2bits(s, d):
    return bitmaps.pooled_active_minutes(_bits(s, d))


@query("a6_bitmap_subday_minutes", f"{_pooled(_FILTERS[TimeFilter.HOUR12])} SELECT * FROM act")
def _a6b(s, d):
    e = rollup.attach(ad.usage_events(s, d), ad.session_map(s)).withColumn("session", F.col("session_file"))
    return bitmaps.pooled_active_minutes(bitmaps.within(bitmaps.bitmaps(e), window(TimeFilter.HOUR12, ad.as_of(s, d))))


def _history(s: SparkSession, d: str) -> DataFrame:
    """A made-up past: odd days only, some measures higher, and one deleted project."""
    day = _day(s, d).where(F.dayofmonth("date") % 2 == 1)
    grown = day.withColumns({"input": F.col("input") + 1000, "output": F.floor(F.col("output") / 2).cast("bigint"), "cost": F.col("cost") / 2})
    return grown.unionByName(grown.where("cwd = '/home/u/code/p1'").withColumn("cwd", F.lit("/home/u/old")))


_MERGE = f"""{_DAY}, fresh AS (SELECT day.*, active_minutes FROM day JOIN act USING (root, cwd, date)),
 h1 AS (SELECT * REPLACE (input + 1000 AS input, output // 2 AS output, cost / 2 AS cost) FROM fresh WHERE day(date) % 2 = 1),
 h AS (SELECT * FROM h1 UNION ALL SELECT * REPLACE ('/home/u/old' AS cwd) FROM h1 WHERE cwd = '/home/u/code/p1'),
 merged AS (SELECT root, cwd, date, {', '.join(f'greatest(coalesce(a.{m}, b.{m}), coalesce(b.{m}, a.{m})) AS {m}' for m in [*MEASURES, 'active_minutes'])} FROM fresh a FULL JOIN h b USING (root, cwd, date))"""


@query("j6_u3_history_merge", f"{_MERGE} SELECT root, cwd, date, {', '.join(f'round({m}, 9) AS {m}' if m == 'cost' else f'CAST({m} AS BIGINT) AS {m}' for m in [*MEASURES, 'active_minutes'])} FROM merged")
def _j6(s, d):
    return money(history.merge(_history(s, d), _day(s, d)))


_KPI = """, dl AS ({daily}), act2 AS (SELECT DISTINCT date FROM dl WHERE input + output > 0 AND date <= (SELECT today FROM now)),
 st AS (SELECT count(*) AS streak FROM (SELECT date, row_number() OVER (ORDER BY date DESC) - 1 AS b FROM act2) WHERE date + CAST(b AS INTEGER) = (SELECT today FROM now))
 SELECT coalesce(round(sum(cost), 9), 0.0) AS total_cost, CASE WHEN sum(suggested) > 0 THEN least(coalesce(sum(accepted), 0) / sum(suggested)::DOUBLE * 100, 100.0) ELSE 0.0 END AS accept_rate,
 count(DISTINCT date) AS active_days, CAST(coalesce(max(date) - min(date) + 1, 0) AS BIGINT) AS total_days,
 CAST(CASE WHEN count(DISTINCT date) > 0 THEN (sum(input) + sum(output)) // count(DISTINCT date) ELSE 0 END AS BIGINT) AS avg_tokens,
 CASE WHEN coalesce(sum(added), 0) + coalesce(sum(deleted), 0) > 0 THEN (sum(input) + sum(output)) / (coalesce(sum(added), 0) + coalesce(sum(deleted), 0))::DOUBLE ELSE 0.0 END AS efficiency,
 any_value(st.streak) AS streak FROM dl, st"""


def _kpi(f: TimeFilter):
    run_daily = _windowed(f)
    return lambda s, d: money(kpi.kpis(run_daily(s, d), ad.as_of(s, d)), "total_cost")


for _f in (TimeFilter.ALL, TimeFilter.LAST_WEEK, TimeFilter.HOUR12):
    _body = f"SELECT date, {_sum(SERIES)} FROM j WHERE {_FILTERS[_f]} GROUP BY date" if _f.is_subday else _daily_sql(_FILTERS[_f])
    query(f"a8_a12_w3_kpis_{_f.name.lower()}", _KPI.format(daily=_body))(_kpi(_f))


# Model statistics.
_BRIDGE = ", br AS (SELECT cwd, max_by(root_key, pos) AS root_key FROM (SELECT pos, root_key, unnest(cwds) AS cwd FROM g) GROUP BY cwd)"
_STATS = f"{_IDX}{_BRIDGE}, ms AS (SELECT idx.*, root_key FROM idx JOIN br USING (cwd))"


def _stats(s: SparkSession, d: str, f: TimeFilter = TimeFilter.ALL, by_minute: bool = False) -> dict[str, DataFrame]:
    return modelstats.model_stats(_index(s, d), modelstats.cwd_bridge(ad.groups(s)), window(f, ad.as_of(s, d)), by_minute=by_minute)


_TOKENS = " SELECT root_key, model, CAST(sum(input + output) AS BIGINT) AS tokens FROM ms WHERE model <> 'other' OR input + output > 0 GROUP BY root_key, model"


@query("a7_f16_f18_j2_model_tokens", _STATS + _TOKENS)
def _a7(s, d):
    return _stats(s, d)["tokens"]


@query("a7_f17_model_daily_costs", _STATS + " SELECT root_key, model, date, round(sum(cost), 9) AS cost FROM ms WHERE cost > 0 GROUP BY root_key, model, date")
def _a7d(s, d):
    return money(_stats(s, d)["daily"])


@query("a7_model_minute_costs_today", _STATS + f" SELECT root_key, model, date, CAST(minute AS INTEGER) AS minute, round(sum(cost), 9) AS cost FROM ms WHERE cost > 0 AND {_FILTERS[TimeFilter.TODAY]} GROUP BY root_key, model, date, minute")
def _a7m(s, d):
    return money(_stats(s, d, TimeFilter.TODAY, True)["minute"])


@query("a17_o5_model_shares", _STATS + f", t AS ({_TOKENS}), sh AS (SELECT root_key, model, tokens / sum(tokens) OVER (PARTITION BY root_key)::DOUBLE AS share FROM t) SELECT root_key, model, round(share, 9) AS share, CAST(row_number() OVER (PARTITION BY root_key ORDER BY share DESC, model) AS INTEGER) AS rank FROM sh")
def _a17(s, d):
    return modelstats.shares(_stats(s, d)["tokens"]).withColumn("share", F.round("share", 9))


_ORD = f"list_position({MODEL_ORDER!r}, model)"


@query("a18_model_series", _STATS + f", dc AS (SELECT root_key, model, date, sum(cost) AS cost FROM ms WHERE cost > 0 GROUP BY root_key, model, date) SELECT root_key, model, date, round(cost, 9) AS cost, CAST(dense_rank() OVER (PARTITION BY root_key ORDER BY {_ORD}) - 1 AS INTEGER) AS place FROM dc")
def _a18(s, d):
    x = modelstats.daily_series(_stats(s, d)["daily"]).select("root_key", F.posexplode("model_daily_costs").alias("place", "m"))
    return money(x.select("root_key", "place", "m.model", F.explode("m.series").alias("p")).select("root_key", "model", "p.date", "p.cost", "place"))


# Cards.
_HIDDEN = "/home/u/code/p3"
_CARDS = f"""{_DAY}, dd AS (SELECT day.*, active_minutes FROM day JOIN act USING (root, cwd, date)),
 vis AS (SELECT root_key, CASE WHEN root_key = '/home/u/code/p5' THEN 'Five' ELSE name END AS name, root_key = '/home/u/code/p4' AS starred, pos, sessions, cwds FROM g WHERE root_key <> '{_HIDDEN}'),
 vc AS (SELECT root_key, unnest(cwds) AS cwd FROM vis),
 ct AS (SELECT root_key, sum(cost) AS total_cost, sum(input) AS tokens_in, sum(output) AS tokens_out, sum(cache_read + cache_creation) AS tokens_cache, sum(added) AS lines_added, sum(deleted) AS lines_deleted,
   sum(suggested) AS lines_suggested, sum(accepted) AS lines_accepted, min(date) AS first_activity, max(date) AS last_activity, count(DISTINCT date) AS active_days, sum(active_minutes) AS time_minutes
   FROM vc JOIN dd USING (cwd) WHERE {{where}} GROUP BY root_key),
 cd AS (SELECT *, CASE WHEN lines_added + lines_deleted > 0 THEN (tokens_in + tokens_out) / (lines_added + lines_deleted)::DOUBLE ELSE 0.0 END AS efficiency FROM vis JOIN ct USING (root_key)),
 ranked AS (SELECT *, row_number() OVER (ORDER BY starred DESC, total_cost DESC, pos) AS rank FROM cd),
 q AS (SELECT coalesce(quantile_cont(efficiency, [0.25, 0.5, 0.75]), [500.0, 1000.0, 1500.0]) AS q FROM cd WHERE efficiency > 0)"""
_TOTALS = ["tokens_in", "tokens_out", "tokens_cache", "lines_added", "lines_deleted", "lines_suggested", "lines_accepted", "active_days", "time_minutes"]
_CARD = ["root_key", "name", "starred", "sessions", "total_cost", *_TOTALS, "first_activity", "last_activity", "efficiency", "net_lines", "total_lines", "span_days", "accept_pct", "rank", "bars"]
_CARD_SQL = f""" SELECT root_key, name, starred, CAST(sessions AS BIGINT) AS sessions, round(total_cost, 9) AS total_cost, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _TOTALS)}, first_activity, last_activity, efficiency,
 CAST(lines_added - lines_deleted AS BIGINT) AS net_lines, CAST(lines_added + lines_deleted AS BIGINT) AS total_lines, CAST(last_activity - first_activity + 1 AS INTEGER) AS span_days,
 CASE WHEN lines_suggested > 0 THEN lines_accepted / lines_suggested::DOUBLE * 100 END AS accept_pct, CAST(rank AS INTEGER) AS rank,
 CASE WHEN efficiency > 0 THEN CASE WHEN efficiency <= q[1] THEN 4 WHEN efficiency <= q[2] THEN 3 WHEN efficiency <= q[3] THEN 2 ELSE 1 END END AS bars FROM ranked, q"""


def _cards(s: SparkSession, d: str, f: TimeFilter = TimeFilter.ALL) -> DataFrame:
    return cards.cards(ad.groups(s), ad.overrides().display(s), _day(s, d), _stats(s, d, f), window(f, ad.as_of(s, d)))


for _f in (TimeFilter.ALL, TimeFilter.LAST_WEEK):
    query(f"a13_a15_x24_o2_cards_{_f.name.lower()}", _CARDS.format(where=_FILTERS[_f]) + _CARD_SQL)(
        lambda s, d, f=_f: money(cards.ordered(cards.with_gauge(_cards(s, d, f))).select(_CARD), "total_cost")
    )


@query("f13_j3_cards_of_project", _CARDS.format(where="true").replace("WHERE root_key <> '/home/u/code/p3'", "WHERE root_key <> '/home/u/code/p3' AND list_has_any(cwds, ['/home/u/code/p0'])") + " SELECT root_key, name, CAST(tokens_in AS BIGINT) AS tokens_in, CAST(active_days AS BIGINT) AS active_days FROM ranked")
def _f13(s, d):
    shown = cards.visible(ad.groups(s), ad.overrides().display(s), ["/home/u/code/p0"])
    return shown.join(cards.card_totals(shown, _day(s, d), window(TimeFilter.ALL, ad.as_of(s, d))), "root_key").select("root_key", "name", "tokens_in", "active_days")


@query("a16_card_series", _CARDS.format(where="true") + " SELECT root_key, date, round(sum(cost), 9) AS cost, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output FROM vc JOIN dd USING (cwd) GROUP BY root_key, date")
def _a16(s, d):
    z = F.explode(F.arrays_zip("daily_cost", "daily_input", "daily_output"))
    x = _cards(s, d).select("root_key", z.alias("z"))
    return money(x.select("root_key", "z.daily_cost.date", F.col("z.daily_cost.value").alias("cost"), F.col("z.daily_input.value").alias("input"), F.col("z.daily_output.value").alias("output")))


@query("a22_efficiency_quartiles", _CARDS.format(where="true") + " SELECT i AS part, round(q[i], 6) AS value FROM q, (SELECT unnest([1, 2, 3]) AS i)")
def _a22(s, d):
    x = cards.efficiency_quartiles(_cards(s, d)).select(F.posexplode("q").alias("part", "value"))
    return x.select((F.col("part") + 1).alias("part"), F.round("value", 6).alias("value"))


@query("o7_second_page", _CARDS.format(where="true") + " SELECT root_key, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank > 4 AND rank <= 8")
def _o7(s, d):
    return cards.page(_cards(s, d), 4, 4).select("root_key", "rank")


@query("j4_j9_w6_card_models", _CARDS.format(where="true") + f"{_STATS}, t AS ({_TOKENS}) SELECT root_key, CAST(rank AS INTEGER) AS rank, model, CAST(tokens AS BIGINT) AS tokens FROM ranked LEFT JOIN t USING (root_key)")
def _j4(s, d):
    return cards.ordered(_cards(s, d)).select("root_key", "rank").join(_stats(s, d)["tokens"], "root_key", "left").select("root_key", "rank", "model", "tokens")


# Heatmaps.
_TH = """(SELECT CASE WHEN len(v) > 0 THEN [v[len(v) // 4 + 1], v[len(v) // 2 + 1], v[len(v) * 3 // 4 + 1], v[len(v)]] ELSE [1, 2, 3, 4] END FROM (SELECT list_sort(coalesce(list({c}) FILTER (WHERE {c} > 0), [])) AS v FROM {t}))"""
_DL = f", dl AS ({_daily_sql()})"


@query("a20_a21_thresholds", _DL + " SELECT c AS measure, CAST(i AS INTEGER) AS rank, CAST(t[i] AS BIGINT) AS value FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS c, {_TH.format(c=c, t='dl')} AS t" for c in ("input", "output", "accepted")) + "), (SELECT unnest([1, 2, 3, 4]) AS i)")
def _a20(s, d):
    t = heatmap.thresholds(rollup.daily(_sums(s, d)))
    rows = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("t")) for c in ("input", "output", "accepted")])
    return t.select(F.explode(rows).alias("x")).select("x.measure", F.posexplode("x.t").alias("rank", "value")).withColumn("rank", F.col("rank") + 1)


_BOX = "SELECT CAST(b AS INTEGER) AS bucket, {cells}, CAST(CASE WHEN sum(coalesce(suggested, 0)) > 0 THEN trunc(least(sum(coalesce(accepted, 0)) / sum(coalesce(suggested, 0))::DOUBLE * 100, 100.0)) ELSE 0 END AS BIGINT) AS rate, CAST({row} AS INTEGER) AS row, CAST({col} AS INTEGER) AS col, b < {active} AS active FROM range({n}) r(b) LEFT JOIN ({src}) x ON x.bk = b GROUP BY b"
_CELLS = ", ".join(f"CAST(sum(coalesce({c}, 0)) AS BIGINT) AS {c}" for c in heatmap.CELLS)
_STARTS = {"today": "(SELECT date_trunc('day', at_) FROM now)", "hours12": "(SELECT date_trunc('hour', at_ - INTERVAL 11 HOUR) FROM now)", "hour1": "(SELECT date_trunc('minute', at_ - INTERVAL 59 MINUTE) FROM now)"}
_MODES = {"today": (heatmap.TODAY, "b % 6", "b // 6"), "hours12": (heatmap.HOURS12, "b % 6", "b // 6"), "hour1": (heatmap.HOUR1, "b // 10", "b % 10")}
_BOXES = {}
for _name, (_mode, _row, _col) in _MODES.items():
    _st = _STARTS[_name]
    _src = f"SELECT date_diff('minute', {_st}, date_trunc('minute', ts)) // {_mode.minutes} AS bk, j.* FROM j WHERE ts >= {_st}"
    _active = f"(SELECT least(CAST(floor(epoch(at_) - epoch({_st})) AS BIGINT) // 60 // {_mode.minutes} + 1, {_mode.buckets}) FROM now)"
    _BOXES[_name] = _BOX.format(cells=_CELLS, row=_row, col=_col, active=_active, n=_mode.buckets, src=_src)
    query(f"b1_b4_intraday_{_name}", " " + _BOXES[_name])(lambda s, d, m=_mode: heatmap.intraday(rollup.minutes(_index(s, d)), m, ad.as_of(s, d)))

_BOXES["weekly"] = _BOX.format(cells=_CELLS, row="b % 6", col="b // 6", active="(SELECT 36 + hour(at_) // 4 + 1 FROM now)", n=42, src="SELECT (date - (SELECT today - 6 FROM now)) * 6 + (minute // 60) // 4 AS bk, j.* FROM j")


@query("b5_b6_weekly", " " + _BOXES["weekly"])
def _b5(s, d):
    return heatmap.weekly(rollup.minutes(_index(s, d)), ad.as_of(s, d))


_PANEL = f", bx AS ({_BOXES['weekly']}), ac AS (SELECT * FROM bx WHERE active) SELECT " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}_total" for c in heatmap.CELLS)


@query("a23_panel_totals", _PANEL + ", CASE WHEN sum(suggested) > 0 THEN least(sum(accepted) / sum(suggested)::DOUBLE * 100, 100.0) ELSE 0.0 END AS rate, " + ", ".join(f"any_value(CAST({_TH.format(c=c, t='ac')} AS VARCHAR)) AS {c}_thresholds" for c in ("input", "output", "accepted")) + " FROM ac")
def _a23(s, d):
    p = heatmap.panel(_b5(s, d))
    text = {f"{c}_thresholds": F.concat(F.lit("["), F.array_join(F.col(f"{c}_thresholds").cast("array<string>"), ", "), F.lit("]")) for c in ("input", "output", "accepted")}
    return p.withColumns(text)


_LEVEL = "CASE WHEN value = 0 THEN 0 WHEN value <= t[1] THEN 1 WHEN value <= t[2] THEN 2 WHEN value <= t[3] THEN 3 WHEN value <= t[4] THEN 4 WHEN value IS NOT NULL THEN 4 END"


@query("b7_x20_calendar", _DL + f""", th AS (SELECT {_TH.format(c='input', t='dl')} AS t), r AS (SELECT today, min(date) AS first FROM dl, now GROUP BY today),
 st AS (SELECT today, today - CAST(dayofweek(today) AS INTEGER) - 7 * (CAST(least(53, ceil((today - first + 1) / 7.0) + 1) AS INTEGER) - 1) AS s FROM r),
 days AS (SELECT s, CAST(unnest(generate_series(s, today, INTERVAL 1 DAY)) AS DATE) AS date FROM st)
 SELECT days.date, CAST((days.date - s) // 7 AS INTEGER) AS week, CAST((days.date - s) % 7 AS INTEGER) AS weekday, value, CAST({_LEVEL} AS INTEGER) AS level FROM days LEFT JOIN (SELECT date, input AS value FROM dl) x USING (date), th""")
def _b7(s, d):
    day, at = rollup.daily(_sums(s, d)), ad.as_of(s, d)
    first, last = display_range(TimeFilter.ALL, at, _first(s, d))
    return heatmap.calendar(day, "input", first, last, at, heatmap.thresholds(day))


@query("w4_w5_x34_trend", _DL + """, gd AS (SELECT CAST(i AS INTEGER) AS i, (SELECT today - 27 FROM now) + CAST(i AS INTEGER) AS date FROM range(28) r(i)), v AS (SELECT i, gd.date, coalesce(CAST(output AS DOUBLE), 0.0) AS value FROM gd LEFT JOIN dl USING (date)),
 sm2 AS (SELECT *, avg(value) OVER (ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS smoothed FROM v)
 SELECT i, date, value, round(smoothed, 6) AS smoothed, round(cbrt(smoothed), 6) AS scaled, round(greatest(max(cbrt(smoothed)) OVER (), 1.0), 6) AS top FROM sm2""")
def _w4(s, d):
    return money(heatmap.trend(rollup.daily(_sums(s, d)), "output", 28, ad.as_of(s, d)), "smoothed", "scaled", "top", places=6)


@query("x21_j11_accept_rate_by_day", _DL + " SELECT date, CAST(trunc(least(coalesce(accepted, 0) / suggested::DOUBLE * 100, 100.0)) AS BIGINT) AS rate FROM dl WHERE suggested > 0")
def _x21(s, d):
    return rollup.daily(_sums(s, d)).where("suggested > 0").select("date", scalars.accept_rate(F.coalesce("accepted", F.lit(0)), F.col("suggested")).alias("rate"))


# Chart series.
_DENSE = f"{_STATS}, dc AS (SELECT root_key, model, date, sum(cost) AS c FROM ms WHERE cost > 0 GROUP BY root_key, model, date), rg AS (SELECT min(date) AS a, (SELECT today FROM now) AS b FROM j), k AS (SELECT DISTINCT root_key, model FROM dc), grid AS (SELECT root_key, model, CAST(i AS INTEGER) AS i, a + CAST(i AS INTEGER) AS date FROM k, (SELECT a, unnest(range(b - a + 1)) AS i FROM rg)), dn AS (SELECT root_key, model, i, coalesce(c, 0.0) AS value FROM grid LEFT JOIN dc USING (root_key, model, date))"
_KEYS = ("root_key", "model")


def _dense(s: SparkSession, d: str) -> tuple[DataFrame, int]:
    daily, at = _stats(s, d)["daily"], ad.as_of(s, d)
    first, last = display_range(TimeFilter.ALL, at, _first(s, d))
    return series.dense_daily(daily, "cost", first, last, _KEYS), (last - first).days + 1


@query("b9_j8_dense_daily", _DENSE + " SELECT root_key, model, i, round(value, 9) AS value FROM dn")
def _b9(s, d):
    return money(_dense(s, d)[0], "value")


def _rebucket_sql(width: int) -> str:
    down = f"SELECT root_key, model, CAST(o AS INTEGER) AS i, round(sum(value), 9) AS value FROM dn, n, range({width}) w(o) WHERE n.n > {width} AND i >= floor(o * (n.n / {width}::DOUBLE)) AND i < floor((o + 1) * (n.n / {width}::DOUBLE)) GROUP BY root_key, model, o"
    up = f"SELECT root_key, model, CAST(o AS INTEGER) AS i, round(value, 9) AS value FROM dn, n, range({width}) w(o) WHERE n.n <= {width} AND i = o * n.n // {width}"
    return f"{_DENSE}, n AS (SELECT b - a + 1 AS n FROM rg) {down} UNION ALL {up}"


for _w in (12, 100):
    query(f"b10_rebucket_{_w}", _rebucket_sql(_w))(lambda s, d, w=_w: money(series.rebucket(*_dense(s, d), w, _KEYS), "value"))


@query("b11_x35_sparkline", f"{_DENSE}, n AS (SELECT b - a + 1 AS n FROM rg), sp AS (SELECT root_key, model, o AS i, sum(value) AS value FROM dn, n, range(12) w(o) WHERE i >= floor(o * (n.n / 12::DOUBLE)) AND i < floor((o + 1) * (n.n / 12::DOUBLE)) GROUP BY root_key, model, o), mx AS (SELECT *, cbrt(value) AS c, max(cbrt(value)) OVER (PARTITION BY root_key, model) AS m FROM sp) SELECT root_key, model, CAST(i AS INTEGER) AS i, CAST(CASE WHEN m <= 0 OR value <= 0 THEN 0 ELSE least(greatest(round(c / m * 7), 1), 7) END AS INTEGER) AS level FROM mx")
def _b11(s, d):
    return series.sparkline(series.rebucket(*_dense(s, d), 12, _KEYS, upsample=False), _KEYS).select(*_KEYS, "i", "level")


@query("b12_b13_minute_buckets", f"{_STATS}, mc AS (SELECT root_key, model, minute, sum(cost) AS c FROM ms WHERE cost > 0 AND {_FILTERS[TimeFilter.TODAY]} GROUP BY root_key, model, minute), k AS (SELECT DISTINCT root_key, model FROM mc), st AS (SELECT greatest(hour(at_) * 60 + minute(at_) - 720, 0) AS s FROM now) SELECT root_key, model, CAST(b AS INTEGER) AS i, round(coalesce(sum(c), 0.0), 9) AS value FROM k CROSS JOIN range(24) r(b) CROSS JOIN st LEFT JOIN mc ON mc.root_key = k.root_key AND mc.model = k.model AND mc.minute >= s AND (mc.minute - s) // 30 = b GROUP BY ALL".replace("SELECT root_key, model, CAST(b", "SELECT k.root_key, k.model, CAST(b"))
def _b12(s, d):
    stats = _stats(s, d, TimeFilter.TODAY, True)
    return money(series.minute_buckets(stats["minute"], "cost", series.GRANULARITY[TimeFilter.HOUR12], ad.as_of(s, d), _KEYS), "value")


@query("a25_a26_stacked_layers", f"{_DENSE}, tt AS (SELECT *, sum(value) OVER (PARTITION BY root_key, i) AS total, sum(value) OVER (PARTITION BY root_key, i ORDER BY {_ORD} ROWS UNBOUNDED PRECEDING) AS run FROM dn), tp AS (SELECT *, max(total) OVER (PARTITION BY root_key) AS top FROM tt) SELECT root_key, model, i, round(total, 9) AS total, round(run / CASE WHEN top > 0 THEN top ELSE 1 END, 6) AS layer FROM tp")
def _a25(s, d):
    return money(money(series.stacked(_dense(s, d)[0], ("root_key",)).select("root_key", "model", "i", "total", "layer"), "total"), "layer", places=6)


# Diffs, sources and groups.
_TURNS = "SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS old, text AS new FROM conversations"


def _lines_sql(c: str) -> str:
    arr = f"string_split(replace(coalesce({c}, ''), chr(13) || chr(10), chr(10)), chr(10))"
    return f"CASE WHEN {arr}[-1] = '' THEN {arr}[:-2] ELSE {arr} END"


_DIFF = f"WITH p AS ({_TURNS}), l AS (SELECT conv_id, turn, unnest({_lines_sql('new')}) AS line, 1 AS d FROM p UNION ALL SELECT conv_id, turn, unnest({_lines_sql('old')}) AS line, -1 AS d FROM p), n AS (SELECT conv_id, turn, line, sum(d) AS d FROM l GROUP BY conv_id, turn, line), s AS (SELECT conv_id, turn, sum(greatest(d, 0)) AS added, sum(greatest(-d, 0)) AS removed FROM n GROUP BY conv_id, turn) SELECT conv_id, turn, CAST(coalesce(added, 0) AS BIGINT) AS added, CAST(coalesce(removed, 0) AS BIGINT) AS removed FROM p LEFT JOIN s USING (conv_id, turn)"


def _turns(s: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy("turn")
    return s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.lag("text").over(w).alias("old"), F.col("text").alias("new"))


@query("x6_x7_line_diff", _DIFF, "")
def _x6(s, d):
    return diff.diff_lines(_turns(s, d), ["conv_id", "turn"], "old", "new")


@query("x6_line_diff_inline", _DIFF, "")
def _x6i(s, d):
    from ledgerlight.functions.lines import count_diff_lines

    a, r = count_diff_lines(F.col("old"), F.col("new"))
    return _turns(s, d).select("conv_id", "turn", a.alias("added"), r.alias("removed"))


def _as_lines(s: SparkSession, d: str) -> DataFrame:
    """The adapter's events written as JSONL lines, with lines that must be dropped."""
    # Lines cost more than events: they are made by all tasks, however few row groups the table has.
    e = ad.base(s, d).repartition("event_id")
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    usage = F.struct(F.col("input").alias("input_tokens"), F.col("output").alias("output_tokens"), F.col("cache_read").alias("cache_read_input_tokens"), F.col("cache_creation").alias("cache_creation_input_tokens"))
    # An edit of k % 17 new lines and k % 5 old ones.
    body = lambda c, n: F.array_join(F.transform(F.sequence(F.lit(1).cast("bigint"), F.greatest(n, F.lit(1))), lambda i: F.concat(F.lit(c), i.cast("string"))), "\n")
    text = lambda c, n: F.when(n > 0, body(c, n))
    edit = F.array(F.struct(F.lit("tool_use").alias("type"), F.lit("Edit").alias("name"), F.struct(text("o", F.col("deleted")).alias("old_string"), text("n", F.col("added")).alias("new_string")).alias("input")))
    said = F.to_json(F.struct(at.alias("timestamp"), F.lit("assistant").alias("type"), F.when(F.col("event_id") % 10 == 0, F.col("value") / 100).alias("costUSD"), F.struct("model", usage.alias("usage"), edit.alias("content")).alias("message")))
    patch = F.concat(F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("added") + 1), lambda i: F.lit("+x")), F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("deleted") + 1), lambda i: F.lit("-y")))
    exact = F.filter(patch, lambda x, i: (i != 0) & (i != F.col("added") + 1))
    used = F.to_json(F.struct(at.alias("timestamp"), F.lit("user").alias("type"), F.struct(F.array(F.struct(F.concat(F.array(F.lit(" c")), exact).alias("lines"))).alias("structuredPatch"), F.lit("old").alias("oldString")).alias("toolUseResult")))
    line = F.when(F.col("edit"), used).otherwise(said)
    # Fields that nobody declared may come twice.
    line = F.when(F.col("event_id") % 13 == 0, F.concat(F.lit('{"other":1,"other":{"type":1,"type":2},'), F.substring(line, 2, 1 << 30))).otherwise(line)
    good = e.select(line.alias("value"), "session_file", "event_id")
    bad = [
        "not json at all", "", "   ", "{}", "[]", '{"type":"assistant","message":{"model":"opus","usage":{"input_tokens":1}}}', '{"timestamp":"2024-01-01","type":"assistant","message":{"usage":{}}}',
        '{"timestamp":"2024-01-01T00:00:00","type":"assistant","message":{"usage":{}}}', '{"timestamp":"2024-01-01T00:00:00Z","type":"system","message":{"usage":{}}}', '{"timestamp":"2024-01-01T00:00:00Z","type":"assistant","message":{"model":"x"}}',
        '{"timestamp":"2024-01-01T00:00:00Z","type":"assistant","message":{"usage":{},"content":"text"}}', '{"timestamp":"2024-01-01T00:00:00Z","type":"assistant","message":{"usage":{"input_tokens":1.5}}}',
        '{"timestamp":"2024-01-01T00:00:00Z","type":"assistant","message":{"usage":{"input_tokens":-5}}}', '{"timestamp":"2024-01-01T00:00:00Z","type":"user","toolUseResult":"text"}', '{"timestamp":"2024-01-01T00:00:00Z","type":"user","toolUseResult":{"structuredPatch":[]}}',
        *[f'{{"timestamp":"2024-01-01T00:00:00Z","type":"assistant","message":{{"model":"opus","usage":{{"input_tokens":1}}}}}}{rest}' for rest in (" x", "]", "}", ",", ",{}", ' "end of line"', ',"end of line"', '],["x"', "{}")],
        '{"timestamp":"2024-01-01T00:00:00Z","type":"assistant","type":"assistant","message":{"usage":{"input_tokens":1}}}', '{"timestamp":"2024-01-01T00:00:00Z","type":"assistant","message":{"usage":{"input_tokens":1,"input_tokens":1}}}',
        '{"timestamp":"2024-01-01T00:00:00Z","type":"assistant","message":{"usage":{"input_tokens":1},"content":[{"type":"text"},{"type":"tool_use","input":{"old_string":"a","old_string":"a"}}]}}',
        '{"timestamp":"2024-01-01T00:00:00Z","type":"user","toolUseResult":{"structuredPatch":[{"lines":["+a"],"lines":["+a"]}]}}', "{'timestamp':'2024-01-01T00:00:00Z','type':'assistant','message':{'usage':{'input_tokens':1}}}",
    ]
    return good.unionByName(s.createDataFrame([(b, "s0.jsonl", None) for b in bad], "value string, session_file string, event_id long"))


@query("s6_s8_x1_x5_parse_lines", f" SELECT session_file, model, date_trunc('millisecond', ts) AS ts, {', '.join(f'CAST({m} AS BIGINT) AS {m}' for m in MEASURES if m != 'cost')}, round(cost, 9) AS cost FROM u WHERE NOT edit OR added + deleted > 0")
def _s8(s, d):
    return logs.parse(_as_lines(s, d)).select("session_file", "model", F.col("ts").cast("timestamp_ntz").alias("ts"), *[m for m in MEASURES if m != "cost"], F.round("cost", 9).alias("cost"))


@query("f11_s9_history_json_dates", f" SELECT root, cwd, date, CAST(sum(input) AS BIGINT) AS input, CAST(sum(added) AS BIGINT) AS added, round(sum(cost), 9) AS cost FROM j WHERE event_id % 7 <> 0 GROUP BY root, cwd, date")
def _f11(s, d):
    """A nested JSON history, some of its dates unreadable, written and imported."""
    from ledgerlight.sources.store import import_history_json

    t = F.when(F.col("event_id") % 7 == 0, "not-a-date").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    e = ad.base(s, d).join(ad.session_map(s), "session_file").groupBy("root", "cwd", t.alias("t")).agg(F.sum("input").alias("input"), F.sum("added").alias("lines_added"), F.sum("cost").alias("cost"))
    nest = lambda df, keys, k, v: df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col(k), v))).alias("m"))
    m = nest(e, ["root", "cwd"], "t", F.struct("input", "lines_added", "cost"))
    m = nest(nest(m, ["root"], "cwd", F.col("m")), [], "root", F.col("m"))
    at = f"{shared_dir(s)}/history-json-{uuid.uuid4().hex}"
    m.select(F.to_json("m").alias("value")).coalesce(1).write.text(at)
    return money(import_history_json(s, at).select("root", "cwd", "date", "input", "added", "cost"))


_SRC = " s0 AS (SELECT s_suppkey AS seq, 'd' || s_suppkey AS dir_name, '/home/u/logs/d' || s_suppkey AS path, ['f' || s_suppkey || '.jsonl', 'a' || s_suppkey || '.jsonl'] AS files, CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE '/home/u/w/n' || s_nationkey || '/' || repeat('x', CAST(s_suppkey % 3 AS INTEGER)) END AS cwd FROM supplier), ids AS (SELECT DISTINCT cwd, cwd AS root_path, CASE WHEN CAST(regexp_extract(cwd, 'n([0-9]+)', 1) AS INTEGER) % 4 = 0 THEN NULL ELSE 'git@h:n' || CAST(regexp_extract(cwd, 'n([0-9]+)', 1) AS INTEGER) % 7 END AS remote_url FROM s0 WHERE cwd IS NOT NULL)"


def _sources(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    b = s.read.parquet(f"{d}/supplier.parquet")
    k = F.col("s_suppkey")
    cwd = F.when(k % 11 == 0, F.lit(None)).otherwise(F.concat(F.lit("/home/u/w/n"), F.col("s_nationkey").cast("string"), F.lit("/"), F.expr("repeat('x', cast(s_suppkey % 3 as int))")))
    src = b.select(k.alias("seq"), F.concat(F.lit("d"), k).alias("dir_name"), F.concat(F.lit("/home/u/logs/d"), k).alias("path"), F.array(F.concat(F.lit("f"), k, F.lit(".jsonl")), F.concat(F.lit("a"), k, F.lit(".jsonl"))).alias("session_files"), cwd.alias("cwd"), F.lit("/home/u/logs").alias("source_root"))
    n = F.regexp_extract("cwd", "n([0-9]+)", 1).cast("int")
    ids = src.where("cwd IS NOT NULL").select("cwd").distinct().select("cwd", F.col("cwd").alias("root_path"), F.when(n % 4 == 0, F.lit(None)).otherwise(F.concat(F.lit("git@h:n"), (n % 7).cast("string"))).alias("remote_url"))
    return src, ids


_GROUPED = f"""{_SRC}, r AS (SELECT s0.*, coalesce(root_path, path) AS root_path, remote_url FROM s0 LEFT JOIN ids USING (cwd)),
 best AS (SELECT remote_url, first(root_path ORDER BY strlen(root_path), seq) AS canonical FROM r WHERE remote_url IS NOT NULL GROUP BY remote_url),
 k AS (SELECT r.*, coalesce(canonical, root_path) AS root_key FROM r LEFT JOIN best USING (remote_url)),
 m AS (SELECT root_key, coalesce('c' || cwd, 'n' || seq) AS one, any_value(cwd) AS cwd, list_sort(flatten(list(files))) AS files FROM k GROUP BY root_key, coalesce('c' || cwd, 'n' || seq))"""
_GNAME = "array_to_string(list_filter(string_split(replace(root_key, '/home/u', ''), '/'), lambda x: x <> '')[-2:], '/')"


@query("g1_a19_a24_x25_j7_groups", f"{_GROUPED} SELECT root_key, {_GNAME} AS name, CAST(sum(len(files)) AS BIGINT) AS sessions, count(*) AS n_sources, CAST(row_number() OVER (ORDER BY lower({_GNAME}), root_key) - 1 AS INTEGER) AS pos FROM m GROUP BY root_key", "")
def _g1(s, d):
    return grouping.group_by_identity(*_sources(s, d), home="/home/u").select("root_key", "name", "sessions", F.size("sources").cast("bigint").alias("n_sources"), "pos")


_SQL["g1_a19_a24_x25_j7_groups"] = "WITH" + _SQL["g1_a19_a24_x25_j7_groups"]


_ANC = "SELECT {of}, k, '/' || array_to_string(list_filter(string_split({of}, '/'), lambda x: x <> '')[:k], '/') AS path FROM (SELECT {of}, unnest(range(len(list_filter(string_split({of}, '/'), lambda x: x <> '')) + 1)) AS k FROM (SELECT DISTINCT {of} FROM {rows}))"


@query(
    "g2_g3_s13_identities",
    f"""WITH c AS (SELECT DISTINCT CASE WHEN s_nationkey % 7 = 6 THEN '/gone/n' || s_nationkey || '/worktrees/' ELSE '/home/u/w/n' || s_nationkey || '/' END || repeat('x', CAST(s_suppkey % 3 AS INTEGER)) AS cwd FROM supplier),
 n AS (SELECT n_nationkey AS k, '/home/u/w/n' || n_nationkey AS p FROM nation),
 dirs AS (SELECT unnest(['/', '/home', '/home/u', '/home/u/w']) AS path UNION SELECT p FROM n WHERE k % 5 <> 3 UNION SELECT p || '/x' FROM n WHERE k % 2 = 0 AND k % 5 <> 3),
 marks AS (SELECT p AS path, CASE WHEN k % 4 = 1 THEN '/home/u/w/n' || (k - 1) END AS leads_to FROM n WHERE k % 4 < 2 UNION ALL SELECT p || '/x', NULL FROM n WHERE k % 4 = 2),
 remotes AS (SELECT p AS root, 'git@h:n' || k AS url FROM n WHERE k % 4 = 0 UNION ALL SELECT p || '/x', 'git@h:x' || k FROM n WHERE k % 8 = 2),
 h AS (SELECT cwd, regexp_replace(cwd, '/$', '') AS here FROM c),
 nr AS (SELECT here, max_by(path, k) AS near FROM ({_ANC.format(of='here', rows='h')}) JOIN dirs USING (path) GROUP BY here),
 hn AS (SELECT h.*, near, near IS NULL OR (near <> here AND near = '/') AS lost FROM h LEFT JOIN nr USING (here)),
 ab AS (SELECT near, max_by(coalesce(leads_to, path), k) AS above FROM ({_ANC.format(of='near', rows='hn')}) JOIN marks USING (path) GROUP BY near),
 be AS (SELECT regexp_replace(path, '/[^/]*$', '') AS near, min(path) AS below FROM marks GROUP BY 1 HAVING count(*) = 1),
 r AS (SELECT cwd, lost, CASE WHEN NOT lost THEN coalesce(above, below) END AS root FROM hn LEFT JOIN ab USING (near) LEFT JOIN be USING (near))
 SELECT cwd, coalesce(root, CASE WHEN lost THEN regexp_replace(cwd, '/worktrees/.*$', '') ELSE cwd END) AS root_path, url AS remote_url FROM r LEFT JOIN remotes USING (root)""",
    "",
)
def _g2(s, d):
    """Directories of the suppliers' sources against facts about the nations' directories."""
    b, n = s.read.parquet(f"{d}/supplier.parquet"), s.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("k"))
    nation = F.col("s_nationkey").cast("string")
    top = F.when(F.col("s_nationkey") % 7 == 6, F.concat(F.lit("/gone/n"), nation, F.lit("/worktrees/"))).otherwise(F.concat(F.lit("/home/u/w/n"), nation, F.lit("/")))
    cwds = b.select(F.concat(top, F.expr("repeat('x', cast(s_suppkey % 3 as int))")).alias("cwd"))
    at = lambda k, rest="": F.concat(F.lit("/home/u/w/n"), k.cast("string"), F.lit(rest))
    k, none = F.col("k"), F.lit(None).cast("string")
    here = n.where("k % 5 <> 3")
    dirs = s.createDataFrame([("/",), ("/home",), ("/home/u",), ("/home/u/w",)], "path string").union(here.select(at(k))).union(here.where("k % 2 = 0").select(at(k, "/x")))
    marks = n.where("k % 4 < 2").select(at(k).alias("path"), F.when(k % 4 == 1, at(k - 1)).alias("leads_to")).union(n.where("k % 4 = 2").select(at(k, "/x"), none))
    remotes = n.where("k % 4 = 0").select(at(k).alias("path"), F.concat(F.lit("git@h:n"), k).alias("url")).union(n.where("k % 8 = 2").select(at(k, "/x"), F.concat(F.lit("git@h:x"), k)))
    return repositories.identities(cwds, dirs, marks, remotes)


@query("s2_d3_session_map", f"WITH{_SRC} SELECT unnest(files) AS session_file, '/home/u/logs' AS root, coalesce(cwd, path) AS cwd FROM s0", "")
def _d3(s, d):
    return grouping.session_map(_sources(s, d)[0])


@query("x26_x28_paths", " SELECT event_id, CASE WHEN k % 3 = 0 THEN '/home/u/repo' WHEN k % 3 = 1 THEN '/home/u/Repo' ELSE '/home/u/plain/x' END AS heuristic_root, '.r' || s AS display FROM u")
def _x26(s, d):
    k = F.col("k") % 3
    path = F.when(k == 0, "/home/u/repo/worktrees/a/b").when(k == 1, "/home/u/Repo/Worktrees/R/feat").otherwise("/home/u/plain/x")
    root = F.concat(F.lit("/home/u/.r"), F.col("s"), F.lit("/projects"))
    return ad.base(s, d).select("event_id", scalars.heuristic_root(path).alias("heuristic_root"), scalars.source_display(root, "/home/u").alias("display"))


@query("x14_duration_labels", " SELECT event_id, CASE WHEN minute >= 60 THEN (minute // 60) || 'h' || lpad(CAST(minute % 60 AS VARCHAR), 2, '0') || 'm' ELSE minute || 'm' END AS label FROM u")
def _x14(s, d):
    m = scalars.local_minute(F.col("ts"))
    return ad.base(s, d).select("event_id", fmt.format_duration(m).alias("label"))


@query("x12_version_newer", " SELECT event_id, (k % 3, k % 7, k % 5) > (k % 2, k % 6, k % 4) AS newer FROM u")
def _x12(s, d):
    k = F.col("k")
    v = lambda a, b, c: F.concat_ws(".", (k % a).cast("string"), (k % b).cast("string"), (k % c).cast("string"))
    return ad.base(s, d).select("event_id", fmt.version_newer(v(3, 7, 5), v(2, 6, 4)).alias("newer"))


@query("x31_labels", " SELECT event_id, strftime(ts, '%b') AS month, left(strftime(ts, '%a'), 2) AS weekday FROM u")
def _x31(s, d):
    return ad.base(s, d).select("event_id", fmt.month_abbrev(F.col("ts")).alias("month"), fmt.weekday_label(F.col("ts")).alias("weekday"))


_MK = "CASE WHEN units >= 1000000 THEN printf('%.1fM', units / 1e6) WHEN units >= 1000 THEN printf('{k}K', units / 1e3) ELSE CAST(units AS VARCHAR) END"


@query(
    "x11_x15_x17_number_labels",
    f" SELECT event_id, {_MK.format(k='%.1f')} AS tokens, {_MK.format(k='%.0f')} AS axis, '$' || CASE WHEN value >= 100 THEN printf('%.0f', value) WHEN value >= 10 THEN printf('%.1f', value) ELSE printf('%.2f', value) END AS cost,"
    " '$' || CASE WHEN value >= 100 THEN printf('%.0f', value) ELSE printf('%.2f', value) END AS kpi_cost FROM (SELECT event_id, units * (1 + event_id % 400) AS units, value FROM u)",
)
def _x11(s, d):
    """Labels of every magnitude; ties go to the even digit of the exact value."""
    e = ad.base(s, d).withColumn("units", F.col("units") * (1 + F.col("event_id") % 400))
    return e.select("event_id", fmt.format_tokens(F.col("units")).alias("tokens"), fmt.format_axis_tokens(F.col("units")).alias("axis"), fmt.format_cost(F.col("value")).alias("cost"), fmt.format_kpi_cost(F.col("value")).alias("kpi_cost"))


@query("u2_u4_distinct_dates", " SELECT DISTINCT date FROM j")
def _u2(s, d):
    day = _sums(s, d)
    return day.where("input IS NOT NULL").select("date").union(day.where("output IS NOT NULL").select("date")).distinct()


def _live(s: SparkSession, d: str):
    from ledgerlight.plans.dashboard import Dashboard

    return Dashboard(ad.usage_events(s, d), ad.session_map(s), ad.groups(s), ad.as_of(s, d), history=_history(s, d), overrides=None)


@query("d18_dashboard_kpis_with_history", f"{_MERGE}" + _KPI.format(daily=_daily_sql(source="merged")))
def _d18(s, d):
    return money(_live(s, d).kpis(), "total_cost")


# Orders, labels, streaming.
@query("x36_model_bar", _STATS + f", t AS ({_TOKENS}), sh AS (SELECT root_key, model, tokens / sum(tokens) OVER (PARTITION BY root_key)::DOUBLE AS share FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY root_key ORDER BY share DESC, model) AS k, count(*) OVER (PARTITION BY root_key) AS n FROM sh), w AS (SELECT *, CASE WHEN k < n THEN greatest(round(share * 40), 1) END AS w FROM r) SELECT root_key, model, CAST(coalesce(w, greatest(40 - coalesce(sum(w) OVER (PARTITION BY root_key), 0), 0)) AS INTEGER) AS width FROM w")
def _x36(s, d):
    return modelstats.bar_widths(modelstats.shares(_stats(s, d)["tokens"]), 40).select("root_key", "model", "width")


@query("x18_f9_window_dates", f" SELECT event_id FROM u WHERE {_FILTERS[TimeFilter.HOUR12]}")
def _x18(s, d):
    w = window(TimeFilter.HOUR12, ad.as_of(s, d))
    e = ad.base(s, d)
    return e.where(w.has_minute(scalars.local_date(F.col("ts")), scalars.local_minute(F.col("ts")))).select("event_id")


@query("x30_truncated_labels", "SELECT doc_id, CASE WHEN strlen(t) <= 16 THEN t ELSE left(t, list_max(list_filter(range(16), lambda k: strlen(left(t, k)) <= 15))) || '…' END AS label FROM (SELECT doc_id, split_part(text, ' ', 1) || split_part(text, ' ', 2) || split_part(text, ' ', 3) AS t FROM documents)", "")
def _x30(s, d):
    """The first words of texts in several scripts' letters, cut by bytes."""
    t = F.concat(*[F.split_part("text", F.lit(" "), F.lit(i)) for i in (1, 2, 3)])
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", fmt.truncate_label(t, 16).alias("label"))


@query("x29_source_labels", f"{_GROUPED} SELECT seq, CASE WHEN cwd IS NULL THEN dir_name WHEN starts_with(cwd, root_key || '/') THEN './' || substr(cwd, length(root_key) + 2) ELSE cwd END AS label FROM (SELECT seq, dir_name, cwd, regexp_replace(root_key, '/$', '') AS root_key FROM k)", "")
def _x29(s, d):
    g = grouping.group_by_identity(*_sources(s, d), home="/home/u").select(F.regexp_replace("root_key", "/$", "").alias("root_key"), F.explode("sources").alias("x"))
    every = _sources(s, d)[0].select("seq", "dir_name", "cwd", "path")
    # Sources of one cwd are one source of the group; each directory has its own label.
    of = g.select("root_key", F.col("x.cwd").alias("c"), F.col("x.path").alias("p"))
    j = every.join(of, every["cwd"].eqNullSafe(of["c"]) & (every["cwd"].isNotNull() | (every["path"] == of["p"])))
    return j.select("seq", scalars.source_label(F.col("cwd"), F.col("root_key"), F.col("dir_name")).alias("label"))


_SQL["x29_source_labels"] = "WITH" + _SQL["x29_source_labels"]


# Overrides of the detected groups, through the settings' own methods.
_CWD = "/home/u/w/n{}/{}"


def _settings() -> overrides.Overrides:
    o = overrides.Overrides()
    cwds = lambda keep: [_CWD.format(n, "x" * x) for n in range(25) if keep(n) for x in range(3)]
    for c in cwds(lambda n: n % 5 == 1):
        if c.endswith("/x"):
            o.extract_source(c)
    for n in (4, 8, 12):  # directories of these nations have no remote, each is a group
        keys = cwds(lambda m, n=n: m == n)
        o.add_merge(keys[2], keys[1])
        o.add_merge(keys[0], keys[2])
    o.toggle_star(_CWD.format(4, "x"))
    o.toggle_hidden(_CWD.format(8, "xx"))
    for x in ("", "x", "xx"):
        o.toggle_hidden(_CWD.format(12, x))
        o.toggle_hidden(_CWD.format(16, x))
    o.toggle_star(_CWD.format(16, "x"))
    o.rename(_CWD.format(4, "xx"), "Four")
    o.rename(_CWD.format(16, ""), "Sixteen")
    o.rename(_CWD.format(8, ""), "Eight")
    o.rename(_CWD.format(8, ""), "")
    for c in cwds(lambda n: n in (20, 0) or n in (2, 5, 9, 16, 19, 23)):
        o.add_split(c)
    o.remove(_CWD.format(2, "x"))
    o.add_merge(_CWD.format(24, ""), _CWD.format(24, "x"))
    o.add_split(_CWD.format(24, "x"))  # leaves its set, which is one key and goes
    return o


def _overrides_sql() -> str:
    text = lambda keys: "[" + ", ".join(f"'{k}'" for k in sorted(keys)) + "]"
    all_of = lambda ns: [_CWD.format(n, "x" * x) for n in ns for x in range(3)]
    splits = set(all_of([n for n in range(25) if n in (20, 0, 2, 5, 9, 16, 19, 23)])) - {_CWD.format(2, "x")} | {_CWD.format(24, "x")}
    extracts = {_CWD.format(n, "x") for n in range(25) if n % 5 == 1}
    sets = {n: all_of([n]) for n in (4, 8, 12)}
    merge = " ".join(f"WHEN key IN {text(k).replace('[', '(').replace(']', ')')} THEN {n}" for n, k in sets.items())
    stars = {_CWD.format(4, "x"), _CWD.format(16, "x")}
    hidden = {_CWD.format(8, "xx"), *all_of([12]), _CWD.format(16, ""), _CWD.format(16, "xx")}
    names = f"MAP {{'{_CWD.format(4, 'xx')}': 'Four', '{_CWD.format(16, '')}': 'Sixteen'}}"
    return f"""{_GROUPED},
 p AS (SELECT root_key, one, cwd, files, coalesce(list_contains({text(extracts)}, cwd), false) AS ex FROM m),
 q AS (SELECT *, count(*) FILTER (NOT ex) OVER (PARTITION BY root_key) AS rest FROM p),
 l AS (SELECT *, ex OR (list_contains({text(splits)}, root_key) AND rest > 1) AS loose FROM q),
 gs AS (SELECT CASE WHEN loose THEN cwd ELSE root_key END AS key, loose, sum(len(files)) AS sessions, count(*) AS n_sources FROM l GROUP BY root_key, loose, CASE WHEN loose THEN one END, CASE WHEN loose THEN cwd ELSE root_key END),
 ms AS (SELECT *, CASE {merge} END AS ms FROM gs),
 cn AS (SELECT *, count(*) OVER (PARTITION BY ms) AS members, row_number() OVER () AS own FROM ms),
 f AS (SELECT first(key ORDER BY strlen(key)) AS root_key, CASE WHEN any_value(ms) IS NOT NULL AND any_value(members) > 1 THEN 'merged' WHEN any_value(loose) THEN 'split' END AS origin,
   CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(n_sources) AS BIGINT) AS n_sources, max({names}[key]) AS given, bool_or(list_contains({text(stars)}, key)) AS starred, bool_and(list_contains({text(hidden)}, key)) AS hidden
   FROM cn GROUP BY CASE WHEN ms IS NOT NULL AND members > 1 THEN -ms ELSE own END)
 SELECT root_key, coalesce(given, {_GNAME}) AS name, origin, sessions, n_sources, starred, hidden FROM f"""


@query("g4_g8_overrides", "WITH" + _overrides_sql(), "")
def _g4(s, d):
    g = overrides.regrouped(grouping.group_by_identity(*_sources(s, d), home="/home/u"), _settings(), "/home/u")
    return g.select("root_key", "name", "origin", "sessions", F.size("sources").cast("bigint").alias("n_sources"), "starred", "hidden")


# Groups, orders and roots of the sources that ``supplier`` gives.
_KEYS_OF = f"{_GROUPED}, gk AS (SELECT root_key, {_GNAME} AS name FROM (SELECT DISTINCT root_key FROM m))"


def _supplied(s: SparkSession, d: str) -> DataFrame:
    return grouping.group_by_identity(*_sources(s, d), home="/home/u")


@query("f15_name_search", f"WITH{_KEYS_OF} SELECT root_key, name FROM gk WHERE contains(lower(name), lower('N1'))", "")
def _f15(s, d):
    return grouping.search(_supplied(s, d), "N1").select("root_key", "name")


@query("o4_f12_group_order", f"WITH{_KEYS_OF} SELECT root_key, CAST(row_number() OVER (ORDER BY root_key IN ('/home/u/w/n4/x', '/home/u/logs/d22'), root_key IN ('/home/u/w/n8/', '/home/u/w/n4/') DESC, lower(CASE WHEN root_key = '/home/u/w/n12/x' THEN 'Aa' ELSE name END)) AS INTEGER) AS place FROM gk", "")
def _o4(s, d):
    o = overrides.Overrides(stars={_CWD.format(8, ""), _CWD.format(4, "")}, hidden={_CWD.format(4, "x"), "/home/u/logs/d22"}, renames={_CWD.format(12, "x"): "Aa"})
    return overrides.with_place(_supplied(s, d), o).select("root_key", "place")


_ROOTED = f"{_SRC}, sr AS (SELECT s0.*, '/home/u/.r' || (s_nationkey % 5) || '/projects' AS root FROM s0 JOIN supplier ON s_suppkey = seq)"


def _rooted_map(s: SparkSession, d: str) -> DataFrame:
    """The session map of the supplier's sources under five log roots."""
    nation = s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("seq"), F.concat(F.lit("/home/u/.r"), (F.col("s_nationkey") % 5).cast("string"), F.lit("/projects")).alias("source_root"))
    return grouping.session_map(_sources(s, d)[0].drop("source_root").join(nation, "seq"))


@query("d4_u1_root_map", f"WITH{_ROOTED} SELECT DISTINCT root, coalesce(cwd, path) AS cwd FROM sr", "")
def _d4(s, d):
    return rollup.root_map(_rooted_map(s, d)).select("root", F.explode("cwds").alias("cwd"))


@query("o6_x28_roots", f"WITH{_ROOTED} SELECT root, replace(regexp_replace(root, '/projects$', ''), '/home/u/', '') AS label, CAST(row_number() OVER (ORDER BY root) AS INTEGER) AS place FROM (SELECT DISTINCT root FROM sr)", "")
def _o6(s, d):
    from ledgerlight.plans.dashboard import Dashboard

    b = Dashboard(ad.usage_events(s, d), _rooted_map(s, d), _supplied(s, d), ad.as_of(s, d))
    return b.roots().select("root", scalars.source_display(F.col("root"), "/home/u").alias("label"), F.row_number().over(W.orderBy(F.monotonically_increasing_id())).alias("place"))


@query("f18_cwds_without_group", (_STATS + _TOKENS).replace("unnest(cwds) AS cwd FROM g)", "unnest(cwds) AS cwd FROM g WHERE root_key NOT IN ('/home/u/code/p5', '/home/u/code/shared', '/home/u/code/p1'))"))
def _f18(s, d):
    """Events of projects that no group holds are in no model's figures."""
    some = ad.groups(s).where(~F.col("root_key").isin("/home/u/code/p5", "/home/u/code/shared", "/home/u/code/p1"))
    return modelstats.model_stats(_index(s, d), modelstats.cwd_bridge(some), window(TimeFilter.ALL, ad.as_of(s, d)))["tokens"]


# Log files: roots, directories, the first lines' cwd, file names, and the events in them.
_HOMES = (".config/claude", ".claude", ".x-claude")


@query(
    "s1_s7_o8_u1_discovery",
    " SELECT root, dir_name, cwd, n_files, n_events, units FROM (SELECT CASE s // 12 " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(_HOMES)) + " END AS root, 'p' || (s % 6) AS dir_name,"
    " CASE WHEN s % 2 = 1 THEN '/home/u/code/p' || (s % 6) END AS cwd, count(DISTINCT s) AS n_files, count(*) FILTER (NOT edit OR added + deleted > 0) AS n_events, CAST(sum(input) AS BIGINT) AS units FROM u GROUP BY ALL)",
)
def _s1(s, d):
    """The adapter's lines written as log files, found again and read, all by Spark.

    Two files a directory, one of them deeper; the cwd stands in the first lines of odd
    sessions and behind the lines that are looked at in even ones.
    """
    home = f"{shared_dir(s)}/home-{uuid.uuid4().hex}"
    _write_logs(s, d, home)
    files = logs.log_files(s, home)
    events = logs.parse(logs.read_lines(s, f"{home}/{logs.ROOTS}"))
    e = events.join(logs.session_map_of_files(files), "session_file").groupBy("root", F.col("cwd").alias("place")).agg(F.count("*").alias("n_events"), F.sum("input").alias("units"))
    places = logs.directory_cwds(files).select(F.col("source_root").alias("root"), scalars.effective_root(F.col("cwd"), F.col("path")).alias("place"), "dir_name", "cwd", "n_files")
    return places.join(e, ["root", "place"]).select(scalars.source_display(F.col("root"), home.split(":", 1)[-1].replace("///", "/")).alias("root"), "dir_name", "cwd", "n_files", "n_events", "units")


def _write_logs(s: SparkSession, d: str, home: str, more: DataFrame | None = None) -> None:
    """One log file a session below ``home``: Spark writes the lines; the files, as many as the adapter has sessions, get their names."""
    k = F.regexp_extract("session_file", "[0-9]+", 0).cast("int")
    lines = _as_lines(s, d).withColumn("value", F.translate("value", "\n", " "))
    lines = (lines if more is None else lines.unionByName(more)).select("session_file", "value", (F.coalesce("event_id", F.lit(0)) + logs.HEAD_LINES + 1).alias("at"))
    names = lines.select("session_file").distinct()
    user = F.concat(F.lit('{"type":"user","cwd":"/home/u/code/p'), (k % 6).cast("string"), F.lit('"}'))
    before = F.explode(F.sequence(F.when(k % 2 == 1, logs.HEAD_LINES).otherwise(0), F.lit(logs.HEAD_LINES)))
    heads = names.select("session_file", user.alias("user"), before.alias("at")).select("session_file", F.when(F.col("at") == logs.HEAD_LINES, F.col("user")).otherwise("{}").alias("value"), F.col("at").cast("bigint").alias("at"))
    written = f"{home}-written"
    lines.unionByName(heads).repartition("session_file").sortWithinPartitions("session_file", "at", "value").select("session_file", "value").write.partitionBy("session_file").text(written)
    path = s._jvm.org.apache.hadoop.fs.Path
    fs = path(written).getFileSystem(s._jsc.hadoopConfiguration())
    fs.mkdirs(path(f"{home}/.claude-less"))
    for n in range(ad.SESSIONS):
        for part in fs.globStatus(path(f"{written}/session_file=s{n}.jsonl/part-*")) or []:
            folder = f"{home}/{_HOMES[n // 12]}/projects/p{n % 6}{'/deep' if n % 12 > 5 else ''}"
            fs.mkdirs(path(folder))
            fs.rename(part.getPath(), path(f"{folder}/s{n}.jsonl"))


_CUT = "(SELECT CAST(quantile_disc(event_id, 0.5) AS BIGINT) FROM u WHERE s = 5)"


@query(
    "s6_s7_tolerant_scan",
    f" SELECT session_file, reason, CAST(count(*) FILTER (ok AND (NOT edit OR added + deleted > 0)) AS BIGINT) AS n_events, CAST(coalesce(sum(input) FILTER (ok), 0) AS BIGINT) AS units FROM (SELECT *, CASE s WHEN 5 THEN 'invalid' WHEN 7 THEN 'unread' END AS reason, s <> 7 AND NOT (s = 5 AND event_id > {_CUT}) AS ok FROM u) GROUP BY ALL",
)
def _s6(s, d):
    """Log files of which one holds bytes that are no text half-way, one vanishes once it is listed, and one ends in mid-line."""
    home = f"{shared_dir(s)}/home-{uuid.uuid4().hex}"
    of = ad.base(s, d).where("s = 5").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY event_id)").cast("bigint").alias("event_id"))
    # The bad line stands behind the event of that number: ties of the order go by the text.
    invalid = of.select(F.concat(F.lit("~"), F.unhex(F.lit("C3FF")).cast("string")).alias("value"), F.lit("s5.jsonl").alias("session_file"), "event_id")
    ends = s.createDataFrame([('{"timestamp":"2024-01-01T00:00:00Z","type":"assist', "s9.jsonl", 1 << 60)], "value string, session_file string, event_id long")
    _write_logs(s, d, home, invalid.unionByName(ends))
    at = f"{home}/{logs.ROOTS}"
    scheme = F.lit("file:" if home.startswith(("file:", "/")) else "")
    logs.log_files(s, home).select(F.concat(scheme, F.col("file")).alias("file")).write.parquet(f"{home}-listed")
    listed = s.read.parquet(f"{home}-listed")
    lines, missed = logs.tolerant_lines(s, at), logs.left_out(s, at, listed)
    path = s._jvm.org.apache.hadoop.fs.Path
    gone = path(f"{home}/{_HOMES[0]}/projects/p1/deep/s7.jsonl")
    gone.getFileSystem(s._jsc.hadoopConfiguration()).delete(gone, False)
    name = F.element_at(F.split("file", "/"), -1).alias("session_file")
    e = logs.parse(lines).groupBy("session_file").agg(F.count("*").alias("n_events"), F.sum("input").alias("units"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return listed.select(name).join(e, "session_file", "left").join(missed.select(name, "reason"), "session_file", "left").select("session_file", "reason", zero("n_events"), zero("units"))


@query("t1_t3_streaming_ingest", f"{_DAY} SELECT root, cwd, date, {_sum(MEASURES)}, any_value(active_minutes) AS active_minutes FROM day JOIN act USING (root, cwd, date) GROUP BY root, cwd, date")
def _t1(s, d):
    """The events as a stream of several batches; the history it leaves is the day rollup."""
    from ledgerlight.sources.store import load_history
    from ledgerlight.streaming.ingest import ingest

    at = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    ad.usage_events(s, d).withColumn("ts", F.col("ts").cast("timestamp")).repartition(3).write.parquet(f"{at}/in")
    stream = s.readStream.schema(EVENT).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
    ingest(stream, ad.session_map(s), f"{at}/store", f"{at}/checkpoint").awaitTermination()
    return money(load_history(s, f"{at}/store/history"))


def _event_files(s: SparkSession, e: DataFrame, at: str) -> DataFrame:
    """Events written to some files and read as a stream, one file a batch."""
    e.withColumn("ts", F.col("ts").cast("timestamp")).repartition(3).write.parquet(f"{at}/in")
    return s.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")


@query("t2_j1_live_session_map", f"{_DAY} SELECT root, cwd, date, {_sum(MEASURES)}, any_value(active_minutes) AS active_minutes FROM day JOIN act USING (root, cwd, date) GROUP BY root, cwd, date")
def _t2(s, d):
    """Events of all sessions come in three batches; the second run of the stream first hears of half the sessions."""
    from ledgerlight.streaming import live

    at = f"{shared_dir(s)}/live-{uuid.uuid4().hex}"
    events = _event_files(s, ad.usage_events(s, d), at)
    known, own = ad.session_map(s), F.regexp_extract("session_file", "[0-9]+", 0).cast("int") % 2
    before = s.conf.get(live.PROVIDER, None)
    s.conf.set(live.PROVIDER, live.ROCKSDB)
    try:
        for half in (0, 1):
            known.where(own == half).coalesce(1).write.mode("append").parquet(f"{at}/sessions")
            sessions = s.readStream.schema(known.schema).parquet(f"{at}/sessions")
            live.ingest_live(events, sessions, f"{at}/store", f"{at}/checkpoint").awaitTermination()
    finally:
        if before is None:
            s.conf.unset(live.PROVIDER)
        else:
            s.conf.set(live.PROVIDER, before)
    return money(live.live_days(s, f"{at}/store"))


@query("t5_w1_stream_activity", _W1.format(session="session_file", minute=_SQUEEZE, rows="j") + " SELECT * FROM act")
def _t5(s, d):
    """Minute bitmaps out of a stateful stream in three batches; the clusters are those of all events."""
    from ledgerlight.streaming import live

    at = f"{shared_dir(s)}/activity-{uuid.uuid4().hex}"
    days = ad.compressed_events(s, d).agg(F.datediff(F.max("ts"), F.min("ts"))).first()[0] + 2  # files follow no order of time
    stream = _event_files(s, ad.compressed_events(s, d), at).join(ad.session_map(s), "session_file")
    sink = lambda df, n: df.write.mode("overwrite").parquet(f"{at}/bits/batch={n}")
    out = live.activity_stream(stream, f"{days} days").writeStream.outputMode("update").foreachBatch(sink)
    out.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return bitmaps.active_minutes(bitmaps.merged(s.read.schema(f"{live.BITS}, batch int").parquet(f"{at}/bits")))


# Labels: one chart for each user.
_CHARTS = """, ch AS (SELECT user_id, CAST(min(ts) AS DATE) AS first, CAST(max(ts) AS DATE) AS last, max(hour(ts) * 60 + minute(ts)) AS top, max(ts) AS at_ FROM events GROUP BY user_id)"""


def _charts(s: SparkSession, d: str) -> DataFrame:
    minute = (F.hour("ts") * 60 + F.minute("ts")).cast("int")
    day = F.to_date("ts")
    return ad.base(s, d).groupBy("user_id").agg(F.min(day).alias("first"), F.max(day).alias("last"), F.max(minute).alias("top"), F.max("ts").alias("at_"))


def _placed_sql(gap: int) -> str:
    """Of cd (user_id, i, col, label), in the order of i, what leaves ``gap`` columns to the last one kept: row after row."""
    return f""", rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i) AS rn FROM cd),
 fo AS (SELECT user_id, rn, i, col, label, true AS kept, col + length(label) AS e FROM rk WHERE rn = 1
   UNION ALL SELECT rk.user_id, rk.rn, rk.i, rk.col, rk.label, rk.col >= fo.e + {gap}, CASE WHEN rk.col >= fo.e + {gap} THEN rk.col + length(rk.label) ELSE fo.e END
   FROM fo JOIN rk ON rk.user_id = fo.user_id AND rk.rn = fo.rn + 1)"""


_AXIS = 60


@query("b14_date_axis", _CHARTS + f""", c AS (SELECT *, last - first + 1 AS n, least({_AXIS // 8}, last - first + 1) AS k FROM ch),
 x AS (SELECT user_id, first, n, k, CAST(unnest(range(k)) AS INTEGER) AS i FROM c), y AS (SELECT *, CASE WHEN k <= 1 THEN 0 ELSE i * (n - 1) // (k - 1) END AS p FROM x)
 SELECT user_id, i, CAST(least(floor((p + 0.5::DOUBLE) * ({_AXIS}::DOUBLE / n)), {_AXIS - 6}) AS INTEGER) AS col, strftime(first + CAST(p AS INTEGER), '%b %d') AS label FROM y""")
def _b14_dates(s, d):
    return labels.date_axis(_charts(s, d), _AXIS, ("user_id",))


def _time_sql(bucket: int, n: int, total: int, width: int) -> str:
    at = lambda p, size: f"CAST(least(floor(({p} + 0.5::DOUBLE) * ({width}::DOUBLE / {n})), {width} - {size}) AS INTEGER)"
    if bucket < 30:
        k = min(max(width // 6, 1), n)
        return _CHARTS + f""", x AS (SELECT user_id, greatest(top - {total}, 0) AS s, CAST(i AS INTEGER) AS i, i * {n - 1} // {max(k - 1, 1)} AS p FROM ch, range({k}) r(i)),
 y AS (SELECT *, s + p * {bucket} AS m FROM x) SELECT user_id, i, {at('p', 5)} AS col, printf('%02d:%02d', m // 60, m % 60) AS label FROM y"""
    return _CHARTS + f""", x AS (SELECT user_id, greatest(top - {total}, 0) + i * {bucket} AS m, CAST(i AS INTEGER) AS i FROM ch, range({n}) r(i)),
 y AS (SELECT *, CAST(m // 60 AS VARCHAR) AS label FROM x WHERE m % 60 < 30), cd AS (SELECT user_id, i, {at('i', 'length(label)')} AS col, label FROM y)""" + _placed_sql(labels.HOUR_GAP) + " SELECT user_id, i, col, label FROM fo WHERE kept"


for _f, _name, _w in ((TimeFilter.TODAY, "today", 31), (TimeFilter.HOUR12, "hour12", 40), (TimeFilter.HOUR1, "hour1", 50)):
    _g = series.GRANULARITY[_f]
    query(f"b14_time_axis_{_name}", _time_sql(_g.bucket, _g.total // _g.bucket, _g.total, _w), "RECURSIVE " + ad.SQL)(
        lambda s, d, g=_g, w=_w: labels.time_axis(_charts(s, d).withColumn("start", F.greatest(F.col("top") - g.total, F.lit(0))), g.bucket, g.total // g.bucket, w, ("user_id",))
    )


@query("b15_month_labels", _CHARTS + """, st AS (SELECT user_id, first - CAST(dayofweek(first) AS INTEGER) AS s, last FROM ch), x AS (SELECT user_id, s + CAST(i AS INTEGER) * 7 AS w, CAST(i AS INTEGER) AS i FROM st, range(60) r(i) WHERE i <= (last - s) // 7),
 cd AS (SELECT user_id, i, 3 + i AS col, strftime(w, '%b') AS label FROM x WHERE i = 0 OR month(w) <> month(w - 7))""" + _placed_sql(1) + " SELECT user_id, i, col, left(label, 20 - col) AS label FROM fo WHERE kept AND col < 20", "RECURSIVE " + ad.SQL)
def _b15_months(s, d):
    c = _charts(s, d).withColumn("start", F.expr("date_sub(first, dayofweek(first) - 1)"))
    return labels.months(c.withColumn("weeks", F.expr("datediff(last, start) div 7 + 1")), 3, 1, ("user_id",), 20)


_COLUMNS = {"today": (heatmap.TODAY, "i"), "hours12": (heatmap.HOURS12, "(hour(at_ - INTERVAL 11 HOUR) + i) % 24"), "hour1": (heatmap.HOUR1, "i")}
for _name, (_mode, _label) in _COLUMNS.items():
    _sql = _CHARTS + f", cd AS (SELECT user_id, CAST(i AS INTEGER) AS i, CAST(4 + i * 2 AS INTEGER) AS col, CAST({_label} AS VARCHAR) AS label FROM ch, range({_mode.columns}) r(i))" + _placed_sql(1)
    query(f"b15_columns_{_name}", _sql + " SELECT user_id, i, col, left(label, 30 - col) AS label FROM fo WHERE kept AND col < 30", "RECURSIVE " + ad.SQL)(
        lambda s, d, m=_mode: labels.columns(_charts(s, d).withColumn("start", F.expr("at_ - INTERVAL 11 HOURS")), m, 4, 2, ("user_id",), 30)
    )
