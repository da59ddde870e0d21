"""Parsing, rollups, windows, groups: expectations worked out by hand."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from ledgerlight.functions import fmt, scalars
from ledgerlight.functions.lines import count_diff_lines, text_lines
from ledgerlight.functions.timewin import TimeFilter, display_range, window
from ledgerlight.operators import activity, cards, grouping, heatmap, history, kpi, rollup, series
from ledgerlight.operators.overrides import Overrides, apply_overrides, listed_order
from ledgerlight.schema import DAY, EVENT, MEASURES
from ledgerlight.sources import logs, store

T0 = "2026-03-01T10:00:00Z"


def parsed(spark, *lines):
    rows = [(x if isinstance(x, str) else json.dumps(x), "f.jsonl") for x in lines]
    return [r.asDict() for r in logs.parse(spark.createDataFrame(rows, "value string, session_file string")).collect()]


def said(usage=None, **kw):
    extra = {k: kw.pop(k) for k in list(kw) if k in ("costUSD", "timestamp", "sessionId", "uuid", "parentUuid")}
    return {"timestamp": T0, "type": "assistant", "message": {"model": "claude-opus-4-6", "usage": usage, **kw}} | extra


def user(**result):
    return {"timestamp": T0, "type": "user", "toolUseResult": result}


def test_assistant_lines(spark):
    (a,) = parsed(spark, said({"input_tokens": 1000, "output_tokens": 200, "cache_read_input_tokens": 500, "cache_creation_input_tokens": 300}))
    assert (a["input"], a["output"], a["cache_read"], a["cache_creation"]) == (1000, 200, 500, 300)
    assert a["cost"] == pytest.approx(0.00775) and a["suggested"] == a["accepted"] == 0 and a["ts"] == datetime(2026, 3, 1, 10)
    (b,) = parsed(spark, said({"input_tokens": 1, "output_tokens": 2}, costUSD=1.23))
    assert b["cost"] == 1.23 and b["cache_read"] == 0
    (c,) = parsed(spark, said({"input_tokens": 1_000_000}, costUSD=0, sessionId="x", uuid="y", parentUuid=None))
    assert c["cost"] == pytest.approx(5.0)
    (d,) = parsed(spark, said({"input_tokens": 10, "cache_read_input_tokens": 1_000_000}, model="unheard-of"))
    assert d["cost"] == pytest.approx(0.3)
    (e,) = parsed(spark, said({"input_tokens": 1_000_000}, model="x-opus-4-20250514"))
    assert e["cost"] == pytest.approx(15.0)


def test_dropped_lines(spark):
    bad = ["not json at all", "", "  ", "{}", "[]", said(None), said({"input_tokens": 1}, timestamp="2026-03-01"), said({"input_tokens": 1}, timestamp="2026-03-01T10:00:00"), said({"input_tokens": 1}, timestamp=None)]
    bad += [said({"input_tokens": 1}, content="text"), said({"input_tokens": 1.5}), said({"input_tokens": -1}), said({"input_tokens": "1x"}), {"timestamp": T0, "type": "system"}]
    bad += [{"timestamp": T0, "type": "user", "cwd": "/x"}, {"timestamp": T0, "type": "user", "toolUseResult": "text"}, user(structuredPatch=[]), user(structuredPatch=[{"lines": [" same"]}])]
    # A new file written with an empty patch gives no event either.
    assert parsed(spark, *bad, user(structuredPatch=[], content="a\nb", originalFile=None)) == []


def test_patches_writes_and_edits(spark):
    (a,) = parsed(spark, user(structuredPatch=[{"lines": ["+added1", "+added2", "-removed1", " context"]}, {"lines": None}], oldString="x"))
    assert (a["suggested"], a["accepted"], a["added"], a["deleted"], a["input"], a["model"]) == (0, 3, 2, 1, 0, "")
    (b,) = parsed(spark, user(structuredPatch=[{"lines": ["+c", "-b"]}], originalFile="a\nb\n", content="a\nc\n"))
    assert (b["suggested"], b["accepted"], b["added"], b["deleted"]) == (2, 2, 1, 1)
    edit = lambda **i: {"type": "tool_use", "name": "Edit", "input": i}
    (c,) = parsed(spark, said({}, content=[edit(old_string="x\nx", new_string="x"), edit(new_string="p\nq"), {"type": "tool_use", "name": "Write", "input": {"new_string": "w"}}, {"type": "text"}, edit()]))
    assert (c["suggested"], c["added"], c["deleted"]) == (3, 2, 1)
    (d,) = parsed(spark, said({"input_tokens": 1}, timestamp="2026-03-01t12:30:00.5+02:00"))
    assert d["ts"] == datetime(2026, 3, 1, 10, 30, 0, 500000)


@pytest.mark.parametrize(("old", "new", "want"), [("x\nx", "x", (0, 1)), ("", "a\nb\n", (2, 0)), (None, "a", (1, 0)), ("a\r\nb", "a\nb", (0, 0)), ("a", "a\n", (0, 0)), ("a\n\n", "a", (0, 1)), ("a\nb\na", "a\na\na", (1, 1)), (None, None, (0, 0))])
def test_line_difference(spark, old, new, want):
    df = spark.createDataFrame([(old, new)], "o string, n string")
    assert tuple(df.select(*count_diff_lines(F.col("o"), F.col("n"))).first()) == want


def test_text_lines(spark):
    df = spark.createDataFrame([("",), (None,), ("a\n",), ("a\r\nb\n\n",), ("\n",)], "t string")
    assert [r[0] for r in df.select(text_lines(F.col("t"))).collect()] == [[], [], ["a"], ["a", "b", ""], [""]]


def events(spark, *rows):
    """(ts, session, input[, output, cost])"""
    full = []
    for ts, session, tin, *rest in rows:
        tout, cost = (*rest, 0, 0.0)[:2] if len(rest) < 2 else rest[:2]
        full.append((datetime.fromisoformat(ts), "sonnet", tin, tout, 0, 0, float(cost), 0, 0, 0, 0, session))
    return spark.createDataFrame(full, EVENT)


@pytest.fixture(scope="module")
def sessions(spark):
    return spark.createDataFrame([("a.jsonl", "r1", "/p"), ("b.jsonl", "r1", "/p"), ("c.jsonl", "r2", "/p")], "session_file string, root string, cwd string")


def test_rollup_and_activity(spark, sessions):
    e = events(spark, ("2026-01-01T00:00:10", "a.jsonl", 1), ("2026-01-01T00:03:00", "b.jsonl", 2), ("2026-01-01T09:00:00", "c.jsonl", 5), ("2026-01-01T09:05:00", "c.jsonl", 5), ("2026-01-01T09:11:00", "c.jsonl", 5), ("2026-01-01T09:00:00", "zz.jsonl", 99))
    day = {r.root: r for r in rollup.day_rollup(e, sessions).collect()}
    assert day["r1"].input == 3 and day["r1"].active_minutes == 2  # two sessions, one minute each
    assert day["r2"].input == 15 and day["r2"].active_minutes == 7  # 9:00-9:05 and 9:11
    pooled = {r.root: r.active_minutes for r in activity.pooled_active_minutes(rollup.attach(e, sessions)).collect()}
    assert pooled == {"r1": 4, "r2": 7}
    assert {r.root: r.active_minutes for r in activity.session_window_minutes(rollup.attach(e, sessions)).collect()} == pooled
    assert rollup.daily(rollup.day_rollup(e, sessions)).first().input == 18
    only = rollup.daily(rollup.day_rollup(e, sessions), "r2", ["/p"]).first()
    assert only.input == 15 and only.added is None  # a line count of zero is absent
    assert rollup.minutes(rollup.minute_rollup(e, sessions)).where("minute = 0").first().added == 0
    assert {r.root: r.cwds for r in rollup.root_map(sessions).collect()} == {"r1": ["/p"], "r2": ["/p"]}


def day(root="r", cwd="/p", d="2026-01-01", **v):
    return (root, cwd, date.fromisoformat(d), *[float(v.get(m, 0)) if m == "cost" else v.get(m, 0) for m in MEASURES], v.get("active_minutes", 0))


def test_history_takes_the_larger_value(spark):
    old = spark.createDataFrame([day(input=100, output=50, suggested=10, accepted=8, added=5, deleted=3), day(d="2025-12-31", input=7)], DAY)
    new = spark.createDataFrame([day(input=80, output=60, suggested=12, accepted=7, added=4, deleted=5), day(cwd="/q", input=1)], DAY)
    m = {(r.cwd, str(r.date)): r for r in history.merge(old, new).collect()}
    x = m["/p", "2026-01-01"]
    assert (x.input, x.output, x.suggested, x.accepted, x.added, x.deleted) == (100, 60, 12, 8, 5, 5)
    assert m["/p", "2025-12-31"].input == 7 and m["/q", "2026-01-01"].input == 1
    assert sorted(map(tuple, history.merge(history.merge(old, new), new).collect())) == sorted(map(tuple, history.merge(old, new).collect()))


def test_history_store(spark, tmp_path):
    path = f"file://{tmp_path}/h"
    assert store.load_history(spark, path).count() == 0
    store.update_history(spark, path, spark.createDataFrame([day(input=5, cost=1.5)], DAY))
    store.update_history(spark, path, spark.createDataFrame([day(input=3, output=9), day(d="2026-01-02", input=1)], DAY))
    got = {str(r.date): (r.input, r.output, r.cost) for r in store.load_history(spark, path).collect()}
    assert got == {"2026-01-01": (5, 9, 1.5), "2026-01-02": (1, 0, 0.0)}
    f = tmp_path / "old.json"
    f.write_text(json.dumps({"r": {"/p": {"2026-01-05": {"input": 4, "lines_added": 2}, "not-a-date": {"input": 9}}}}))
    (r,) = store.import_history_json(spark, str(f)).collect()
    assert (r.input, r.added, r.cost, str(r.date)) == (4, 2, 0.0, "2026-01-05")


def test_settings(tmp_path):
    p = tmp_path / "s" / "settings.json"
    assert store.Settings.load(p) == store.Settings()
    store.Settings(True, TimeFilter.LAST_WEEK).save(p)
    assert store.Settings.load(p) == store.Settings(True, TimeFilter.LAST_WEEK)
    p.write_text("{")
    assert store.Settings.load(p) == store.Settings()


def test_windows():
    at = datetime(2026, 1, 2, 0, 30)
    w = window(TimeFilter.HOUR1, at)
    assert (w.start, w.end, w.start_minute) == (date(2026, 1, 1), date(2026, 1, 2), 23 * 60 + 30)
    assert window(TimeFilter.LAST_WEEK, at).start == date(2025, 12, 27) and window(TimeFilter.LAST_MONTH, at).start == date(2025, 12, 4)
    assert window(TimeFilter.ALL, at).start is None and display_range(TimeFilter.ALL, at, date(2025, 1, 1))[0] == date(2025, 1, 1)
    f, seen = TimeFilter.ALL, []
    for _ in range(7):
        seen.append(f)
        f = f.next()
    assert len(set(seen)) == 6 and seen[0] is seen[6]


def test_kpis_and_streak(spark):
    rows = [("2026-01-10", 10, 5, 2.0, 4, 3, 1, 1), ("2026-01-09", 0, 1, 0.0, None, None, None, None), ("2026-01-07", 9, 0, 1.0, None, 5, None, None), ("2026-01-08", 0, 0, 0.0, None, None, None, None)]
    d = spark.createDataFrame([(date.fromisoformat(a), *r) for a, *r in rows], "date date, input long, output long, cost double, suggested long, accepted long, added long, deleted long")
    k = kpi.kpis(d, datetime(2026, 1, 10, 9)).first()
    assert (k.total_cost, k.active_days, k.total_days, k.avg_tokens, k.streak) == (3.0, 4, 4, 6, 2)
    assert k.accept_rate == 100.0 and k.efficiency == pytest.approx(12.5)
    assert kpi.kpis(d, datetime(2026, 1, 11)).first().streak == 0
    none = kpi.kpis(d.limit(0), datetime(2026, 1, 11)).first()
    assert tuple(none) == (0.0, 0.0, 0, 0, 0, 0.0, 0)


def test_labels(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first().x

    n = lambda v: F.lit(v).cast("bigint")
    assert [one(fmt.format_tokens(n(v))) for v in (0, 999, 1000, 1250, 1_500_000)] == ["0", "999", "1.0K", "1.2K", "1.5M"]
    assert [one(fmt.format_axis_tokens(n(v))) for v in (12, 1500, 2_000_000)] == ["12", "2K", "2.0M"]
    assert [one(fmt.format_cost(F.lit(v))) for v in (0.125, 9.999, 12.34, 1234.5)] == ["$0.12", "$10.00", "$12.3", "$1234"]
    assert [one(fmt.format_kpi_cost(F.lit(v))) for v in (12.34, 100.4)] == ["$12.34", "$100"]
    assert [one(fmt.format_duration(n(v))) for v in (59, 60, 125)] == ["59m", "1h00m", "2h05m"]
    assert [one(fmt.version_newer(F.lit(a), F.lit(b))) for a, b in (("1.5.0", "1.4.0"), ("2.0.0", "1.9.9"), ("1.4.0", "1.4.0"), ("1.3.0", "1.4.0"), ("1.x.1", "1.0.0"))] == [True, True, False, False, True]
    assert one(fmt.truncate_label(F.lit("abcdef"), 4)) == "abc…"
    assert [one(scalars.group_name(F.lit(p), "/h/u")) for p in ("/h/u/code/X", "/h/u/a/b/Repo/Sub", "/h/u/one", "/else")] == ["code/X", "Repo/Sub", "one", "else"]
    assert [one(scalars.heuristic_root(F.lit(p))) for p in ("/a/Repo/Worktrees/R/feat", "/a/x/worktrees/y", "/a/b")] == ["/a/Repo", "/a/x", "/a/b"]
    assert [one(scalars.source_label(F.lit(c), F.lit("/g"), F.lit("dir"))) for c in ("/g/a/b", "/g", "/gx", None)] == ["./a/b", "/g", "/gx", "dir"]
    assert one(scalars.source_display(F.lit("/h/u/.logs/projects"), "/h/u")) == ".logs"
    t = F.array(*[n(x) for x in (5, 10, 20, 40)])
    assert [one(scalars.token_level(n(v), t)) for v in (0, 5, 6, 20, 40, 41)] == [0, 1, 2, 3, 4, 4]
    assert one(scalars.accept_rate(n(2), n(3))) == 66 and one(scalars.detail_accept_pct(n(3), n(2))) == 150.0 and one(scalars.bucket_rate(n(1), n(0))) == 0


def test_quartiles(spark):
    v = lambda *x: spark.createDataFrame([(i,) for i in x], "v long")
    q = lambda df: df.agg(heatmap.quartiles(F.col("v")).alias("q")).first().q
    assert q(v(1, 2, 3, 4, 0)) == [2, 3, 4, 4] and q(v(9)) == [9, 9, 9, 9] and q(v(0)) == [1, 2, 3, 4] and q(v(1, 2, 3, 4, 5, 6, 7)) == [2, 4, 6, 7]
    e = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (0.0,)], "efficiency double")
    assert cards.efficiency_quartiles(e).first().q == [1.5, 2.0, 3.0] and cards.efficiency_quartiles(e.limit(0)).first().q == [500, 1000, 1500]


def test_rebucket(spark):
    p = lambda *x: spark.createDataFrame(list(enumerate(map(float, x))), "i int, value double")
    vals = lambda df: [r.value for r in df.orderBy("i").collect()]
    assert vals(series.rebucket(p(1, 2, 3, 4, 5), 5, 2)) == [3.0, 12.0]
    assert vals(series.rebucket(p(1, 2), 2, 5)) == [1, 1, 1, 2, 2]
    assert vals(series.rebucket(p(1, 2), 2, 5, upsample=False)) == [1, 2] and vals(series.rebucket(p(1, 2), 2, 0)) == []


def test_intraday_edges():
    at = datetime(2026, 1, 2, 5, 7)
    assert heatmap.HOURS12.start(at) == datetime(2026, 1, 1, 18) and heatmap.HOURS12.active(at) == 67
    assert heatmap.HOUR1.start(at) == datetime(2026, 1, 2, 4, 8) and heatmap.HOUR1.active(at) == 60 and heatmap.TODAY.active(at) == 31


SOURCES = "seq long, dir_name string, path string, session_files array<string>, cwd string, source_root string"


def test_groups_by_identity(spark):
    src = [(0, "d0", "/l/d0", ["s2", "s1"], "/h/code/Repo/wt", "/l"), (1, "d1", "/l/d1", ["s3"], "/h/code/Repo", "/l"), (2, "d2", "/l/d2", ["s0"], "/h/code/Repo", "/m"), (3, "d3", "/l/d3", ["x"], None, "/l"), (4, "d4", "/l/d4", ["y"], "/h/a", "/l")]
    ids = spark.createDataFrame([("/h/code/Repo/wt", "/h/code/Repo/wt", "u"), ("/h/code/Repo", "/h/code/Repo", "u"), ("/h/a", "/h/a", None)], "cwd string, root_path string, remote_url string")
    g = grouping.group_by_identity(spark.createDataFrame(src, SOURCES), ids, "/h")
    rows = {r.root_key: r for r in g.collect()}
    assert set(rows) == {"/h/code/Repo", "/l/d3", "/h/a"}
    r = rows["/h/code/Repo"]
    assert r.name == "code/Repo" and r.sessions == 4 and r.cwds == ["/h/code/Repo/wt", "/h/code/Repo"] and r.remote_url == "u"
    assert [s.session_files for s in r.sources] == [["s1", "s2"], ["s0", "s3"]]
    assert [x.root_key for x in g.orderBy("pos").collect()] == ["/h/a", "/h/code/Repo", "/l/d3"]
    m = {r.session_file: (r.root, r.cwd) for r in grouping.session_map(spark.createDataFrame([*src, (5, "d5", "/l/d5", ["/z/s1"], None, "/n")], SOURCES)).collect()}
    assert m["s1"] == ("/n", "/l/d5") and m["x"] == ("/l", "/l/d3")


def test_overrides(spark, tmp_path):
    src = [(i, f"d{i}", f"/l/d{i}", [f"s{i}"], c, "/l") for i, c in enumerate(["/h/a", "/h/a/sub", "/h/b", "/h/long/c", "/h/z"])]
    ids = spark.createDataFrame([("/h/a", "/h/a", None), ("/h/a/sub", "/h/a", None), ("/h/b", "/h/b", "u"), ("/h/long/c", "/h/long/c", "v"), ("/h/z", "/h/z", None)], "cwd string, root_path string, remote_url string")
    g = grouping.group_by_identity(spark.createDataFrame(src, SOURCES), ids, "/h")
    keys = lambda o: [(r.root_key, r.name, r.origin) for r in apply_overrides(g, o, "/h").orderBy("pos").collect()]
    assert [k for k, *_ in keys(Overrides())] == ["/h/a", "/h/b", "/h/long/c", "/h/z"]
    assert {k: o for k, _, o in keys(Overrides(splits={"/h/a", "/h/b"}))} == {"/h/a": "split", "/h/a/sub": "split", "/h/b": None, "/h/long/c": None, "/h/z": None}
    assert {k for k, *_ in keys(Overrides(source_extracts={"/h/a/sub"}))} == {"/h/a", "/h/a/sub", "/h/b", "/h/long/c", "/h/z"}
    o = Overrides(merges=[["/h/long/c", "/h/b"]], stars={"/h/long/c"}, hidden={"/h/b", "/h/a"}, renames={"/h/long/c": "C!"})
    assert keys(o) == [("/h/b", "C!", "merged"), ("/h/z", "z", None), ("/h/a", "a", None)]
    assert o.stars == {"/h/b"} and o.hidden == {"/h/a"} and o.renames == {"/h/b": "C!"}
    assert [r.root_key for r in listed_order(g, Overrides(stars={"/h/z"}, hidden={"/h/a"})).collect()] == ["/h/z", "/h/b", "/h/long/c", "/h/a"]
    o = Overrides()
    for a, b in (("1", "2"), ("3", "4"), ("2", "3"), ("4", "5"), ("1", "5")):
        o.add_merge(a, b)
    assert o.merges == [["1", "2", "3", "4", "5"]]
    o.add_split("1")
    o.toggle_star("2")
    o.toggle_hidden("2")
    o.rename("2", "x")
    o.rename("2", "")
    assert o.merges == [["2", "3", "4", "5"]] and o.splits == {"1"} and o.stars == set() and o.hidden == {"2"} and o.renames == {}
    o.save(tmp_path / "o.json")
    assert Overrides.load(tmp_path / "o.json") == o and Overrides.load(tmp_path / "none.json") == Overrides()
    o.reset_all()
    assert o == Overrides()


def test_discovery_and_identity(spark, tmp_path):
    root = tmp_path / ".config" / "claude" / "projects"
    (root / "p1" / "sub").mkdir(parents=True)
    (root / "empty").mkdir()
    (tmp_path / ".my-claude-x" / "projects").mkdir(parents=True)
    line = json.dumps(said({"input_tokens": 4}))
    (root / "p1" / "a.jsonl").write_text("\n".join(["x"] * 31 + ['{"type":"user","cwd":"/late"}', line]))
    (root / "p1" / "sub" / "b.jsonl").write_text('{"type":"assistant","cwd":"/no"}\n{"type":"user","cwd":"/yes"}\n' + line)
    assert logs.find_roots(tmp_path) == [root, tmp_path / ".my-claude-x" / "projects"]
    (s,) = logs.discover(spark, logs.find_roots(tmp_path)).collect()
    assert s.cwd == "/yes" and s.dir_name == "p1" and [f.rsplit("/", 1)[1] for f in s.session_files] == ["a.jsonl", "b.jsonl"]
    assert logs.read_events(spark, str(root)).agg(F.sum("input")).first()[0] == 8
    (c,) = logs.cwd_by_source(spark, str(root)).collect()
    assert c.cwd == "/yes" and c.path.endswith("/p1")
    repo = tmp_path / "code" / "repo"
    (repo / ".git" / "worktrees" / "w").mkdir(parents=True)
    (repo / "deep").mkdir()
    tree = tmp_path / "code" / "tree"
    tree.mkdir()
    (tree / ".git").write_text(f"gitdir: {repo}/.git/worktrees/w\n")
    r = lambda p: grouping.resolve_identity(str(p), lambda x: "url")
    assert r(repo / "deep") == (str(repo), "url") and r(tree) == (str(repo), "url") and r(repo / "gone" / "x") == (str(repo), "url")
    assert grouping.resolve_identity("/nowhere/at/all/worktrees/x") == ("/nowhere/at/all", None)


def test_streaming_equals_batch(spark, tmp_path, sessions):
    from ledgerlight.streaming import ingest

    src = tmp_path / "in"
    src.mkdir()

    def put(name, *rows):
        (src / name).write_text("\n".join(json.dumps(said({"input_tokens": n}, timestamp=t)) for t, n in rows))

    put("a.jsonl", ("2026-01-01T00:00:10Z", 1), ("2026-01-02T00:03:00Z", 2))
    stream = lambda: ingest.ingest(ingest.event_stream(spark, str(src)), sessions, f"{tmp_path}/store", f"{tmp_path}/cp").awaitTermination()
    stream()
    put("b.jsonl", ("2026-01-01T00:04:00Z", 7))
    put("c.jsonl", ("2026-01-01T10:00:00Z", 9))
    stream()
    stream()
    got = sorted((r.root, str(r.date), r.input, r.active_minutes) for r in store.load_history(spark, f"{tmp_path}/store/history").collect())
    want = sorted((r.root, str(r.date), r.input, r.active_minutes) for r in rollup.day_rollup(logs.read_events(spark, str(src)), sessions).collect())
    assert got == want and ("r1", "2026-01-01", 8, 2) in got
    q = ingest.session_activity(ingest.event_stream(spark, str(src)), sessions).writeStream.format("memory").queryName("act").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("act").columns == ["root", "cwd", "date", "start", "end", "minutes", "events"]


def test_dashboard_views(spark):
    from ledgerlight import adapter as ad
    from ledgerlight.plans.dashboard import Dashboard

    d = "/root/testdata/sf0.001"
    b = Dashboard(ad.usage_events(spark, d), ad.session_map(spark), ad.groups(spark).withColumn("remote_url", F.lit(None).cast("string")).withColumn("sources", F.expr("transform(cwds, c -> struct(0L as seq, c as dir_name, c as path, c as cwd, '' as source_root, array('x') as session_files))")), ad.as_of(spark, d), overrides=ad.overrides())
    c = b.cards().collect()
    assert c and "/home/u/code/p3" not in {r.root_key for r in c} and {r.rank for r in c} == set(range(1, len(c) + 1))
    for f in TimeFilter:
        v = b.view(f, project="/home/u/code/p4")
        assert v.kpis().count() == 1 and v.heatmap().count() > 0
    assert b.view(TimeFilter.TODAY).model_costs(10).columns == ["root_key", "model", "i", "value"]
    assert b.view(TimeFilter.ALL, root="/nowhere").daily.count() == 0


def test_a_writer_that_dies_leaves_the_old_history(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/h"
    store.update_history(spark, path, spark.createDataFrame([day(input=5)], DAY))

    def dies(*_):
        raise OSError("between the two writes")

    with monkeypatch.context() as m:
        m.setattr(store, "point", dies)
        with pytest.raises(OSError, match="between"):
            store.update_history(spark, path, spark.createDataFrame([day(input=9)], DAY))
    assert [r.input for r in store.load_history(spark, path).collect()] == [5]
    for n in (6, 7, 8):
        store.update_history(spark, path, spark.createDataFrame([day(input=n)], DAY))
    assert [r.input for r in store.load_history(spark, path).collect()] == [8]
    assert len([p for p in (tmp_path / "h").iterdir() if p.name.startswith("v-")]) <= 3  # newest, one older, one never pointed at


def test_labels_are_cut_by_bytes(spark):
    def cut(s, most):
        if len(s.encode()) <= most:
            return s
        return "" if most < 1 else s.encode()[: most - 1].decode(errors="ignore") + "…"

    texts = ["", "a", "abcdef", "éééé", "日本語テキスト", "a😀b😀", "ñandú y más"]
    for most in range(9):
        got = spark.createDataFrame([(t,) for t in texts], "s string").select("s", fmt.truncate_label(F.col("s"), most).alias("x")).collect()
        assert {r.s: r.x for r in got} == {t: cut(t, most) for t in texts}, most


def test_line_difference_is_a_multiset(spark):
    from collections import Counter

    from ledgerlight.functions.lines import count_diff_lines

    pairs = [("x\nx", "x"), (None, "a\nb\n"), ("a\r\nb", "b\na"), ("", ""), ("\n\n", "\n"), ("p\nq\np\np", "p\nr\nr"), ("a\n" * 3000, "b\n" * 2000 + "a\n")]
    got = spark.createDataFrame(pairs, "old string, new string").select(*count_diff_lines(F.col("old"), F.col("new"))).collect()
    lines = lambda t: Counter((t or "").replace("\r\n", "\n").split("\n")[: -1 if (t or "").endswith("\n") or not t else None])
    assert [tuple(r) for r in got] == [((lines(b) - lines(a)).total(), (lines(a) - lines(b)).total()) for a, b in pairs]


def test_restructure_changes_nothing_given(tmp_path):
    from ledgerlight.operators.overrides import restructure

    source = lambda c: {"seq": 0, "dir_name": "d", "path": "/l", "cwd": c, "source_root": "/l", "session_files": ["s"]}
    groups = [{"root_key": k, "name": k, "remote_url": None, "sources": [source(k)], "sessions": 1, "origin": None} for k in ("/a/long", "/b")]
    o = Overrides(merges=[["/a/long", "/b"]], hidden={"/a/long"}, stars={"/a/long"}, renames={"/a/long": "N"})
    out, after = restructure(groups, o)
    assert [(g["root_key"], g["name"], g["sessions"]) for g in out] == [("/b", "N", 2)]
    assert o == Overrides(merges=[["/a/long", "/b"]], hidden={"/a/long"}, stars={"/a/long"}, renames={"/a/long": "N"})
    assert (after.hidden, after.stars, after.renames) == (set(), {"/b"}, {"/b": "N"})
    assert grouping.origin_url(tmp_path) is None


def test_changes_are_merged_and_gathered_up(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/h"
    monkeypatch.setattr(store, "CHANGES", 2)
    want = {}
    for n in range(7):
        rows = [day(d="2026-01-01", input=10 - n, output=n), day(d=f"2026-01-{n + 2:02}", input=n)]
        store.update_history(spark, path, spark.createDataFrame(rows, DAY))
        want |= {"2026-01-01": (10, n), f"2026-01-{n + 2:02}": (n, 0)}
        assert {str(r.date): (r.input, r.output) for r in store.load_history(spark, path).collect()} == want
    assert len([p for p in (tmp_path / "h").iterdir() if p.name.startswith("v-")]) == 2
    assert len([p for p in (tmp_path / "h" / "changes").iterdir() if p.name.startswith("c-")]) <= 4  # of the newest and one older version


def test_heads_of_split_files(spark, tmp_path):
    root = tmp_path / "logs"
    for name, at in (("in", 30), ("out", 31)):
        (root / name).mkdir(parents=True)
        lines = ["x" * 300] * at + ['{"type":"user","cwd":"/here"}'] + ["y"] * 400
        (root / name / "a.jsonl").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = [(r.path.rsplit("/", 1)[1], r.cwd) for r in logs.cwd_by_source(spark, str(root)).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [("in", "/here")]


def test_views_share_one_pass_over_the_log(spark):
    from ledgerlight import adapter as ad
    from ledgerlight.plans.dashboard import Dashboard

    d = "/root/testdata/sf0.001"
    b = Dashboard(ad.usage_events(spark, d), ad.session_map(spark), ad.groups(spark), ad.as_of(spark, d))
    v = b.view(TimeFilter.ALL, root="/home/u/.r1/projects")
    assert v.rolled is b.rolled
    assert b.first_date() == b.daily.agg(F.min("date")).first()[0] and v.first_date() == v.daily.agg(F.min("date")).first()[0]
    rows = rollup.day_rollup(b.events, b.session_map).orderBy("root", "cwd", "date").collect()
    assert [tuple(r)[:3] + (r.input, r.active_minutes) for r in rows] == [tuple(r)[:3] + (r.input, r.active_minutes) for r in b.day.orderBy("root", "cwd", "date").collect()]
