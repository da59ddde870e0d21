"""Labels against a plain loop over the candidates, on charts of any size."""

from datetime import date, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ledgerlight.operators import labels


def kept(candidates, gap):
    out, end = [], -gap
    for i, col, label in candidates:
        if col >= end + gap:
            out.append((i, col, label))
            end = col + len(label)
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.integers(0, 40), st.sampled_from(["a", "bb", "ccc", "12:30"])), max_size=12), min_size=1, max_size=5), st.integers(0, 4))
def test_placed(spark, charts, gap):
    cand = {k: [(i, col, label) for i, (col, label) in enumerate(sorted(c))] for k, c in enumerate(charts)}
    rows = [(k, *x) for k, c in cand.items() for x in c]
    df = spark.createDataFrame(rows, "k int, i int, col int, label string")
    got = sorted(map(tuple, labels.placed(df, ("k",), gap).collect()))
    assert got == [(k, *x) for k, c in cand.items() for x in kept(c, gap)]


def test_month_of_the_second_week_has_no_room(spark):
    charts = spark.createDataFrame([("late", date(2024, 1, 28), 9), ("early", date(2024, 2, 4), 9), ("none", date(2024, 2, 4), 0)], "k string, start date, weeks int")
    got = sorted(map(tuple, labels.months(charts, 3, 1, ("k",)).collect()))
    assert got == [("early", 0, 3, "Feb"), ("early", 4, 7, "Mar"), ("late", 0, 3, "Jan"), ("late", 5, 8, "Mar")]
    cut = sorted(map(tuple, labels.months(charts, 3, 1, ("k",), 9).collect()))
    assert cut == [("early", 0, 3, "Feb"), ("early", 4, 7, "Ma"), ("late", 0, 3, "Jan"), ("late", 5, 8, "M")]


def test_dates_are_evenly_spread_and_stay_inside(spark):
    first = date(2024, 12, 20)
    charts = spark.createDataFrame([(n, first, first + timedelta(days=n - 1)) for n in (1, 2, 7, 30, 400)], "k int, first date, last date")
    for width in (5, 6, 20, 80):
        got = labels.date_axis(charts, width, ("k",)).collect()
        if width < 6:
            assert not got
            continue
        for n in (1, 2, 7, 30, 400):
            mine = sorted((r.i, r.col, r.label) for r in got if r.k == n)
            assert len(mine) == min(max(width // 8, 1), n)
            assert mine[0][2] == "Dec 20" and all(0 <= c <= width - 6 for _, c, _ in mine)
            if len(mine) > 1:
                assert mine[-1][2] == (first + timedelta(days=n - 1)).strftime("%b %d")


def test_times_without_room_or_buckets(spark):
    charts = spark.createDataFrame([(0,)], "start int")
    assert labels.time_axis(charts, 6, 10, 5).count() == 0
    assert labels.time_axis(charts, 60, 0, 80).count() == 0
    assert [tuple(r) for r in labels.time_axis(charts, 6, 10, 12).orderBy("i").collect()] == [(0, 0, "00:00"), (1, 7, "00:54")]
