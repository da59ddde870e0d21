"""Near duplicates: lists with much the same members meet once, not once a list."""

import random

from test_operators import SCHEMA, brute_near

from ledgerlight.llm import neardup
from ledgerlight.llm.components import components


def of_lists(spark, lists):
    return spark.createDataFrame([(k, i, i) for k, ids in lists.items() for i in ids], "key long, id long, comp long")


def test_lists_of_one_group_meet_once(spark, monkeypatch):
    """Copies that share twenty lists: the seats are those of some two lists, and the links those of all."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    r = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(48):
        w = list(words)
        for _ in range(r.choice([0, 1, 2, 4])):
            w[r.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(w), "", 0))
    df = spark.createDataFrame(rows, SCHEMA)
    lists = {k: r.sample(range(48), 44) for k in range(20)}
    posts = of_lists(spark, lists).select("key", "id")
    none = spark.createDataFrame([], "node long, comp long")
    sets = neardup.shingle_sets(df, posts.select("id").distinct())
    found = {x.node: x.comp for x in components(neardup.exact_rest(posts, none, sets)).collect()}
    want = brute_near(rows)
    assert {i: found.get(i, i) for i in range(48)} == {d: want[d, t][1] for d, t, *_ in rows}
    seen = []
    monkeypatch.setattr("pyspark.sql.group.GroupedData.applyInPandas", lambda self, f, s: seen.append(self._df))
    neardup.exact_rest(posts, none, sets)
    assert seen[0].count() < 20 * 44 * (44 // 8) / 4


def test_merging_keeps_every_pair_and_adds_none_in_sum(spark):
    r = random.Random(7)
    lists = {k: {*r.sample(range(100), 60)} for k in range(6)}
    lists |= {10 + k: {500, *range(600 + 50 * k, 640 + 50 * k)} for k in range(8)}  # nothing but one member in common
    lists |= {30: {900}, 31: {901, 902}}
    member = of_lists(spark, lists)
    for salt in range(3):
        member = neardup.merged(member, salt)
        got = {}
        for x in member.collect():
            assert x.id == x.comp and x.id not in got.setdefault(x.key, set())
            got[x.key].add(x.id)
        assert all(any(old <= new for new in got.values()) for old in lists.values())
        assert sum(len(x) ** 2 for x in got.values()) <= sum(len(x) ** 2 for x in lists.values())
    assert len(got) < len(lists) and {10 + k for k in range(8)} <= {*got}
