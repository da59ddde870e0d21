"""Near duplicates: blocks bounded in members and shingles, bands of sizes, groups without a doc_id."""

import random
from collections import Counter

import pytest
from test_operators import SCHEMA, brute_near

from ledgerlight.llm import neardup
from ledgerlight.llm.components import components


@pytest.mark.parametrize(("block", "shingles"), [(8, 1 << 21), (256, 1000), (16, 1 << 21)])
def test_links_of_any_two_sizes_are_found(spark, monkeypatch, block, shingles):
    """One list of many sizes, in many blocks: links inside a band, to the next one, at the very threshold."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", shingles)
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = [(0, " ".join(words[:79]), "", 0), (1, " ".join(words[:104]), "", 0)]  # 75 of 100 shingles
    for i in range(2, 150):
        at, n = r.choice([0, 0, 0, 100, 250]), r.choice([5, 6, 9, 20, 33, 60, 61, 110, 140])
        w = words[at : at + n]
        for _ in range(r.choice([0, 1, 3])):
            w[r.randrange(n)] = f"x{i % 30}"
        rows.append((i, " ".join(w), "", 0))
    df = spark.createDataFrame(rows, SCHEMA)
    posts = spark.createDataFrame([(7, i) for i in range(150)], "key long, id long")
    found = components(neardup.exact_rest(posts, spark.createDataFrame([], "node long, comp long"), neardup.shingle_sets(df, posts.select("id"))))
    got = {x.node: x.comp for x in found.collect()}
    want = brute_near(rows)
    assert {i: got.get(i, i) for i in range(150)} == {d: want[d, t][1] for d, t, *_ in rows}
    assert got[1] == 0


def test_meetings_hold_few_shingles(spark, monkeypatch):
    """Long sets are dealt into more blocks; only blocks of neighbouring sizes meet."""
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 4000)
    seen = []
    monkeypatch.setattr(neardup, "_meet", lambda pdf: pdf)  # not run: the plan's input is looked at
    monkeypatch.setattr("pyspark.sql.group.GroupedData.applyInPandas", lambda self, f, s: seen.append(self._df))
    r = random.Random(4)
    rows = [(i, " ".join(f"v{r.randrange(10**6)}" for _ in range(n)), "", 0) for i, n in enumerate([1000] * 40 + [10] * 40)]
    df = spark.createDataFrame(rows, SCHEMA)
    posts = spark.createDataFrame([(7, i) for i in range(80)], "key long, id long")
    neardup.exact_rest(posts, spark.createDataFrame([], "node long, comp long"), neardup.shingle_sets(df, posts.select("id")))
    meetings = {}
    for x in seen[0].select("meet", "id", "set").collect():
        meetings.setdefault(x.meet, []).append(len(x.set) // 8)
    assert len(meetings) > 40 and max(map(sum, meetings.values())) < 40_000
    assert not any(max(sizes) > 100 and min(sizes) < 100 for sizes in meetings.values())


def test_groups_without_a_doc_id_keep_one_row(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(50)) for x in "abc")
    rows = [(None, a, "", 0), (None, a, "", 0), (None, a + " tail", "", 0), (4, b, "", 0), (None, b, "", 0), (None, b + " end", "", 0)]
    rows += [(None, c, "", 0), (None, "", "", 0), (None, "", "", 0), (None, None, "", 0)]
    left = Counter((x.doc_id, x.text) for x in neardup.keep_one(spark.createDataFrame(rows, SCHEMA)).collect())
    one = [k for k in left if k[1] in (a, a + " tail")]
    assert len(one) == 1 and left.pop(one[0]) == 1
    assert left == Counter({(4, b): 1, (None, c): 1, (None, ""): 2, (None, None): 1})
