"""Near duplicates where different texts share a doc_id, and where rows without one link others."""

from collections import Counter

from test_operators import SCHEMA, brute_near

from ledgerlight.llm import neardup


def text(*words):
    return " ".join([f"w{i}" for i in range(40)][: 40 - len(words)] + list(words))


def test_texts_that_share_a_doc_id_keep_their_links(spark):
    a, b = text("x1"), " ".join(f"v{i}" for i in range(50))
    rows = [(1, a, "", 0), (2, a + " tail", "", 0), (2, b, "", 0), (3, b + " tail", "", 0), (3, b + " tail", "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute_near(rows)
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect())
    assert got == Counter((d, *want[d, t], d == want[d, t][1]) for d, t, *_ in rows)
    assert sorted((r.doc_id, r.text) for r in neardup.keep_one(df).collect()) == [(1, a), (2, b)]


def test_one_doc_id_in_two_groups_keeps_one_of_each(spark):
    a, b = text("x1"), " ".join(f"v{i}" for i in range(50))
    rows = [(1, a, "", 0), (1, b, "", 0), (5, a + " tail", "", 0), (6, b + " tail", "", 0), (1, a + " end", "", 0)]
    left = neardup.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter(r.doc_id for r in left) == {1: 2} and b in {r.text for r in left}


def test_rows_without_a_doc_id_link_others(spark):
    words = [f"w{i}" for i in range(60)]
    steps = [" ".join(words[i : i + 40]) for i in (0, 4, 8)]  # neighbours are similar, the ends are not
    rows = [(7, steps[0], "", 0), (None, steps[1], "", 0), (9, steps[2], "", 0)]
    want = brute_near(rows)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {d: want[d, t][1] for d, t, *_ in rows} == {7: 7, None: 7, 9: 7}
