"""HTML main text: constants are counted over all pages of a host, in each layout."""

import random

import pytest

from ledgerlight.llm import wrapper

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
A = "<html><body><div><p>%s</p><p>%s</p></div><p>foot of one</p></body></html>"
B = "<html><body><section><p>Subscribe in the second layout</p><p>%s</p><p>%s</p></section><div><p>other things</p></div></body></html>"
NOTICE = "<html><body><div><div><p>An optional notice of this site</p></div><p>%s</p><p>%s</p></div><p>foot of one</p></body></html>"


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.mark.parametrize("other", [B, NOTICE])
def test_layouts_and_optional_parts_have_constants(spark, other):
    r = random.Random(3)
    rows = []
    for i in range(60):
        a, b = prose(r, 30), prose(r, 30)
        rows.append((i, f"http://one.example/{i}", (other if i % 4 == 0 else A) % (a, b), f"{a}\n\n{b}"))
    got = wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string, want string")).collect()
    assert {x.page_id: x.text for x in got} == {i: w for i, _, _, w in rows}


def test_near_copies_do_not_make_their_paragraphs_constant(spark):
    r = random.Random(4)
    same = prose(r, 30)
    rows = []
    for i in range(40):
        a, b = (same if i < 8 else prose(r, 30)), prose(r, 30)
        rows.append((i, f"http://one.example/{i}", A % (a, b), f"{a}\n\n{b}"))
    got = wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string, want string")).collect()
    assert {x.page_id: x.text for x in got} == {i: w for i, _, _, w in rows}
