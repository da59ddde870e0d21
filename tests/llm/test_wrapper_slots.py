"""HTML main text: the varying slot decides before tags and names."""

import random

from ledgerlight.llm import wrapper

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
TEASER = '<html><body><article>Read more: %s</article><div class="sidebar"><p>%s</p><p>%s</p></div><div class="sidebar"><p>%s</p></div><div class="end">All rights</div></body></html>'
SECTIONS = "<html><body><article>Top story of the day</article><div><h1>%s</h1><section><p>%s</p></section><section><p>%s</p></section></div></body></html>"


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def test_slot_decides_before_tags_and_names_and_keeps_all_its_roots():
    r = random.Random(1)
    constants, slot = wrapper.induce([TEASER % (prose(r, 2), *(prose(r, 40) for _ in range(3))) for _ in range(8)])
    assert wrapper.main_text(TEASER % ("t", "one", "two", "three"), frozenset(constants), slot) == "one\n\ntwo\n\nthree"


def test_title_over_sections_belongs_to_the_slot():
    r = random.Random(2)
    constants, slot = wrapper.induce([SECTIONS % (prose(r, 5), prose(r, 40), prose(r, 40)) for _ in range(8)])
    assert wrapper.main_text(SECTIONS % ("t", "one", "two"), frozenset(constants), slot) == "t\n\none\n\ntwo"


def test_roles_decide_where_the_slot_holds_nothing():
    assert wrapper.main_text("<body><nav>n</nav><article>a</article></body>", frozenset(), "/#root/html/body/div") == "a"
