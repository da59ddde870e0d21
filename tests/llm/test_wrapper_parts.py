"""HTML main text: what goes from a varying slot, and that menus and footers are learned as constants."""

import random

from ledgerlight.llm import wrapper

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
PAGE = (
    '<html><body><div class="top">Daily paper of the town</div><article><header><h1>{0}</h1></header><p>{1}</p><aside><p>{2}</p></aside><section class="social"><p>{3}</p></section>'
    '<div class="share"><a href="#">{4}</a> or <a href="#">{5}</a></div><div class="comments"><p>{6}</p></div><div class="ad">{7}</div><p>Subscribe to our letter today</p></article><footer>All rights kept</footer></body></html>'
)
FLAT = '<html><body><div>{menu}</div><div><p>{0}</p><p>{1}</p></div><div>Imprint and terms</div></body></html>'


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def filled(r):
    return [prose(r, n) for n in (5, 40, 20, 30, 2, 2, 20, 6)]


def page_rows(spark, htmls):
    return spark.createDataFrame([(i, f"https://one.example/{i}", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")


def test_an_article_keeps_its_own_parts(spark):
    r = random.Random(1)
    parts = [filled(r) for _ in range(12)]
    got = {x.page_id: x.text for x in wrapper.extract(page_rows(spark, [PAGE.format(*p) for p in parts])).collect()}
    assert got == {i: "\n\n".join(p[:4]) for i, p in enumerate(parts)}


def test_a_menu_that_varies_is_no_text(spark):
    r = random.Random(2)
    pages = []
    for _ in range(12):
        menu = "".join(f'<a href="/{prose(r, 1)}">{prose(r, 5)}</a> ' for _ in range(6))
        pages.append((menu, prose(r, 40), prose(r, 30)))
    got = {x.page_id: x.text for x in wrapper.extract(page_rows(spark, [FLAT.format(a, b, menu=m) for m, a, b in pages])).collect()}
    assert got == {i: f"{a}\n\n{b}" for i, (_, a, b) in enumerate(pages)}


def test_menus_and_footers_are_among_the_constants(spark):
    r = random.Random(3)
    df = page_rows(spark, [PAGE.format(*filled(r)) for _ in range(12)])
    (row,) = wrapper.wrappers(df).collect()
    root, article = "/#root/html/body", "/#root/html/body/article"
    for path, text in ((f"{root}/div.top", "Daily paper of the town"), (f"{root}/footer", "All rights kept"), (f"{article}/p", "Subscribe to our letter today")):
        assert wrapper.key(path, text) in row.constants, text


def test_links_inside_a_text_stay():
    html = '<html><body><div><p>See <a href="#">one</a>, <a href="#">two</a> and <a href="#">three</a> here.</p><ul><li><a href="#">a</a></li><li><a href="#">b</a></li></ul></div></body></html>'
    assert wrapper.main_text(html, frozenset(), "/#root/html/body/div") == "See one, two and three here.\n\na\n\nb"
