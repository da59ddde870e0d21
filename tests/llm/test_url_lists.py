"""URL filter: lists of any length, empty tables, every ending of a listed site."""

from ledgerlight.llm import urlfilter

SCHEMA = "page_id long, url string"


def test_long_lists_and_empty_tables(spark):
    assert urlfilter.blocks_for(5) == 64 and urlfilter.blocks_for(10_000) == 3750 and urlfilter.blocks_for(10**9) == urlfilter.MOST_BLOCKS
    urls = [(i, f"http://a.h{i}.test/p{i}/") for i in range(400)] + [(1000, None), (1001, "http://" + "x" * 50_000 + ".test/"), (3, "http://a.h3.test/p3/")]
    keys = [f"h{i}.test/" for i in range(0, 400, 7)] + [f"a.h{i}.test/p{i}" for i in range(0, 400, 5)] + [f"other{i}.test/" for i in range(3000)] + [None, "h0.test/"]
    listed = spark.createDataFrame([(k,) for k in keys], "key string")
    pages = spark.createDataFrame(urls, SCHEMA)
    got = sorted((r.page_id, r.verdict) for r in urlfilter.filter_urls(pages, listed, rules=()).collect())
    bad = lambda i: i < 400 and (i % 7 == 0 or i % 5 == 0)
    assert got == sorted((i, "block" if bad(i) else "allow") for i, _ in urls)
    assert urlfilter.filter_urls(pages.limit(0), listed).count() == 0
    assert urlfilter.filter_urls(pages.limit(0), listed.limit(0)).count() == 0


def test_sites_are_listed_under_every_ending(spark):
    urls = [(i, f"http://www.{site}.{end}/x") for i, (site, end) in enumerate((s, e) for s in ("adult-x", "spam-farm", "fine") for e in urlfilter.ENDINGS)]
    got = {r.page_id: r.verdict for r in urlfilter.filter_urls(spark.createDataFrame(urls, SCHEMA), urlfilter.listed_frame(spark), rules=()).collect()}
    assert [got[i] for i in range(9)] == ["block"] * 6 + ["allow"] * 3
