"""Filters that are too large for a literal: equal results, and how much they let pass."""

from pyspark.sql import functions as F

from ledgerlight.llm import decontaminate, urlfilter
from ledgerlight.llm.common import read

SF = "/root/testdata/sf0.001"


def test_a_million_listed_keys(spark):
    n = 1_000_000
    listed = spark.range(n).select(F.format_string("site%d.example.org/", F.col("id")).alias("key")).unionByName(urlfilter.listed_frame(spark))
    blocks = urlfilter.blocks_for(n)
    assert urlfilter.LITERAL_BLOCKS < blocks < urlfilter.MOST_BLOCKS
    others = spark.range(50_000).select(F.lit("u").alias("url"), F.format_string("other%d.example.org/", F.col("id")).alias("key"))
    passed = urlfilter.possible_hits(others, urlfilter.bloom_table(listed, blocks), blocks).count()
    assert passed < 0.01 * 50_000
    pages = read(spark, SF, "pages").select("page_id", "url").unionByName(spark.createDataFrame([(-1, None), (-2, "no scheme"), (-3, "http://a.site77.example.org/x"), (-4, "http://b.other77.example.org/x")], "page_id long, url string"))
    got = {r.page_id: tuple(r) for r in urlfilter.filter_urls(pages, listed).collect()}
    small = {r.page_id: tuple(r) for r in urlfilter.filter_urls(pages, urlfilter.listed_frame(spark)).collect()}
    assert got[-3][3:] == (None, "block") and got[-4][3:] == (None, "allow")
    del got[-3], small[-3]
    assert got == small


def test_pages_of_a_saturated_table_are_right(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "LITERAL_BLOCKS", 0)
    pages, listed = read(spark, SF, "pages"), urlfilter.listed_frame(spark)
    want = sorted(map(tuple, urlfilter.filter_urls(pages, listed, blocks=1).collect()), key=repr)
    monkeypatch.undo()
    assert want == sorted(map(tuple, urlfilter.filter_urls(pages, listed).collect()), key=repr)


def test_contamination_by_a_table_of_words(spark, monkeypatch):
    docs, bench = read(spark, SF, "documents"), read(spark, SF, "benchmark")
    extra = spark.createDataFrame([(None, None), (-1, ""), (-2, "a b")], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(extra)
    want = sorted(map(tuple, decontaminate.contamination(docs, bench).collect()), key=repr)
    monkeypatch.setattr(decontaminate, "BLOCKS", 1)
    assert sorted(map(tuple, decontaminate.contamination(docs, bench).collect()), key=repr) == want
    assert any(r[5] for r in want)
