"""The pipeline's stages on the smallest tables, each against brute force on its own input."""

from collections import Counter

import corpus_pipeline
import tiktoken
import public_tokenizers
from test_operators import brute_lines, brute_near

from ledgerlight.llm import bytebpe, decontaminate, toxicity
from ledgerlight.llm.common import read, stored

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read(spark, SF, "documents")
    inputs = []
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, SF), name)
        inputs.append((name, docs, out))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            assert out.schema.simpleString() == docs.schema.simpleString()
        docs = out
    by = {name: ([(r.doc_id, r.text) for r in a.collect()], b.collect()) for name, a, b in inputs}

    before, after = by["toxicity"]
    judged = {r.doc_id: r.predicted for r in toxicity.score(read(spark, SF, "documents"), read(spark, SF, "labels")).collect()}
    assert {r.doc_id for r in after} == {d for d, _ in before if not judged[d]}

    before, after = by["line_dedup"]
    lines = brute_lines([(d, t, 0) for d, t in before])
    want = {d: lines[d, t][2] for d, t in before if not (lines[d, t][1] and not lines[d, t][2].strip())}
    assert {r.doc_id: r.text for r in after} == want
    assert all(r.n_chars == len(r.text) for r in after)

    before, after = by["minhash_near_dedup"]
    near = brute_near(before)
    assert Counter(r.doc_id for r in after) == Counter(d for d, t in before if near[d, t][1] == d)

    before, after = by["decontamination"]
    bad = {r.doc_id for r in decontaminate.contamination(inputs[3][1], read(spark, SF, "benchmark")).collect() if r.contaminated}
    assert {r.doc_id for r in after} == {d for d, _ in before} - bad

    before, after = by["byte_bpe"]
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.ranks(), special_tokens={})
    assert {r.doc_id: r.n_tokens for r in after} == {d: len(enc.encode_ordinary(t)) for d, t in before}


def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and rows.count() > 100
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None


def test_empty_and_odd_tables(spark):
    odd = spark.createDataFrame([(1, None, "x", 3), (None, "some text", None, None), (2, "", "y", 0), (2, "", "y", 0)], "doc_id long, text string, score string, n int")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, SF).count() == odd.count(), name
        assert stage(spark, odd.limit(0), SF).count() == 0, name
