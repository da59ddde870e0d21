"""What workers and the driver hold: the cache of operator 1 in bytes, the fit of operator 3 without texts."""

import struct
import sys

import numpy as np
from tokenizers import Tokenizer

from ledgerlight.llm import quality, tokenfile
from ledgerlight.llm.common import read, tune

SF = "/root/testdata/sf0.01"


def test_long_chunks_are_not_kept(monkeypatch):
    monkeypatch.setattr(tokenfile, "CACHE_BYTES", 20_000)
    cache, library = tokenfile.ChunkCache(), Tokenizer.from_file(tokenfile.VOCABULARY)
    r = np.random.default_rng(3)
    alphabet = np.array(list("abcXYZ019+/="))
    for size in (10, 900, 5_000, 60_000):
        for _ in range(12):
            text = "".join(r.choice(alphabet, size)) + " tail"
            ids = library.encode(text, add_special_tokens=False).ids
            assert cache.encode(text.encode()) == struct.pack(f"<{len(ids)}I", *ids)
    for part in (cache, cache.old):
        assert max(map(len, part), default=0) <= tokenfile.LONGEST
        assert sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in part.items()) <= 20_000 + 6 * tokenfile.LONGEST
    assert max(map(len, [*cache.pieces, *cache.old_pieces])) <= tokenfile.LONGEST_PIECE


def test_counts_of_lines_equal_a_plain_loop(spark):
    tune(spark)
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    want = {}
    for r in labels.where("quality IS NOT NULL").collect():
        if texts.get(r.doc_id) is None:
            continue
        feats, _, _ = quality.document_lines(texts[r.doc_id])
        ys = [int(r.quality or not set(f) & set(quality.SEEDS)) for f in feats]
        for k, f in enumerate(feats):
            beside = sum(2 * ys[j] - 1 for j in (k - 1, k + 1) if 0 <= j < len(ys))
            key = (sum(2**i for i in f), ys[k], beside)
            want[key] = want.get(key, 0) + 1
    assert labels.count() <= 1000, "half of each kind holds them all"
    assert quality.sample(docs, labels) == sorted((*k, n) for k, n in want.items())


def test_fit_of_repeated_ids_and_empty_tables(spark):
    tune(spark)
    schema, marks = "doc_id long, text string", "doc_id long, quality int, text string"
    rows = [(1, "A line that ends.\n| | | |")] * 5 + [(1, None), (2, "$$$ %%% ###\n\nmore $$$"), (None, "x"), (3, "")]
    labels = spark.createDataFrame([(1, 1, "x"), (1, 1, "y"), (2, 0, None), (3, 0, None), (None, 0, None), (4, None, None)], marks).drop("text")
    got = quality.sample(spark.createDataFrame(rows, schema), labels)
    assert sum(n for *_, n in got) == 4 and {y for _, y, _, _ in got} == {0, 1}
    weights, coupling = quality.train(got)
    assert len(weights) == len(quality.FEATURES) and 0 <= coupling <= 2
    assert quality.sample(spark.createDataFrame([], schema), labels) == [] and quality.train([]) == (quality.PRIOR, quality.COUPLING)
