"""Learnt verdicts on rows that no fit has seen."""

import zlib

from pyspark.sql import functions as F

from ledgerlight.llm import quality, toxicity
from ledgerlight.llm.common import read

SF = "/root/testdata/sf0.1"


def test_toxicity_on_the_held_out_fold(spark):
    labels = read(spark, SF, "labels")
    marks = {r.doc_id: r.toxic for r in labels.collect()}
    docs = read(spark, SF, "documents").join(labels.select("doc_id"), "doc_id", "left_semi")
    got = [r for r in toxicity.score(docs, labels).collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)
    found = sum(r.predicted and marks[r.doc_id] for r in got)
    assert found >= 0.9 * sum(marks[r.doc_id] for r in got)
    assert found >= 0.95 * sum(r.predicted for r in got)


def test_quality_on_labels_kept_from_the_fit(spark):
    labels = read(spark, SF, "labels").where("quality IS NOT NULL")
    unseen = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    docs = read(spark, SF, "documents").join(labels.select("doc_id"), "doc_id", "left_semi")
    marks = {r.doc_id: r.quality for r in labels.where(unseen).collect()}
    got = [r for r in quality.quality(docs, labels.where(~unseen)).collect() if r.doc_id in marks and not r.base_failed]
    good, bad = [r.kept for r in got if marks[r.doc_id] == 1], [r.kept for r in got if marks[r.doc_id] == 0]
    assert len(good) > 100 and sum(good) >= 0.98 * len(good)
    assert len(bad) > 10 and sum(bad) <= 0.1 * len(bad)
    assert quality.quality(docs.limit(0), labels).count() == 0
    assert quality.quality(docs.limit(3), labels.limit(0)).count() == 3
