"""Line dedup tells rows apart that share a doc_id, or have none, and whose texts have equal 32-bit hashes."""

from pyspark.sql import functions as F

from ledgerlight.llm import linededup

ROWS = 120_000


def test_rows_without_doc_id_lose_nothing_of_their_own(spark):
    n = F.col("id").cast("string")
    text = F.array_join(F.transform(F.array(*map(F.lit, "uvwz")), lambda c: F.concat(c, n)), "\n")
    rows = spark.range(ROWS).select(F.lit(None).cast("long").alias("doc_id"), text.alias("text"))
    pairs = rows.groupBy(F.hash("text").alias("h")).agg(F.array_sort(F.collect_list("text")).alias("t")).where(F.size("t") > 1).select("t").collect()
    assert pairs  # so many rows hold texts of equal 32-bit hashes
    first = [r.t[0] for r in pairs]
    copies = spark.createDataFrame([(None, t.rsplit("\n", 1)[0] + "\n") for t in first], rows.schema)
    left = linededup.dedup_lines(rows.unionByName(copies)).where("n_removed > 0").select("text", "n_removed").collect()
    # Of a text and the three lines copied from it one loses these lines; nothing else loses any.
    assert len(left) == len(first) and {r.n_removed for r in left} == {3}
    assert {r.text for r in left} <= {t.rsplit("\n", 1)[1] for t in first} | {""}


def test_one_doc_id_and_the_least_one_are_names_like_others(spark):
    rows = [(5, "a b\nc d\ne f\ng h\n"), (5, "i j\nk l\nm n\no p\n"), (None, "a b\nc d\ne f\nq r\n"), (-(2**63), "i j\nk l\nm n\ns t\n"), (-(2**63), "u\nv\nw\nx\n"), (None, "u\nv\nw\nx\n")]
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.text) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = [(False, 0, "a b\nc d\ne f\nq r\n"), (False, 0, "u\nv\nw\nx\n"), (True, -(2**63), ""), (True, -(2**63), "i j\nk l\nm n\ns t\n"), (True, 5, "g h\n"), (True, 5, "o p\n")]
    assert got == want
