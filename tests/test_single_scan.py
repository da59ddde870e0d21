"""What is left out follows from one reading of the files; lines are made by all tasks."""

from ledgerlight import registry
from ledgerlight.sources import logs


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_left_out_reads_files_once(spark, tmp_path):
    body = [f"line-{i:04}".encode() for i in range(400)]
    body[222] = b"line-\xff"
    body[333] = b"line-\xfe"
    (tmp_path / "s.jsonl").write_bytes(b"\n".join(body) + b"\n")
    (tmp_path / "t.jsonl").write_bytes(b"\n".join(body[:200]) + b"\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        listed = spark.createDataFrame([(f"file:{tmp_path}/{n}.jsonl",) for n in "tu"], "file string")
        missed = logs.left_out(spark, str(tmp_path), listed)
        assert plan(missed).count("Relation [value") == 1
        assert {(r.file.rsplit("/", 1)[1], r.reason, r.lines) for r in missed.collect()} == {("s.jsonl", "invalid", 178), ("u.jsonl", "unread", None)}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_lines_are_made_by_all_tasks(spark):
    assert "RepartitionByExpression" in plan(registry._as_lines(spark, "/root/testdata/sf0.001"))
