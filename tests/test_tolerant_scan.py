"""Files that vanish, break or hold bytes that are no text."""

import gzip
import os

from ledgerlight.sources import logs


def written(folder, **files):
    for name, data in files.items():
        (folder / f"{name}.jsonl").write_bytes(data)


def kept(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.session_file, []).append(r.value)
    return {k: sorted(v) for k, v in out.items()}


def test_lines_before_the_first_bad_one_stay(spark, tmp_path):
    written(tmp_path, good="a\né\n".encode(), bad=b"a\nb\n\xff\xfe\nc\nd\n", first=b"\xc3\nx\n", cut="x\ny\né".encode()[:-1], empty=b"", gone=b"q\n")
    listed = spark.createDataFrame([(f"file:{p}",) for p in tmp_path.iterdir()], "file string")
    lines, missed = logs.tolerant_lines(spark, str(tmp_path)), logs.left_out(spark, str(tmp_path), listed)
    os.remove(tmp_path / "gone.jsonl")
    assert kept(lines) == {"good.jsonl": ["a", "é"], "bad.jsonl": ["a", "b"], "cut.jsonl": ["x", "y"]}
    assert {(r.file.rsplit("/", 1)[1], r.reason, r.lines) for r in missed.collect()} == {("bad.jsonl", "invalid", 3), ("first.jsonl", "invalid", 2), ("cut.jsonl", "invalid", 1), ("gone.jsonl", "unread", None), ("empty.jsonl", "unread", None)}


def test_a_stream_that_breaks_keeps_what_was_read(spark, tmp_path):
    """Half of a compressed file: the lines that came out of it stay."""
    lines = [f"line {i} {os.urandom(40).hex()}" for i in range(40_000)]
    data = gzip.compress("\n".join(lines).encode())
    (tmp_path / "s.jsonl.gz").write_bytes(data[: len(data) // 2])
    got = [r.value for r in logs.tolerant_lines(spark, str(tmp_path), "*.gz").collect()]
    assert 1000 < len(got) < 40_000 and set(got[:1000]) <= set(lines)


def test_splits_are_cut_in_file_order(spark, tmp_path):
    body = [f"line-{i:04}".encode() for i in range(400)]
    body[222] = b"line-\xff"
    body[333] = b"line-\xfe"
    written(tmp_path, s=b"\n".join(body) + b"\n", t=b"\n".join(body[:200]) + b"\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        df = logs.tolerant_lines(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 2
        got = kept(df)
        assert got["s.jsonl"] == [b.decode() for b in body[:222]] and len(got["t.jsonl"]) == 200
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
