"""Discovery by Spark's own listing against discovery by the file system."""

import json

from ledgerlight.operators.grouping import session_map
from ledgerlight.sources import logs


def user(cwd, kind="user"):
    return json.dumps({"type": kind, "cwd": cwd})


def home_of(tmp_path):
    home = tmp_path / "u" / ".my-claude-home"  # the home's own path looks like a root
    files = {
        ".config/claude/projects/p a+b%/deep/s 1.jsonl": ["{}", user("/w/one")],
        ".config/claude/projects/p a+b%/late.jsonl": ["{}"] * 31 + [user("/w/late")],
        ".config/claude/projects/b/a.jsonl": [user("/w/b-file")],
        ".config/claude/projects/b/a/z.jsonl": [user("/w/b-deep")],
        ".claude/projects/-home-u/one.jsonl": ["{}"] * 30 + [user("/w/edge"), user("/w/second")],
        ".claude/projects/-home-u/two.jsonl": [user("/w/two")],
        ".claude/projects/x/same.jsonl": [user(5), user(None), user("/w/not", "assistant"), '{"cwd":"/w/broken"', user("/w/x")],
        ".claude/projects/x/note.txt": [user("/w/no")],
        ".claude/projects/loose.jsonl": [user("/w/loose")],
        ".old-claude/projects/y/same.jsonl": ["{}"],
        ".claude2/projects/y/only.jsonl": ["[1]"],
        ".other/projects/z/no.jsonl": [user("/w/no")],
        ".claude-less/z/no.jsonl": [user("/w/no")],
    }
    for name, lines in files.items():
        (home / name).parent.mkdir(parents=True, exist_ok=True)
        (home / name).write_text("\n".join(lines) + "\n")
    return home


def test_log_files_are_those_of_the_file_system(spark, tmp_path):
    home = home_of(tmp_path)
    want = logs.discover(spark, logs.find_roots(home))
    files = logs.log_files(spark, f"file://{home}")
    got = logs.sources_of_files(files)
    rows = lambda df: [tuple(r)[1:] for r in sorted(df.select("seq", "dir_name", "path", "session_files", "cwd", "source_root").collect())]
    assert rows(got) == rows(want) and len(rows(got)) == 6
    assert {r.cwd for r in want.collect()} == {"/w/one", "/w/b-deep", "/w/edge", "/w/x", None}
    assert sorted(map(tuple, logs.session_map_of_files(files).collect())) == sorted(map(tuple, session_map(want).collect()))
    assert {(r.path, r.cwd, r.n_files) for r in logs.directory_cwds(files).collect()} == {(r.path, r.cwd, len(r.session_files)) for r in want.collect()}


def test_a_split_file_counts_its_lines(spark, tmp_path):
    """Blocks of a few bytes: the cwd in line 31 counts, the one in line 32 doesn't."""
    home = tmp_path / "h"
    for name, n in (("in", 30), ("out", 31)):
        (home / f".claude/projects/{name}").mkdir(parents=True)
        (home / f".claude/projects/{name}/s.jsonl").write_text("\n".join(["{}"] * n + [user(f"/w/{name}"), "{}"]) + "\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        files = logs.log_files(spark, str(home))
        assert {(r.dir_name, r.cwd) for r in logs.directory_cwds(files).collect()} == {("in", "/w/in"), ("out", None)}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_no_root_is_no_rows(spark, tmp_path):
    files = logs.log_files(spark, str(tmp_path))
    assert files.count() == 0 and logs.session_map_of_files(files).count() == 0 and logs.sources_of_files(files).count() == 0
