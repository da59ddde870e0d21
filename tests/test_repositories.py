"""Identities by joins against the resolver that walks the file system."""

import subprocess

from ledgerlight.operators import repositories
from ledgerlight.operators.grouping import resolve_identity


def repository(path, url=None):
    (path / ".git").mkdir(parents=True)
    if url:
        (path / ".git" / "config").write_text(f'[core]\n\tbare = false\n[remote "other"]\n\turl = no\n[remote "origin"]\n\tfetch = +refs\n\turl = {url}\n[branch "main"]\n\tremote = origin\n')


def url_of(root):
    return repositories._origin(root)


def test_joins_find_what_the_walk_finds(spark, tmp_path):
    w = tmp_path / "w"
    repository(w / "one", "git@h:one")
    repository(w / "one" / "inner", "git@h:inner")
    repository(w / "bare")
    (w / "one" / "a" / "b").mkdir(parents=True)
    (w / "one" / "inner" / "x").mkdir()
    (w / "only" / "left").mkdir(parents=True)
    repository(w / "only" / "repo", "git@h:only")
    repository(w / "two" / "r1", "git@h:r1")
    repository(w / "two" / "r2")
    (w / "tree").mkdir()
    (w / "one" / ".git" / "worktrees" / "t").mkdir(parents=True)
    (w / "tree" / ".git").write_text(f"gitdir: {w}/one/.git/worktrees/t\n")
    (w / "odd").mkdir()
    (w / "odd" / ".git").write_text("nothing of the kind\n")
    (w / "plain" / "deep").mkdir(parents=True)
    cwds = [str(w / p) for p in ("one", "one/a/b", "one/gone/deeper", "one/inner/x", "bare", "only", "only/left", "only/gone", "two", "two/r1", "two/r2/gone", "tree", "tree/gone", "odd", "plain/deep", "plain/gone/worktrees/x")]
    cwds += [str(w / "one") + "/", str(w) + "//one/./a", "/nowhere/at/all", "/nowhere/worktrees/x/y", "/gone/Worktrees/z"]
    want = {c: resolve_identity(c, url_of) for c in cwds}
    rows = spark.createDataFrame([(c,) for c in [*cwds, cwds[0], None]], "cwd string")
    got = {r.cwd: (r.root_path, r.remote_url) for r in repositories.identities(rows, *repositories.local_facts(spark, cwds)).collect()}
    assert got == want and len(got) == len(cwds)


def test_configuration_is_read_as_git_reads_it(tmp_path):
    for name, url in (("a", "git@h:a"), ("b", None)):
        subprocess.run(["git", "init", "-q", str(tmp_path / name)], check=True)
        if url:
            subprocess.run(["git", "-C", str(tmp_path / name), "remote", "add", "origin", url], check=True)
        assert repositories._origin(tmp_path / name) == url
