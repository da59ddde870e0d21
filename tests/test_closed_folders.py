"""Folders that may not be looked into are no repositories and stop nothing."""

import os

from ledgerlight.operators import repositories
from ledgerlight.operators.grouping import git_root, only_git_child


def test_closed_folders_hold_no_mark(spark, tmp_path, monkeypatch):
    (tmp_path / "shut").mkdir()
    (tmp_path / "open" / ".git").mkdir(parents=True)
    real = os.stat

    def stat(path, *a, **k):
        if isinstance(path, (str, os.PathLike)) and "/shut/" in os.fspath(path):
            raise PermissionError(13, "Permission denied", os.fspath(path))
        return real(path, *a, **k)

    monkeypatch.setattr(os, "stat", stat)
    closed = lambda f: lambda p: False if "/shut/" in os.fspath(p) else f(p)  # noqa: E731  these may not go through os.stat
    for name in ("exists", "isdir", "isfile"):
        monkeypatch.setattr(os.path, name, closed(getattr(os.path, name)))
    dirs, marks, _ = repositories.local_facts(spark, [str(tmp_path)])
    assert str(tmp_path / "open") in {r.path for r in marks.collect()} and str(tmp_path / "shut") not in {r.path for r in marks.collect()}
    assert only_git_child(tmp_path) == tmp_path / "open"
    assert git_root(tmp_path / "shut") != tmp_path / "shut"
