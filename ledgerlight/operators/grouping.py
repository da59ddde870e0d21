"""Groups of log directories by repository identity."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlight.functions.scalars import effective_root, group_name

#: cwd -> (root path, remote URL or None)
Resolver = Callable[[str], tuple[str, str | None]]


def cut_worktree(path: str) -> str:
    for mark in ("/worktrees/", "/Worktrees/"):
        if mark in path:
            return path.split(mark, 1)[0]
    return path


def git_root(path: Path) -> Path | None:
    """The nearest ancestor with ``.git``; a worktree's link leads to its main repository."""
    for p in (path, *path.parents):
        mark = p / ".git"
        # os.path, as folders that may not be read hold no mark.
        if os.path.isdir(mark):
            return p
        if os.path.isfile(mark):
            text = mark.read_text().strip()
            if text.startswith("gitdir:"):
                linked = (p / text.removeprefix("gitdir:").strip()).resolve()
                return linked.parents[2] if len(linked.parents) > 2 else p
            return p
    return None


def only_git_child(path: Path) -> Path | None:
    found = [c for c in path.iterdir() if c.is_dir() and os.path.exists(c / ".git")]
    return found[0] if len(found) == 1 else None


def origin_url(root: Path) -> str | None:
    """The URL of a repository's remote named origin; None without git, a repository or a remote."""
    try:
        run = subprocess.run(["git", "-C", str(root), "remote", "get-url", "origin"], capture_output=True, text=True, timeout=10, check=False)
    except (OSError, subprocess.SubprocessError):
        return None
    return run.stdout.strip() or None if run.returncode == 0 else None


def resolve_identity(cwd: str, remote_of: Callable[[Path], str | None] = origin_url) -> tuple[str, str | None]:
    """Root and remote of a directory, also of one that no longer exists."""
    here = Path(cwd)
    near = next((p for p in (here, *here.parents) if p.is_dir()), None)
    if near is None or (near != here and near == Path(near.anchor)):
        return cut_worktree(cwd), None
    root = git_root(near) or only_git_child(near)
    if root is None:
        return cwd, None
    return str(root), remote_of(root)


def identities(sources: DataFrame, resolve: Resolver) -> DataFrame:
    """cwd, root_path, remote_url: each distinct cwd is resolved once, on the driver.

    The rows are log directories, not events: as many as directories on one machine.
    """
    spark = sources.sparkSession
    cwds = [r.cwd for r in sources.where("cwd IS NOT NULL").select("cwd").distinct().toLocalIterator()]
    return spark.createDataFrame([(c, *resolve(c)) for c in cwds], "cwd string, root_path string, remote_url string")


def group_by_identity(sources: DataFrame, ids: DataFrame, home: str = "") -> DataFrame:
    """root_key, name, remote_url, cwds, sources, sessions, pos (by lower-case name).

    ``sources`` has seq, its order of discovery. Roots with one remote URL share the
    shortest root; sources with one cwd are one source; sources without a cwd stay apart.
    """
    s = sources.join(ids, "cwd", "left").withColumn("root_path", F.coalesce("root_path", "path"))
    best = s.where("remote_url IS NOT NULL").groupBy("remote_url").agg(F.min_by("root_path", F.struct(F.octet_length("root_path").alias("n"), "seq")).alias("canonical"))
    s = s.join(best, "remote_url", "left").withColumn("root_key", F.coalesce("canonical", "root_path"))
    one = F.coalesce(F.concat(F.lit("c"), "cwd"), F.concat(F.lit("n"), F.col("seq").cast("string")))
    merged = s.groupBy("root_key", one.alias("one")).agg(
        F.min("seq").alias("seq"), F.min_by("dir_name", "seq").alias("dir_name"), F.min_by("path", "seq").alias("path"), F.min_by("cwd", "seq").alias("cwd"),
        F.min_by("source_root", "seq").alias("source_root"), F.array_sort(F.flatten(F.collect_list("session_files"))).alias("session_files"), F.min_by("remote_url", "seq").alias("remote_url"),
    )
    packed = F.array_sort(F.collect_list(F.struct("seq", "dir_name", "path", "cwd", "source_root", "session_files")))
    g = merged.groupBy("root_key").agg(F.min_by("remote_url", "seq").alias("remote_url"), packed.alias("sources"), F.sum(F.size("session_files")).cast("bigint").alias("sessions"))
    g = g.withColumn("name", group_name(F.col("root_key"), home)).withColumn("cwds", F.filter(F.transform("sources", lambda x: x["cwd"]), lambda x: x.isNotNull()))
    return with_pos(g)


def with_pos(groups: DataFrame) -> DataFrame:
    """Groups are few (a row per project); their order is by lower-case name."""
    return groups.withColumn("pos", F.row_number().over(W.orderBy(F.lower("name"), "root_key")) - 1)


def session_map(sources: DataFrame) -> DataFrame:
    """session_file, root, cwd: keyed by file name; of equal names the last source holds it."""
    files = sources.select("seq", "source_root", effective_root(F.col("cwd"), F.col("path")).alias("cwd"), F.posexplode("session_files").alias("i", "file"))
    name = F.element_at(F.split("file", "/"), -1)
    last = F.max_by(F.struct("source_root", "cwd"), F.struct("seq", "i")).alias("x")
    return files.groupBy(name.alias("session_file")).agg(last).select("session_file", F.col("x.source_root").alias("root"), F.col("x.cwd").alias("cwd"))


def search(groups: DataFrame, query: str) -> DataFrame:
    """Groups whose name holds ``query``, whatever the case."""
    return groups.where(F.contains(F.lower("name"), F.lower(F.lit(query)))) if query else groups
