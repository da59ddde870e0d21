"""Repository identities as a closure join.

Facts about directories are tables: which exist, which hold ``.git`` (and, where that is a file, the repository
it leads to), and what the remote named origin of a repository is. Every distinct cwd meets its own ancestors, the nearest fact
wins, and no directory is looked at one by one. The tables may come from any store; ``local_facts`` takes
them from this machine's file system, each ancestor once and without a git process.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.functions.scalars import heuristic_root

DIRS = "path string"
MARKS = "path string, leads_to string"
REMOTES = "path string, url string"


def parent(path: Column) -> Column:
    """The directory above; that of the root is the root."""
    up = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(up == "", F.lit("/")).otherwise(up)


def plain_path(path: Column) -> Column:
    """A path without doubled, trailing and ``.`` parts, as path objects have it."""
    parts = F.filter(F.split(path, "/"), lambda x, i: (x != "") & (x != "."))
    return F.when(path.startswith("/"), F.concat(F.lit("/"), F.array_join(parts, "/"))).otherwise(F.array_join(parts, "/"))


def ancestors(path: Column) -> Column:
    """An absolute path and all directories above it, the root first."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, k), "/")))


def _nearest(rows: DataFrame, of: str, facts: DataFrame, value: Column, name: str) -> DataFrame:
    """rows with ``name``: the value of the nearest fact among the ancestors of ``of``, or null."""
    closure = rows.select(of).distinct().select(of, F.posexplode(ancestors(F.col(of))).alias("depth", "path"))
    hit = closure.join(facts, "path").groupBy(of).agg(F.max_by(value, "depth").alias(name))
    return rows.join(hit, of, "left")


def identities(cwds: DataFrame, dirs: DataFrame, marks: DataFrame, remotes: DataFrame) -> DataFrame:
    """cwd, root_path, remote_url of each distinct cwd.

    A cwd that is gone is resolved from the nearest directory above it that is there. The repository is the nearest one
    at or above that, where a worktree leads to its main repository, or else the only one just below it. Where there is
    none, the cwd is its own root; where nothing is left but the file system's root, the path before a worktree mark is.
    """
    c = cwds.select("cwd").where("cwd IS NOT NULL").distinct().withColumn("here", plain_path(F.col("cwd")))
    c = _nearest(c, "here", dirs.select("path").distinct().withColumn("there", F.col("path")), F.col("there"), "near")
    lost = F.col("near").isNull() | ((F.col("near") != F.col("here")) & (F.col("near") == "/"))
    m = marks.groupBy("path").agg(F.first("leads_to", ignorenulls=True).alias("leads_to"))
    c = _nearest(c, "near", m, F.coalesce("leads_to", "path"), "above")
    only = m.where("path <> '/'").groupBy(parent(F.col("path")).alias("near")).agg(F.count("*").alias("n"), F.min("path").alias("below")).where("n = 1").drop("n")
    c = c.join(only, "near", "left").withColumn("root", F.when(~lost, F.coalesce("above", "below")))
    c = c.join(remotes.select(F.col("path").alias("root"), "url"), "root", "left")
    path = F.coalesce("root", F.when(lost, heuristic_root(F.col("cwd"))).otherwise(F.col("cwd")))
    return c.select("cwd", path.alias("root_path"), F.col("url").alias("remote_url"))


def _link(folder: Path) -> str | None:
    """Where a worktree's ``.git`` file leads; None for any other file."""
    text = (folder / ".git").read_text().strip()
    if not text.startswith("gitdir:"):
        return None
    linked = (folder / text.removeprefix("gitdir:").strip()).resolve()
    return str(linked.parents[2]) if len(linked.parents) > 2 else None


def _origin(repository: Path) -> str | None:
    """The URL of the remote named origin in a repository's own configuration."""
    try:
        text = (repository / ".git" / "config").read_text()
    except OSError:
        return None
    own = re.search(r'^\s*\[remote "origin"\]\s*$(.*?)(?=^\s*\[|\Z)', text, re.MULTILINE | re.DOTALL)
    url = own and re.search(r"^\s*url\s*=\s*(.+?)\s*$", own[1], re.MULTILINE)
    return url[1] if url else None


def local_facts(spark: SparkSession, cwds: Iterable[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(dirs, marks, remotes) for directories on this machine: each of them, what is above and what is just below is looked at once."""
    there = {p for c in cwds for p in (Path(c), *Path(c).parents) if p.is_dir()}
    near = {next(p for p in (Path(c), *Path(c).parents) if p.is_dir()) for c in cwds if Path(c).is_absolute()}
    looked = there | {child for p in near for child in p.iterdir() if child.is_dir()}
    # os.path, as folders that may not be read hold no mark.
    marks = {p: None if os.path.isdir(p / ".git") else _link(p) for p in looked if os.path.exists(p / ".git")}
    roots = {Path(to) if to else p for p, to in marks.items()}
    remotes = [(str(p), url) for p in roots if (url := _origin(p))]
    frame = spark.createDataFrame
    return frame([(str(p),) for p in there], DIRS), frame([(str(p), to) for p, to in marks.items()], MARKS), frame(remotes, REMOTES)
