"""JSONL session logs: discovery, strict parsing, events."""

from __future__ import annotations

import json
import os
import re
from functools import reduce
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlight.functions.lines import diff_counts, patch_lines
from ledgerlight.functions.pricing import compute_cost
from ledgerlight.functions.scalars import effective_root
from ledgerlight.schema import MEASURES, RAW, SOURCES, struct
from pyspark.sql import types as T

HEAD_LINES = 31
#: RFC 3339 with an offset.
INSTANT = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
COUNTERS = ["input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens"]


def find_roots(home: str | Path) -> list[Path]:
    """Log roots of a home directory, in order of preference, each once."""
    home = Path(home)
    found = [home / ".config" / "claude" / "projects", home / ".claude" / "projects"]
    try:
        found += [d / "projects" for d in sorted(home.iterdir()) if d.name.startswith(".") and "claude" in d.name]
    except OSError:
        pass
    return [p for p in dict.fromkeys(found) if p.is_dir()]


def session_files(folder: Path) -> list[Path]:
    return sorted(p for p in folder.rglob("*.jsonl") if p.is_file())


def head_cwd(path: Path) -> str | None:
    """The cwd of the first user line among a file's first lines; None on a read error."""
    try:
        with path.open(encoding="utf-8") as f:
            for _, line in zip(range(HEAD_LINES), f, strict=False):
                if '"cwd"' not in line:
                    continue
                try:
                    row = json.loads(line)
                except ValueError:
                    continue
                if isinstance(row, dict) and row.get("type") == "user" and isinstance(row.get("cwd"), str):
                    return row["cwd"]
    except (OSError, UnicodeDecodeError):
        pass
    return None


def discover(spark: SparkSession, roots: list[Path]) -> DataFrame:
    """seq, dir_name, path, session_files, cwd, source_root: a row per directory with logs."""
    rows = []
    for root in roots:
        try:
            folders = sorted(d for d in root.iterdir() if d.is_dir())
        except OSError:
            continue
        for d in folders:
            files = session_files(d)
            if files:
                cwd = next((c for c in map(head_cwd, files) if c is not None), None)
                rows.append((len(rows), d.name, str(d), [os.fspath(f) for f in files], cwd, str(root)))
    return spark.createDataFrame(rows, T.StructType([T.StructField("seq", T.LongType()), *SOURCES.fields]))


def read_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """value, session_file of every line below ``paths``."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(paths)
    return raw.select("value", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("session_file"))


def instant(text: Column) -> Column:
    return F.when(text.rlike(INSTANT), F.try_to_timestamp(F.upper(text)))


#: What stands behind the object when a line is wrapped in an array; nothing else may.
_END = "end of line"
STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def _twice(obj: Column, kind: T.StructType) -> Column:
    """Whether the JSON object has a declared field twice, at any declared depth; other fields may."""

    def of(c: Column, t: T.DataType) -> Column | None:
        if isinstance(t, T.StructType):
            return _twice(c, t)
        if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType):
            return F.exists(F.from_json(c, "array<string>"), lambda x: _twice(x, t.elementType))
        return None

    keys = F.filter(F.json_object_keys(obj), lambda k: k.isin(kind.names))
    found = [F.size(keys) > F.size(F.array_distinct(keys))]
    found += [x for f in kind.fields if (x := of(F.get_json_object(obj, f"$.{f.name}"), f.dataType)) is not None]
    return reduce(Column.__or__, [F.coalesce(x, F.lit(False)) for x in found])


def strict(value: Column) -> Column:
    """Whether a line is one JSON object with nothing behind it and no declared field twice.

    One strict reading of the wrapped line tells nearly all lines: it refuses every doubled field. What it
    refuses is looked at again, as a field that is not declared may be doubled.
    """
    wrapped = F.concat(F.lit("["), value, F.lit(f',"{_END}"]'))
    v = F.try_parse_json(wrapped)
    plain = F.coalesce((F.try_variant_get(v, "$[1]", "string") == _END) & F.try_variant_get(v, "$[2]", "variant").isNull(), F.lit(False))
    alone = F.size(F.from_json(wrapped, "array<string>", STRICT)) == 2
    return F.when(v.isNotNull(), plain).otherwise(F.coalesce(alone, F.lit(False)) & ~_twice(value, RAW))


def parse(lines: DataFrame) -> DataFrame:
    """Events of ``lines`` (value, session_file): a line of a wrong shape or type is dropped whole, as is one with text behind its object or a declared field twice.

    One pass: the narrow schema is all that is decoded, and each line once. Decoded fields and line
    counts leave through generators, below which no later filter or column can be pushed
    and evaluated again.
    """
    schema = T.StructType([*RAW.fields, T.StructField("_corrupt", T.StringType())])
    decoded = F.from_json("value", schema, STRICT | {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    j = lines.where(F.trim("value") != "").select("session_file", "value", F.inline(F.array(decoded)))
    usage, r = F.col("message.usage"), F.col("toolUseResult")
    zero = F.lit(0).cast("bigint")
    said = (F.col("type") == "assistant") & usage.isNotNull()
    used = (F.col("type") == "user") & r["structuredPatch"].isNotNull()
    sound = F.lit(True)
    for c in COUNTERS:
        sound = sound & (F.coalesce(usage[c], zero) >= 0)
    # The sieve asks for decoded fields, so that it stays above the generator and sees only lines that count.
    j = j.where(F.when(F.col("_corrupt").isNull() & (said | used) & sound, strict(F.col("value"))).otherwise(F.lit(False)))
    # What an edit or a patch changed: added, deleted, and whether it was a whole file.
    counts = "struct<added:bigint,deleted:bigint,whole:boolean>"
    edits = F.filter(F.coalesce(F.col("message.content"), F.array().cast(RAW["message"].dataType["content"].dataType)), lambda b: (b["type"] == "tool_use") & (b["name"] == "Edit") & b["input"].isNotNull())
    diffs = F.transform(edits, lambda b: diff_counts(b["input"]["old_string"], b["input"]["new_string"]))
    none = F.struct(zero.alias("added"), zero.alias("removed"))
    edited = F.aggregate(diffs, none, lambda acc, x: F.struct((acc["added"] + x["added"]).alias("added"), (acc["removed"] + x["removed"]).alias("removed")), lambda acc: F.struct(acc["added"], acc["removed"], F.lit(False)).cast(counts))
    whole = r["oldString"].isNull() & r["content"].isNotNull()
    plus, minus = patch_lines(r["structuredPatch"], "+"), patch_lines(r["structuredPatch"], "-")
    change = F.when(plus + minus > 0, F.when(whole, F.transform(F.array(diff_counts(r["originalFile"], r["content"])), lambda x: F.struct(x["added"], x["removed"], F.lit(True)).cast(counts))[0]).otherwise(F.struct(plus, minus, F.lit(False)).cast(counts)))
    kept = ["session_file", instant(F.col("timestamp")).alias("ts"), "costUSD", F.coalesce(F.col("message.model"), F.lit("")).alias("model"), said.alias("said"), usage.alias("usage")]
    e = j.select(*kept, F.inline(F.array(F.when(said, edited).otherwise(change)))).where("ts IS NOT NULL AND added IS NOT NULL")
    of = [F.when(F.col("said"), F.coalesce(F.col("usage")[c], zero)).otherwise(zero) for c in COUNTERS]
    done = F.col("added") + F.col("deleted")
    return e.select(
        "ts", F.when(F.col("said"), F.col("model")).otherwise("").alias("model"), *[x.alias(m) for x, m in zip(of, MEASURES[:4], strict=True)],
        F.when(F.col("said"), compute_cost(F.col("model"), F.col("costUSD"), *of[:3])).otherwise(F.lit(0.0)).alias("cost"),
        F.when(F.col("said") | F.col("whole"), done).otherwise(zero).alias("suggested"), F.when(F.col("said"), zero).otherwise(done).alias("accepted"), "added", "deleted", "session_file",
    )


def tolerant_lines(spark: SparkSession, paths: str | list[str], pattern: str = "*.jsonl") -> DataFrame:
    """value, session_file, file of every line that can be read.

    A file that is gone or can't be read any further keeps the lines before that, and one with bytes that are no UTF-8
    those before the first such line, as a reader would that goes through it line by line. Lines are compared by the split they
    stand in and their order there; only the first bad line of a file is kept for that, so no file is held whole.
    """
    texts = _texts(spark, paths, pattern, tolerant=True)
    bad = survey(texts).where("bad IS NOT NULL").select(F.col("file").alias("f"), "bad")
    kept = texts.join(bad, texts["file"] == bad["f"], "left").where(F.col("bad").isNull() | (F.struct("block", "at") < F.col("bad")))
    return kept.select("value", F.element_at(F.split("file", "/"), -1).alias("session_file"), "file")


def survey(texts: DataFrame) -> DataFrame:
    """file, bad (block, at of the first line that is no UTF-8, or null), lines (from that one on) of every file of which a line came; ``texts`` is read once."""
    wrong = F.min(F.when(~F.is_valid_utf8("value"), F.struct("block", "at")))
    splits = texts.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"), wrong.alias("own"))
    cut = splits.withColumn("bad", F.min("own").over(W.partitionBy("file")))
    after = F.when(F.col("block") > F.col("bad.block"), F.col("n")).when(F.col("block") == F.col("bad.block"), F.col("n") - (F.col("bad.at") - F.col("first"))).otherwise(0)
    return cut.groupBy("file").agg(F.min("bad").alias("bad"), F.sum(after).alias("lines"))


def left_out(spark: SparkSession, paths: str | list[str], listed: DataFrame, pattern: str = "*.jsonl") -> DataFrame:
    """file, reason (``unread``: no line of it came; ``invalid``: cut at a line that is no UTF-8), lines (left out; null for unread ones).

    ``listed`` has the column file: the URLs of the files that should be there, as ``_metadata.file_path`` gives them.
    The files are read once: what is left out follows from a row per split.
    """
    seen = survey(_texts(spark, paths, pattern, tolerant=True)).select(F.col("file").alias("f"), "bad", "lines")
    # Of files that came but are not listed, those that are cut are told too.
    both = listed.select("file").distinct().join(seen, F.col("file") == F.col("f"), "full").where("f IS NULL OR bad IS NOT NULL")
    return both.select(F.coalesce("file", "f").alias("file"), F.when(F.col("f").isNull(), "unread").otherwise("invalid").alias("reason"), "lines")


def read_events(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    return parse(read_lines(spark, paths))


#: ``cwd`` as a variant: a number is not taken for its text.
_HEAD = "type string, cwd variant"


def _texts(spark: SparkSession, paths: str | list[str], pattern: str, tolerant: bool = False) -> DataFrame:
    """file, block, at, value: lines with the split they stand in; ``at`` grows by one a line within it.

    ``tolerant``: files that vanish or break while they are read give what was read.
    """
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    lenient = str(tolerant).lower()
    raw = spark.read.options(recursiveFileLookup="true", pathGlobFilter=pattern, ignoreMissingFiles=lenient, ignoreCorruptFiles=lenient).text(paths)
    return raw.select(*meta, "value", F.monotonically_increasing_id().alias("at"))


def first_cwds(texts: DataFrame) -> DataFrame:
    """file, line, cwd: the first user line with a cwd among each file's first lines.

    A file may be split; lines of a split are numbered in the order
    they are read, and a row per split gives the lines before it, so no file is held whole.
    """
    head = F.when(F.contains("value", F.lit('"cwd"')), F.from_json("value", _HEAD))
    user = (F.col("type") == "user") & (F.schema_of_variant("cwd") == "STRING")
    hit = F.min(F.when(user, F.struct("at", F.try_variant_get("cwd", "$", "string").alias("cwd"))))
    splits = texts.select("file", "block", "at", F.inline(F.array(head))).groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"), hit.alias("hit"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    found = splits.withColumn("line", before + F.col("hit.at") - F.col("first")).where(F.col("line") < HEAD_LINES)
    return found.groupBy("file").agg(F.min("line").alias("line"), F.min_by("hit.cwd", "line").alias("cwd"))


def cwd_by_source(spark: SparkSession, root: str) -> DataFrame:
    """path, cwd by Spark alone: the first user cwd of each directory's first file with one. For roots on a shared store."""
    found = first_cwds(_texts(spark, root, "*.jsonl"))
    folder = F.regexp_extract("file", "^(" + root.rstrip("/").replace("\\", "\\\\") + "/[^/]+)/", 1) if "://" in root else F.regexp_extract("file", r"^(.*" + root.rstrip("/") + "/[^/]+)/", 1)
    return found.groupBy(folder.alias("path")).agg(F.min_by("cwd", F.struct("file", "line")).alias("cwd"))


#: The log roots below a home directory, as a glob that Hadoop file systems expand.
ROOTS = "{.config/claude,.*claude*}/projects"
FILES = struct(source_root=T.StringType(), rank=T.IntegerType(), dir_name=T.StringType(), path=T.StringType(), file=T.StringType(), place=T.StringType(), own_cwd=T.StringType())


def log_files(spark: SparkSession, home: str, pattern: str = "*.jsonl") -> DataFrame:
    """A row per log file below a home directory on any store that Spark reads; no rows where there is no root.

    source_root, rank (0 and 1: the two preferred roots, 2: others), dir_name and path of the directory
    below the root, file, place (orders files by the names along their paths), own_cwd (the cwd in the file's own head).

    Spark lists the files, in parallel, and reads the heads; nothing passes the driver but that listing.
    Files that vanish meanwhile are left out. Spark leaves out files of no bytes and names that begin with a dot or an underscore below a root.
    """
    at = f"{home.rstrip('/')}/{ROOTS}"
    try:
        listed = spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter=pattern, ignoreMissingFiles="true").load(at).select("path", F.col("_metadata.file_path").alias("file_url"))
        heads = first_cwds(_texts(spark, at, pattern, tolerant=True))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], FILES)
    name = F.regexp_replace("path", "^file:/+", "/")
    root = r"^(/(\.config/claude|\.[^/]*claude[^/]*)/projects)/([^/]+)/.+"
    tail = F.substring("name", len(re.sub("^file:/+", "/", home.rstrip("/"))) + 1, 1 << 30)  # the home itself may hold such names
    rows = listed.withColumn("name", name).withColumn("tail", tail).where(F.rlike("tail", F.lit(root)))
    rows = rows.withColumn("base", F.substring("name", 1, len(re.sub("^file:/+", "/", home.rstrip("/")))))
    part = {i: F.regexp_extract("tail", root, i) for i in (1, 2, 3)}
    rows = rows.select(
        F.concat("base", part[1]).alias("source_root"), F.when(part[2] == ".config/claude", 0).when(part[2] == ".claude", 1).otherwise(2).alias("rank"), part[3].alias("dir_name"),
        F.concat("base", part[1], F.lit("/"), part[3]).alias("path"), F.col("name").alias("file"), F.translate("name", "/", "\x01").alias("place"), "file_url",
    )
    return rows.join(heads.select(F.col("file").alias("file_url"), F.col("cwd").alias("own_cwd")), "file_url", "left").select(FILES.names)


_DIRECTORY = ["rank", "source_root", "dir_name", "path"]


def directory_cwds(files: DataFrame) -> DataFrame:
    """A row per directory with logs: cwd (of its first file that has one), n_files."""
    first = F.min_by("own_cwd", F.when(F.col("own_cwd").isNotNull(), F.col("place")))
    return files.groupBy(*_DIRECTORY).agg(first.alias("cwd"), F.count("*").alias("n_files"))


def session_map_of_files(files: DataFrame) -> DataFrame:
    """session_file, root, cwd of all log files; of equal names the last directory's. No directory's files meet in one row."""
    of = files.join(directory_cwds(files).select("path", "cwd"), "path").withColumn("cwd", effective_root(F.col("cwd"), F.col("path")))
    last = F.max_by(F.struct("source_root", "cwd"), F.struct("rank", "source_root", "dir_name", "place"))
    return of.groupBy(F.element_at(F.split("file", "/"), -1).alias("session_file")).agg(last.alias("x")).select("session_file", F.col("x.source_root").alias("root"), F.col("x.cwd").alias("cwd"))


def sources_of_files(files: DataFrame) -> DataFrame:
    """The rows of ``discover`` from log files: seq follows roots and directory names and has gaps."""
    first = F.min_by("own_cwd", F.when(F.col("own_cwd").isNotNull(), F.col("place")))
    own = F.transform(F.array_sort(F.collect_list(F.struct("place", "file"))), lambda x: x["file"])
    rows = files.groupBy(*_DIRECTORY).agg(own.alias("session_files"), first.alias("cwd"))
    return rows.orderBy("rank", "source_root", "dir_name").select(F.monotonically_increasing_id().alias("seq"), *SOURCES.names)
