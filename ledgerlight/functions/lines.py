"""Line counting: patches, edits and the multiset difference of two texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_lines(text: Column) -> Column:
    """Lines ended by LF or CRLF; no empty line after the last end; null is no line."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n", "\n"), "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def diff_counts(old: Column, new: Column) -> Column:
    """Struct (added, removed) of the multiset difference of two texts' lines.

    Both sides' lines are sorted together and read once: a line's net count is known when
    the next one differs.
    """
    zero = F.lit(0).cast("bigint")
    signed = lambda text, d: F.transform(text_lines(text), lambda x: F.struct(x.alias("line"), F.lit(d).cast("bigint").alias("d")))
    every = F.sort_array(F.concat(signed(new, 1), signed(old, -1)))
    start = F.struct(F.lit("").alias("line"), zero.alias("net"), zero.alias("added"), zero.alias("removed"))

    def step(acc: Column, x: Column) -> Column:
        same = acc["line"] == x["line"]
        done = lambda name, net: F.when(same, acc[name]).otherwise(acc[name] + F.greatest(net, zero)).alias(name)
        net = F.when(same, acc["net"] + x["d"]).otherwise(x["d"])
        return F.struct(x["line"].alias("line"), net.alias("net"), done("added", acc["net"]), done("removed", -acc["net"]))

    end = lambda acc: F.struct((acc["added"] + F.greatest(acc["net"], zero)).alias("added"), (acc["removed"] + F.greatest(-acc["net"], zero)).alias("removed"))
    return F.aggregate(every, start, step, end)


def count_diff_lines(old: Column, new: Column) -> tuple[Column, Column]:
    """(added, removed) for texts of a tool call; ``operators.diff`` scales to long texts."""
    d = diff_counts(old, new)
    return d["added"], d["removed"]


def patch_lines(patch: Column, sign: str) -> Column:
    """Lines over all hunks that start with ``sign``."""
    every = F.flatten(F.transform(patch, lambda h: F.coalesce(h["lines"], F.array().cast("array<string>"))))
    return F.size(F.filter(every, lambda x: x.startswith(sign))).cast("bigint")
