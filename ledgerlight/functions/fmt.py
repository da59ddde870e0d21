"""Labels: numbers, costs, durations, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fixed(x: Column, places: int) -> Column:
    """Half-even, without thousands separators."""
    return F.call_function("format_number", x.cast("double"), F.lit("0" if places == 0 else "0." + "0" * places))


def format_tokens(x: Column) -> Column:
    return F.when(x >= 1_000_000, F.concat(_fixed(x / 1e6, 1), F.lit("M"))).when(x >= 1000, F.concat(_fixed(x / 1e3, 1), F.lit("K"))).otherwise(x.cast("string"))


def format_axis_tokens(x: Column) -> Column:
    return F.when(x >= 1_000_000, F.concat(_fixed(x / 1e6, 1), F.lit("M"))).when(x >= 1000, F.concat(_fixed(x / 1e3, 0), F.lit("K"))).otherwise(_fixed(x, 0))


def format_cost(x: Column) -> Column:
    """Cards and axes: no decimals from 100, one from 10, else two."""
    return F.concat(F.lit("$"), F.when(x >= 100, _fixed(x, 0)).when(x >= 10, _fixed(x, 1)).otherwise(_fixed(x, 2)))


def format_kpi_cost(x: Column) -> Column:
    return F.concat(F.lit("$"), F.when(x >= 100, _fixed(x, 0)).otherwise(_fixed(x, 2)))


def format_duration(minutes: Column) -> Column:
    h, m = F.floor(minutes / 60).cast("string"), F.lpad((minutes % 60).cast("string"), 2, "0")
    return F.when(minutes >= 60, F.concat(h, F.lit("h"), m, F.lit("m"))).otherwise(F.concat(minutes.cast("string"), F.lit("m")))


def version_newer(latest: Column, current: Column) -> Column:
    """Three numeric parts compared in order; a part that is no number is 0."""

    def parts(v: Column) -> Column:
        return F.struct(*[F.coalesce(F.split_part(v, F.lit("."), F.lit(i)).try_cast("int"), F.lit(0)).alias(f"p{i}") for i in (1, 2, 3)])

    return parts(latest) > parts(current)


def month_abbrev(d: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()]), F.month(d))


def weekday_label(d: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in "Mo Tu We Th Fr Sa Su".split()]), F.weekday(d) + 1)


def truncate_label(s: Column, most: int) -> Column:
    """At most ``most`` bytes of UTF-8 before an ellipsis takes the place of one; no character is cut."""
    if most <= 1:
        return F.when(F.octet_length(s) <= most, s).when(s.isNotNull(), "…" if most == 1 else "")
    raw = s.cast("binary")

    def inside(n: int) -> Column:
        """The byte after the first ``n`` continues a character."""
        return F.hex(F.substr(raw, F.lit(n + 1), F.lit(1))).between("80", "BF")

    end = F.lit(max(0, most - 4))
    for n in range(max(0, most - 4) + 1, most):
        end = F.when(~inside(n), F.lit(n)).otherwise(end)
    return F.when(F.octet_length(s) <= most, s).otherwise(F.concat(F.substr(raw, F.lit(1), end).cast("string"), F.lit("…")))
