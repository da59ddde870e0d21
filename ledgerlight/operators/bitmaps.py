"""Active minutes as mergeable bitmaps.

A session's day is up to ``WORDS`` rows of ``WORD`` minutes each, one bit a minute; only words with
activity exist. Bitmaps merge by ``bit_or``, in any order and any number of times, so a replay changes
nothing, and batches need not be read again. What is asked of a day is read from the bits:
clusters are a closing of the bits (gaps shorter than ``gap`` filled), their union over sessions is an or, the
pooled form closes the or of the sessions, and a window inside a day is a mask.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlight.functions.timewin import Window
from ledgerlight.operators.activity import KEYS

WORD = 48
WORDS = 1440 // WORD
ALL = (1 << WORD) - 1
#: Gaps that a word and the ends of its neighbours can show in 64 bits.
MOST_GAP = (64 - WORD) // 2 + 1


def bitmaps(rows: DataFrame) -> DataFrame:
    """root, cwd, date, session, word, bits: from rows with root, cwd, date, session and minute."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("minute") % WORD).cast("int"))
    word = F.floor(F.col("minute") / WORD).cast("int")
    return rows.groupBy(*KEYS, "session", word.alias("word")).agg(F.bit_or(bit).alias("bits"))


def merged(*parts: DataFrame) -> DataFrame:
    """The bitmaps of all parts together."""
    names = [*KEYS, "session", "word", "bits"]
    both = reduce(DataFrame.unionByName, [p.select(names) for p in parts])
    return both.groupBy(names[:-1]).agg(F.bit_or("bits").alias("bits"))


def within(bits: DataFrame, w: Window) -> DataFrame:
    """Bitmaps of the minutes inside a window; words without any go."""
    out = bits.where(w.has_date(F.col("date")))
    if w.start_minute is None:
        return out
    before = F.lit(w.start_minute) - F.col("word") * WORD  # minutes of the word that lie before the window
    mask = F.call_function("shiftleft", F.lit(ALL).cast("bigint"), F.least(F.greatest(before, F.lit(0)), F.lit(WORD)).cast("int"))
    cut = F.when(F.col("date") == F.lit(w.start), F.col("bits").bitwiseAND(mask)).otherwise(F.col("bits"))
    return out.withColumn("bits", cut).where("bits <> 0")


def closed(bits: DataFrame, keys: list[str], gap: int = 5) -> DataFrame:
    """Bitmaps (a row per keys and word) with every hole filled whose ends are at most ``gap`` minutes apart.

    Bits are spread upwards by ``gap - 1`` and what then has a full run above stays. A hole never spans a
    whole word, so neighbours' ends suffice; windows hold the words of one day.
    """
    if not 1 <= gap <= MOST_GAP:
        raise ValueError(f"gaps of 1 to {MOST_GAP} minutes fit the words, not {gap}")
    k, zero = gap - 1, F.lit(0).cast("bigint")
    at = W.partitionBy(*keys).orderBy("word")
    before = F.when(F.lag("word").over(at) == F.col("word") - 1, F.lag("bits").over(at)).otherwise(zero)
    after = F.when(F.lead("word").over(at) == F.col("word") + 1, F.lead("bits").over(at)).otherwise(zero)
    wide = bits.withColumns({"before": before, "after": after})
    own = F.shiftrightunsigned("before", WORD - k).bitwiseOR(F.shiftleft("bits", k)).bitwiseOR(F.shiftleft(F.col("after").bitwiseAND((1 << k) - 1), WORD + k))
    wide = wide.withColumn("own", own)
    spread = reduce(Column.bitwiseOR, [F.shiftleft("own", i) for i in range(k + 1)])
    wide = wide.withColumn("spread", spread)
    left = reduce(Column.bitwiseAND, [F.shiftrightunsigned("spread", i) for i in range(k + 1)])
    return wide.select(*keys, "word", F.shiftrightunsigned(left, k).bitwiseAND(F.lit(ALL)).alias("bits"))


def _counted(bits: DataFrame) -> DataFrame:
    return bits.groupBy(*KEYS).agg(F.sum(F.bit_count("bits")).cast("bigint").alias("active_minutes"))


def active_minutes(bits: DataFrame, gap: int = 5) -> DataFrame:
    """root, cwd, date, active_minutes: clusters per session, then their union."""
    own = closed(bits, [*KEYS, "session"], gap)
    return _counted(own.groupBy(*KEYS, "word").agg(F.bit_or("bits").alias("bits")))


def pooled_active_minutes(bits: DataFrame, gap: int = 5) -> DataFrame:
    """The same with all sessions of a project's day pooled first."""
    pooled = bits.groupBy(*KEYS, "word").agg(F.bit_or("bits").alias("bits"))
    return _counted(closed(pooled, KEYS, gap))
