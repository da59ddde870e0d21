"""Benchmark decontamination (native): a prefix-filtered set join.

A window is 13 consecutive item words (all words of a shorter item). Windows are
sets of positioned shingles of up to three words; full containment needs every
shingle, so one prefix shingle per window is enough, and the rarest is taken. Steps:

1. Count the benchmark's shingles in the corpus: each text is cut into words once, every
   position's shingle hash meets a blocked Bloom filter of the benchmark's in generated code,
   and only what passes is counted, combined before the shuffle. This gives the order by rarity.
2. A window with a shingle that never occurs can't occur. Of the others only the rarest
   shingle's hash goes into a second filter; the positions that pass it keep the
   words around them, nothing else of the texts is written.
3. These candidates join the windows by prefix hash, are bounded by the prefix's offset
   and the document's length (start >= 0, start + len <= n_words), and are
   verified by comparing all words of the item-sized window.

Filters grow with what they hold and only save work: hashes that pass by chance, or collide,
fail in step 3. Up to ``BLOCKS`` words are a literal in generated code; larger filters are a table
of words, at most ``MOST_BLOCKS``, met by a broadcast hash join on the word's place. Windows are broadcast only under the counted
``BROADCAST_WINDOWS``; beyond that the same join shuffles.

Edge cases: null and word-less texts have no words and are never contaminated;
items without words match nothing; rows that share doc_id and text get the same
result each; extra columns are ignored; empty tables give empty or clean results.
Very long texts are one row with as many candidates as they have prefix occurrences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlight.llm.common import ascii_lower, fingerprint, stored

WINDOW = 13
SHINGLE = 3
#: Broadcast bound of prefix windows (each at most a window's words) and of row ids.
BROADCAST_WINDOWS = 100_000
BROADCAST_IDS = 500_000
#: 64-bit words of a filter: most in a literal, most in all (some 100 MB as a broadcast), and bits aimed at for each hash it holds.
BLOCKS = 1 << 15
MOST_BLOCKS = 1 << 21
BITS_EACH = 32
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    # Texts of one byte a character take the short way to the same lower case.
    low = F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(ascii_lower(t))
    return F.array_remove(F.split(low, SEPARATORS), "")


def lanes(w: Column, k: int) -> Column:
    """Struct (w0..) of ``k`` neighbouring words at each position, and one after the last whose w0 is null."""
    # Plain array functions: they stay in generated code, where lambdas would not.
    return F.arrays_zip(*[(F.array_append(w, F.lit(None)) if j == 0 else F.slice(w, j + 1, F.size(w))).alias(f"w{j}") for j in range(k)])


def lane_hash(lane: str, k: int) -> Column:
    return F.xxhash64(F.lit(k), *[F.col(f"{lane}.w{j}") for j in range(k)])


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, key (the window's words), len, win: one row per window of each item."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.size("w")
    starts = F.sequence(F.lit(1), F.greatest(n - (window - 1), F.lit(1)))
    return items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("win")).select(
        "item_id", F.array_join("win", " ").alias("key"), F.size("win").alias("len"), "win"
    )


class HashFilter:
    """Blocked Bloom filter of 64-bit hashes: two bits in one word."""

    def __init__(self, hashes: DataFrame, count: int) -> None:
        self.blocks = 1
        while self.blocks < MOST_BLOCKS and 64 * self.blocks < BITS_EACH * count:
            self.blocks *= 2
        h = F.col("h")
        rows = hashes.groupBy(self.block(h).alias("b")).agg(F.bit_or(self.mask(h)).alias("m"))
        self.table = stored(rows, "filter") if self.blocks > BLOCKS else None
        self.words = [0] * self.blocks if self.table is None else []
        if self.table is None:
            for r in rows.collect():  # a row per block
                self.words[r.b] = r.m

    def block(self, h: Column) -> Column:
        return F.shiftright(h, 12).bitwiseAND(F.lit(self.blocks - 1).cast("bigint")).cast("int")

    @staticmethod
    def mask(h: Column) -> Column:
        bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("bigint"), x.bitwiseAND(F.lit(63).cast("bigint")).cast("int"))
        return bit(h).bitwiseOR(bit(F.shiftright(h, 6)))

    def may_hold(self, h: Column) -> Column:
        table = F.expr("array(" + ",".join("-9223372036854775808" if w == -(2**63) else f"{w}L" for w in self.words) + ")")
        return F.bitwise_not(F.get(table, self.block(h))).bitwiseAND(self.mask(h)) == 0

    def marked(self, rows: DataFrame, h: Column) -> DataFrame:
        """``rows`` with ``wanted``: whether the filter may hold ``h``."""
        if self.table is None:
            return rows.withColumn("wanted", self.may_hold(h))
        met = rows.withColumn("b", self.block(h)).join(F.broadcast(self.table), "b", "left")  # at most MOST_BLOCKS words
        return met.withColumn("wanted", F.coalesce(F.bitwise_not("m").bitwiseAND(self.mask(h)) == 0, F.lit(False))).drop("b", "m")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row per document row."""
    return judged(docs, benchmark, window).drop("fp")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without its contaminated rows."""
    bad = stored(judged(docs, benchmark, window).where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("fp").alias("bad_fp")).distinct(), "contaminated")
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_IDS else bad
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]) & (fingerprint(docs["text"]) == bad["bad_fp"]), "left_anti")


def prefixes(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """key, len, win, k, off, h: each window that can occur with its rarest shingle; ``distinct`` has key, len, win."""
    sized = distinct.withColumn("k", F.least(F.col("len"), F.lit(SHINGLE)))
    parts = None
    for k in range(1, SHINGLE + 1):
        some = sized.where(F.col("k") == k).select("key", "k", "len", F.posexplode(lanes(F.col("win"), k)).alias("off", "lane")).where(F.col("off") <= F.col("len") - k)
        some = some.select("key", "k", "off", lane_hash("lane", k).alias("h"))
        parts = some if parts is None else parts.unionByName(some)
    parts = stored(parts, "shingles")
    vocabulary = parts.select("k", "h").distinct()
    sizes = {r.k: r.n for r in vocabulary.groupBy("k").agg(F.count("*").alias("n")).collect()}  # at most SHINGLE rows
    if not sizes:
        return sized.select("key", "len", "win", "k", F.lit(0).alias("off"), F.lit(0).cast("bigint").alias("h")).where(F.lit(False))
    seen = HashFilter(vocabulary.select("h"), sum(sizes.values()))
    cut = docs.select(words(F.col("text")).alias("w"))
    passed = None
    for k in sorted(sizes):
        h = lane_hash("lane", k)
        hit = seen.marked(cut.select(F.explode(lanes(F.col("w"), k)).alias("lane")).where(F.col("lane.w0").isNotNull()), h).where("wanted").select(h.alias("h"))
        passed = hit if passed is None else passed.unionByName(hit)
    freq = passed.groupBy("h").agg(F.count("*").alias("df"))
    # Rarity order; a shingle that never occurs rules its window out.
    ranked = parts.join(freq, "h", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rarest = ranked.groupBy("key", "k").agg(F.min(F.struct("df", "off", "h")).alias("p")).where("p.df > 0")
    return distinct.join(rarest, "key").select("key", "len", "win", "k", F.col("p.off").alias("off"), F.col("p.h").alias("h"))


def candidates(docs: DataFrame, prefix: DataFrame, window: int) -> DataFrame:
    """doc_id, fp, n_words, pos, h, at, ctx: occurrences of prefix shingles with the words around them (from ``at``).

    A row of ``docs`` also has one row without h, so that its words are counted in the same pass.
    """
    sizes = sorted(r.k for r in prefix.select("k").distinct().collect())  # at most SHINGLE rows
    hashes = prefix.select("h").distinct()
    rare = HashFilter(hashes, hashes.count())
    cut = docs.select("doc_id", fingerprint(F.col("text")).alias("fp"), words(F.col("text")).alias("w"))
    at, out = F.greatest(F.col("pos") - (window - 1), F.lit(0)), None
    for k in sizes or [1]:
        end, h = F.col("lane.w0").isNull(), lane_hash("lane", k)
        rows = cut.select("doc_id", "fp", "w", F.posexplode(lanes(F.col("w"), k)).alias("pos", "lane"))
        rows, wanted = rare.marked(rows, h) if sizes else rows.withColumn("wanted", F.lit(False)), F.col("wanted")
        rows = rows.where(end | wanted) if out is None else rows.where(~end & wanted)
        rows = rows.select("doc_id", "fp", F.size("w").cast("bigint").alias("n_words"), "pos", F.when(~end, h).alias("h"), at.alias("at"), F.when(~end, F.slice("w", at + 1, 2 * window)).alias("ctx"))
        out = rows if out is None else out.unionByName(rows)
    return out


def judged(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``contamination`` with fp, the fingerprint that tells rows of one doc_id apart."""
    all_windows = stored(windows(benchmark, window), "windows")
    prefix = stored(prefixes(docs, all_windows.select("key", "len", "win").dropDuplicates(["key"])), "prefixes")
    found = stored(candidates(docs, prefix, window), "candidates")
    near, rows = found.where("h IS NOT NULL"), found.where("h IS NULL").select("doc_id", "fp", "n_words")
    side = F.broadcast(prefix) if prefix.count() <= BROADCAST_WINDOWS else prefix
    start = F.col("pos") - F.col("off")
    bounded = near.join(side, "h").withColumn("start", start).where("start >= 0 AND start + len <= n_words")
    verified = bounded.where(F.slice("ctx", F.col("start") - F.col("at") + 1, F.col("len")) == F.col("win"))
    verified = stored(verified.select("doc_id", "fp", "key", "len", "start"), "verified")
    # Words inside any occurrence: merge intervals by their running end.
    by = W.partitionBy("doc_id", "fp").orderBy("start", "len").rowsBetween(W.unboundedPreceding, -1)
    end = F.col("start") + F.col("len")
    reach = F.coalesce(F.max(end).over(by), F.lit(0))
    hits = verified.select("doc_id", "fp", "start", "len").distinct().withColumn("new", F.greatest(end - F.greatest(F.col("start"), reach), F.lit(0)))
    hits = hits.groupBy("doc_id", "fp").agg(F.sum("new").alias("n_hit"))
    items = verified.select("doc_id", "fp", "key").distinct().join(all_windows.select("key", "item_id").distinct(), "key").select("doc_id", "fp", "item_id").distinct()
    items = items.groupBy("doc_id", "fp").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list(F.col("item_id").cast("string"))), ",").alias("ids"))
    of_doc = hits.join(items, (hits.fp == items.fp) & hits.doc_id.eqNullSafe(items.doc_id)).select(hits.doc_id, hits.fp, "n_hit", "n_items", "ids")
    joined = rows.join(of_doc, (rows.fp == of_doc.fp) & rows.doc_id.eqNullSafe(of_doc.doc_id), "left")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("bigint")
    return joined.select(
        rows.doc_id, rows.fp, "n_words", n_hit.alias("n_hit"), F.coalesce(F.col("n_items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce(F.col("ids"), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
