"""MinHash near-dedup: a signature-coordinate inverted join.

Documents with equal shingle sets are one class, under a generated long; only classes go
on, and the smallest doc_id of a component is looked up at the end. Each class is
posted under its ``COORDINATES`` (coordinate, value) pairs. Two classes at the
similarity threshold agree on ``MATCHES`` coordinates but for a chance of about 1e-6, and
classes that agree so often meet in their prefixes: of its coordinates shared with anyone,
ordered by the length of their lists, a class keeps all but the ``MATCHES - 1`` longest,
which are skipped. Collisions are then counted on whole signatures and links confirmed on
full shingle sets.

Lists are never turned into all pairs. First each member is paired with its list's
leader (the smallest id, then a member chosen by a hash); confirmed links give
components. Lists that still hold several components go through an exact rest: their
members are dealt into blocks bounded in members and in shingles, blocks that may hold a link across
components meet, and each meeting counts intersections by a matrix product and returns
only links that join components. In lists of several blocks the members are dealt by the size of
their sets first, and only blocks of the same or the next size meet: sets further apart can't reach the
threshold. Lists with the same members are done once, and lists with much the same members are merged before, as the copies
of one text share some twenty lists: a merged list holds every pair of its lists, and no more pairs than they do together.

Edge cases: null, empty and word-less texts have no shingles, stand alone and are
kept; a text of under five words is one shingle; exact copies and repeated rows share a
class; different texts may share a doc_id, each is judged by its own text; null doc_ids link
others but never name a component and are never kept beside a row that has one; in a component without any
doc_id ``near_duplicates`` marks all rows as kept and ``keep_one`` leaves one; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm import shingles as sh
from ledgerlight.llm.common import stored, tune
from ledgerlight.llm.components import components

WORDS = 5
PERCENT = 75
COORDINATES = 48
MATCHES = 22
BLOCK = 256
#: A block's sets hold so many shingles (of 8 bytes) on average at most, unless one set alone holds more.
BLOCK_SHINGLES = 1 << 21
#: Sizes are banded by powers of this number; above 100 / PERCENT, so that linked sets are a band apart at most.
BAND = 1.35
#: So many 8-byte ids may be broadcast to pick out the texts of candidates.
BROADCAST_IDS = 1_000_000
#: So often lists are merged, under another hash each time.
MERGES = 2
#: Columns of one step of the block product.
STEP = 16_384


def _name(text: Column) -> list[Column]:
    """(t1, t2): 128 bits that name a text, or the lack of one; with doc_id they tell rows apart."""
    parts = (F.coalesce(text, F.lit("")), text.isNull())
    return [F.xxhash64(*parts).alias("t1"), F.xxhash64(F.lit(7), *parts).alias("t2")]


def _same_row(a: str, b: str) -> Column:
    """Whether rows of the aliases ``a`` and ``b`` agree in t1, t2 and doc_id, nulls included."""
    col = lambda side, name: F.col(f"{side}.{name}")
    return (col(a, "t1") == col(b, "t1")) & (col(a, "t2") == col(b, "t2")) & col(a, "doc_id").eqNullSafe(col(b, "doc_id"))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, t1, t2, n, h1, h2 (the set's 128-bit name) and sig per row."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, h1, h2, sigs = [], [], [], []
            for t in b.column(3).cast(pa.binary()):
                s = sh.shingle_set(t.as_py() or b"", WORDS)
                n.append(len(s))
                m = sh.mix(s)
                h1.append(int(np.bitwise_xor.reduce(m) if len(s) else 0))
                h2.append(int(np.add.reduce(m * (s | np.uint64(1))) if len(s) else 0))
                sigs.append(sh.signature(s, COORDINATES) if len(s) else np.zeros(0, np.int32))
            signed = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n, pa.int64()), signed(h1), signed(h2), pa.array(sigs, pa.list_(pa.int32()))], names=["doc_id", "t1", "t2", "n", "h1", "h2", "sig"])

    return docs.select("doc_id", *_name(F.col("text")), "text").mapInArrow(run, "doc_id long, t1 long, t2 long, n long, h1 long, h2 long, sig array<int>")


def _sets(rows: DataFrame) -> DataFrame:
    """id, n, set (n sorted uint64, packed) of ``rows`` (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [sh.shingle_set(t.as_py() or b"", WORDS).tobytes() for t in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) // 8 for s in sets], pa.int64()), pa.array(sets, pa.binary())], names=["id", "n", "set"])

    return rows.select("id", "text").mapInArrow(run, "id long, n long, set binary")


def shingle_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, n, set of the documents whose doc_id is in ``ids`` (column id, distinct)."""
    few = ids.count() <= BROADCAST_IDS
    return _sets(docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(ids) if few else ids, "id", "left_semi"))


def class_sets(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """id, n, set of the classes in ``reps`` (id, doc_id, t1 and t2 of one row), one row each."""
    few = reps.count() <= BROADCAST_IDS
    r = (F.broadcast(reps) if few else reps).alias("r")
    d = docs.select("doc_id", *_name(F.col("text")), "text").alias("d")
    rows = d.join(r, _same_row("d", "r")).select("r.id", "d.text")
    return _sets(rows).dropDuplicates(["id"])


def prefix_posts(classes: DataFrame) -> DataFrame:
    """key, id: posts left after dropping single-document lists, short counts and the longest lists."""
    posts = classes.select("id", F.posexplode("sig").alias("c", "v")).select("id", (F.shiftleft(F.col("c").cast("bigint"), 32) + F.col("v")).alias("key"))
    lists = posts.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    shared = stored(posts.join(lists, "key"), "shared")
    # Rows of one id: at most COORDINATES.
    per = shared.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("ks")).where(F.size("ks") >= MATCHES)
    kept = F.slice("ks", 1, F.size("ks") - (MATCHES - 1))
    return per.select("id", F.explode(kept).alias("k")).select("k.key", "id")


def agreements(a: Column, b: Column) -> Column:
    same = F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0))
    return F.aggregate(same, F.lit(0), lambda acc, x: acc + x)


def confirm(pairs: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` that are links: collisions counted, then full sets compared."""
    one = classes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    two = classes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    near = (100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")) & (agreements(F.col("sa"), F.col("sb")) >= MATCHES)
    likely = stored(pairs.join(one, "a").join(two, "b").where(near).select("a", "b"), "likely")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sx").to_pylist(), batch.column("sy").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    full = likely.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sx")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("sy")), "b")
    return full.select("a", "b", "sx", "sy").mapInArrow(run, "a long, b long")


def leader_pairs(posts: DataFrame, leader: Column, comp: DataFrame | None) -> DataFrame:
    """(a, b): members with their list's leader; with ``comp``, only across components."""
    # Written first: only a join of two plain shuffles has its skewed partitions split.
    led = stored(posts.groupBy("key").agg(leader.alias("b")), "leaders")
    pairs = posts.join(led, "key").select(F.col("id").alias("a"), "b").where("a <> b").distinct()
    if comp is not None:
        ca = comp.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
        cb = comp.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
        pairs = pairs.join(ca, "a", "left").join(cb, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    return pairs


def _meet(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links across components between the two blocks of a meeting, one per joined pair of components."""
    left, right = pdf[pdf["side"] != 1], pdf[pdf["side"] != 0]
    # Only shingles on both sides can count.
    xs = [np.frombuffer(s, np.uint64) for s in left["set"]]
    ys = [np.frombuffer(s, np.uint64) for s in right["set"]]
    out: list[tuple[int, int]] = []
    if xs and ys:
        vocabulary = np.intersect1d(np.unique(np.concatenate(xs)), np.unique(np.concatenate(ys)), assume_unique=True)
        both = np.zeros((len(xs), len(ys)), dtype=np.float32)
        for lo in range(0, len(vocabulary), STEP):
            part = vocabulary[lo : lo + STEP]
            mats = []
            for sets in (xs, ys):
                m = np.zeros((len(sets), len(part)), dtype=np.float32)
                for i, s in enumerate(sets):
                    own = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], side="right")]
                    at = np.searchsorted(part, own)
                    ok = part[np.minimum(at, len(part) - 1)] == own
                    m[i, at[ok]] = 1
                mats.append(m)
            both += mats[0] @ mats[1].T
        nx, ny = np.array([len(s) for s in xs]), np.array([len(s) for s in ys])
        cx, cy = left["comp"].to_numpy(), right["comp"].to_numpy()
        link = (100 * both >= PERCENT * (nx[:, None] + ny[None, :] - both)) & (cx[:, None] != cy[None, :])
        seen: set[tuple[int, int]] = set()
        ids, others = left["id"].to_numpy(), right["id"].to_numpy()
        for i, j in np.argwhere(link).tolist():
            pair = (min(cx[i], cy[j]), max(cx[i], cy[j]))
            if pair not in seen:
                seen.add(pair)
                out.append((ids[i], others[j]))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def merged(member: DataFrame, salt: int) -> DataFrame:
    """``member`` (key, id, comp) with lists of the same head, the member with the least hash, made one where that takes no more pairs."""
    own = F.col("n") * F.col("n")
    # Written first, as in leader_pairs.
    lists = stored(member.groupBy("key").agg(F.min_by("id", F.xxhash64("id", F.lit(salt))).alias("head"), F.count("*").alias("n")), "heads")
    heads = lists.groupBy("head").agg(F.min("key").alias("into"), F.sum(own).alias("apart"), F.count("*").alias("lists")).where("lists > 1").drop("lists")
    moved = stored(lists.join(heads, "head").select("key", "head", "into", "apart"), "moved")
    together = member.join(moved.select("key", "head"), "key").select("head", "id").distinct().groupBy("head").agg(F.count("*").alias("n"))
    fewer = stored(moved.join(together, "head").where(own <= F.col("apart")).select("key", "into"), "fewer")
    return stored(member.join(fewer, "key", "left").withColumn("key", F.coalesce("into", "key")).select(member.columns).distinct(), "merged")


def exact_rest(posts: DataFrame, comp: DataFrame, sets: DataFrame) -> DataFrame:
    """Links across components inside lists that still hold several."""
    c = comp.select(F.col("node").alias("id"), "comp")
    member = posts.join(c, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"))
    mixed = member.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("m1"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("m2")).where("x < y")
    lists = mixed.groupBy("n", "m1", "m2").agg(F.min("key").alias("key")).select("key")
    member = stored(member.join(lists, "key"), "mixed")
    for salt in range(MERGES):
        member = merged(member, salt)
    member = stored(member.join(sets.select("id", F.col("n").alias("shingles")), "id"), "sized")
    blocks_of = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("shingles") / BLOCK_SHINGLES)).alias("nb")
    band = F.when(F.col("nb") > 2, F.floor(F.log("shingles") / F.log(F.lit(BAND)))).otherwise(F.lit(0))
    # A component with at least a block of members gets blocks of its own; the others share.
    size = member.groupBy("key", "comp").agg(F.count("*").alias("n"))
    own = F.when(F.col("n") >= BLOCK, F.col("comp")).otherwise(F.lit(None).cast("bigint"))
    placed = member.join(member.groupBy("key").agg(blocks_of), "key").join(size.select("key", "comp", own.alias("own")), ["key", "comp"])
    placed = stored(placed.select("key", "id", "comp", "own", band.cast("bigint").alias("band"), "shingles"), "placed")
    deal = placed.groupBy("key", "own", "band").agg(blocks_of)
    d = deal.alias("d")
    p = placed.alias("p")
    here = (F.col("p.key") == F.col("d.key")) & (F.col("p.band") == F.col("d.band")) & F.col("p.own").eqNullSafe(F.col("d.own"))
    placed = p.join(d, here).select("p.key", "p.id", "p.comp", "p.own", "p.band", F.pmod(F.xxhash64("p.id"), F.col("nb")).alias("blk"))
    blocks = deal.select("key", "own", "band", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nb") - 1)).alias("blk"))
    # Blocks, not members, are paired: those of the same band and of the bands beside it.
    name = F.struct(F.coalesce("own", F.lit(-(2**63))).alias("o"), "band", "blk")
    l = blocks.select("key", "band", name.alias("x"), F.col("own").alias("ox"))  # noqa: E741
    r = blocks.select("key", F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)])).alias("band"), name.alias("y"), F.col("own").alias("oy"))
    meets = l.join(r, ["key", "band"]).where((F.col("x") <= F.col("y")) & (F.col("ox").isNull() | F.col("oy").isNull() | (F.col("ox") != F.col("oy"))))
    sides = F.when(F.col("x") == F.col("y"), F.array(F.struct(F.lit(2).alias("side"), F.col("x").alias("z")))).otherwise(
        F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("z")), F.struct(F.lit(1).alias("side"), F.col("y").alias("z")))
    )
    meets = meets.withColumn("meet", F.xxhash64("key", "x", "y")).select("key", "meet", F.explode(sides).alias("s")).select("key", "meet", "s.side", "s.z")
    seats = placed.select("key", "id", "comp", name.alias("z")).join(meets, ["key", "z"]).select("meet", "side", "id", "comp")
    return seats.join(sets, "id").select("meet", "side", "id", "comp", "set").groupBy("meet").applyInPandas(_meet, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept per row."""
    return judged(docs).drop("t1", "t2", "cid")


def judged(docs: DataFrame) -> DataFrame:
    """``near_duplicates`` with t1 and t2, which tell rows of one doc_id apart, and cid, the component's own name."""
    rows = stored(signatures(docs), "signatures")
    worded = rows.where("n > 0")
    classes = worded.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc"), F.min(F.struct("doc_id", "t1", "t2")).alias("one"))
    # The written table is the only one that is read, so the ids stay what they are.
    classes = stored(classes.select("h1", "h2", "doc", "one.*", F.monotonically_increasing_id().alias("id")), "classes")
    w, c = worded.alias("w"), classes.alias("c")
    same = _same_row("w", "c") & (F.col("w.h1") == F.col("c.h1")) & (F.col("w.h2") == F.col("c.h2"))
    reps = stored(w.join(c, same).select("c.id", "w.n", "w.sig", "c.doc_id", "c.t1", "c.t2").dropDuplicates(["id"]), "reps")
    posts = stored(prefix_posts(reps), "posts")
    posts = stored(posts.join(posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "key", "left_semi"), "lists")
    sets = stored(class_sets(docs, stored(reps.join(posts.select("id").distinct(), "id", "left_semi").select("id", "doc_id", "t1", "t2"), "met")), "sets")
    edges = stored(confirm(leader_pairs(posts, F.min("id"), None), reps, sets), "links")
    comp = components(edges)
    more = stored(confirm(leader_pairs(posts, F.min_by("id", F.xxhash64("id", "key")), comp), reps, sets), "links")
    edges = edges.union(more)
    comp = components(edges)
    edges = edges.union(stored(exact_rest(posts, comp, sets), "links"))
    comp = components(edges)
    of_class = classes.select("id", "h1", "h2", "doc").join(comp.withColumnRenamed("node", "id"), "id", "left").select("h1", "h2", "doc", F.coalesce("comp", "id").alias("cid"))
    of_class = stored(of_class, "of-class")
    least = stored(of_class.groupBy("cid").agg(F.min("doc").alias("component_id")), "least")
    out = rows.select("doc_id", "t1", "t2", "n", "h1", "h2").join(of_class.join(least, "cid").select("h1", "h2", "cid", "component_id"), ["h1", "h2"], "left")
    alone = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "t1", "t2", "cid", F.col("n").alias("n_shingles"), alone.alias("component_id"), F.coalesce(F.col("doc_id") == alone, F.col("doc_id").isNull() & alone.isNull()).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, with the smallest doc_id if any row has one; rows without words stay."""
    row = ["doc_id", "t1", "t2"]
    each = stored(judged(docs).where("n_shingles > 0").groupBy("cid", *row).agg(F.count("*").alias("rows")), "judged")
    order = F.struct(F.col("doc_id").isNull().alias("last"), *row)
    each = each.join(stored(each.groupBy("cid").agg(F.min(order).alias("best")), "keepers"), "cid").withColumn("stays", order == F.col("best"))
    gone = stored(each.where("NOT stays").select(*row).distinct(), "gone")
    again = stored(each.where("stays AND rows > 1").select(*row), "again")

    def rows(side: DataFrame, how: str, df: DataFrame) -> DataFrame:
        side = side.select(F.col("doc_id").alias("other_id"), F.col("t1").alias("other_t1"), F.col("t2").alias("other_t2"))
        side = F.broadcast(side) if side.count() <= BROADCAST_IDS else side
        t1, t2 = _name(df["text"])
        return df.join(side, df["doc_id"].eqNullSafe(side["other_id"]) & (t1 == side["other_t1"]) & (t2 == side["other_t2"]), how)

    left = rows(gone, "left_anti", docs)
    if again.isEmpty():
        return left
    return rows(again, "left_anti", left).unionByName(rows(again, "left_semi", left).dropDuplicates(["doc_id", "text"]))
