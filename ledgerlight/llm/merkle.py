"""Merkle dataset manifest by superblocks.

A leaf is the hash of a row's fields; the leaves of a tree (a source) ascend by doc_id, and every
``FANOUT`` consecutive nodes become one until one is left: the subroot. Subroots, in the order of
their sources, are the leaves of the tree above; its root names the dataset.

Reduction goes by superblocks: the index of a node, divided by ``FANOUT ** LEVELS``, is its bucket.
A grouped pandas function collapses ``LEVELS`` levels of a bucket at once and gives each of its nodes
the siblings met on the way (the lower proof) and the bucket's root. The roots are nodes of a tree
that is 729 times smaller, reduced in the same way; its proofs (upper) are joined
back by bucket and appended. A task holds one bucket, 729 digests, however many rows a source has.

Indices come without a window over a source: rows are sorted by range, numbered
inside their partitions, and the counts of (partition, tree), a row each, give the offsets. The
number of partitions, not of rows, bounds a window. Equal rows are split by a number of their own,
as their leaves are equal and their order cannot show.

Proofs are concatenated digests. Where a node stands and how many siblings each level has follows
from its index and the size of its tree, so ``folded`` recomputes a root from
any leaf, in generated and higher-order expressions, without the tree.

Edge cases: a null field is ``-``; null doc_ids and a null source come first; rows of one doc_id
follow in the order of their leaves; equal rows have equal leaves and proofs of their own places; a
lone row is its own subroot, a lone source's subroot is the root, and the proof is
then empty; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlight.llm.common import stored, tune

FANOUT, LEVELS = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Sizes above which a tree has one more level.
SIZES = [FANOUT**k for k in range(39)]
DIGEST = 64  # characters
NODE = "tree string, idx long, n long, node binary, tag string, other binary, proof binary, top binary"


def leaf(fields: list[Column]) -> Column:
    """Lowercase hex sha256 of the fields: ``-`` if null, else UTF-8 byte count, ``:``, value."""
    texts = [c.cast("string") for c in fields]
    said = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*said), 256)


def leaves(docs: DataFrame, other: Column | None = None) -> DataFrame:
    """tree, doc_id, tag (doc_id as text), node, other: leaves as 32 bytes, and those of other texts where given."""
    named = [F.col(c) for c in FIELDS]
    second = F.lit(None).cast("binary") if other is None else F.unhex(leaf([*named[:-1], other]))
    return docs.select(F.col("source").alias("tree"), "doc_id", F.col("doc_id").cast("string").alias("tag"), F.unhex(leaf(named)).alias("node"), second.alias("other"))


def indexed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with idx, the place of a row in its tree by ``order``, and n, the size of the tree."""
    keys = ["tree", *order]
    own = rows.withColumn("own", F.monotonically_increasing_id())  # splits equal rows
    at = own.repartitionByRange(*keys, "own").sortWithinPartitions(*keys, "own").withColumn("at", F.monotonically_increasing_id())
    at = stored(at.drop("own").withColumn("part", F.shiftright("at", 33)), "numbered")
    chunks = at.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("m"))
    tree = W.partitionBy("tree")
    before = F.coalesce(F.sum("m").over(tree.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    chunks = stored(chunks.select(F.col("tree").alias("t"), F.col("part").alias("p"), (before - F.col("first")).alias("shift"), F.sum("m").over(tree).alias("n")), "chunks")
    joined = at.join(chunks, at["tree"].eqNullSafe(chunks["t"]) & (at["part"] == chunks["p"]))
    return joined.withColumn("idx", F.col("at") + F.col("shift")).drop("t", "p", "part", "at", "shift")


def collapse(nodes: pd.DataFrame, levels: int) -> pd.DataFrame:
    """``levels`` levels of one bucket: proof (siblings, bottom up) and top (what the bucket becomes) of each of its nodes."""
    nodes = nodes.sort_values("idx", ignore_index=True)
    level, size, proofs, step = [bytes(x) for x in nodes["node"]], int(nodes["n"].iloc[0]), [b""] * len(nodes), 1
    for _ in range(levels):
        if size == 1:
            break
        runs = [level[i : i + FANOUT] for i in range(0, len(level), FANOUT)]
        siblings = [b"".join(run[:i] + run[i + 1 :]) for run in runs for i in range(len(run))]
        proofs = [p + siblings[j // step] for j, p in enumerate(proofs)]
        level = [hashlib.sha256(b"".join(run).hex().encode()).digest() for run in runs]
        size, step = -(-size // FANOUT), step * FANOUT
    return nodes.assign(proof=proofs, top=level[0])


def proved(nodes: DataFrame, finish: Callable[[DataFrame], DataFrame] = lambda low: low) -> DataFrame:
    """Nodes (tree, idx, n, node, tag, other) with proof and top, the root of their tree.

    ``finish`` sees the uppermost buckets, one a tree, and may add columns that go down with the upper proofs.
    """
    levels, size = LEVELS, FANOUT**LEVELS
    bare = nodes.select("tree", "idx", "n", "node", "tag", "other")
    grouped = bare.groupBy("tree", F.floor(F.col("idx") / size).alias("bucket"))
    low = stored(grouped.applyInPandas(lambda pdf: collapse(pdf, levels), NODE), "superblocks")
    if (low.agg(F.max("n")).first()[0] or 0) <= size:
        return finish(low)
    none = F.lit(None)
    roots = low.where(F.col("idx") % size == 0).select("tree", F.floor(F.col("idx") / size).alias("idx"), F.ceil(F.col("n") / size).alias("n"), F.col("top").alias("node"), none.cast("string").alias("tag"), none.cast("binary").alias("other"))
    up = proved(roots, finish).drop("n", "node", "tag", "other")
    up = stored(up.withColumnsRenamed({"tree": "t", "idx": "b", "proof": "upper", "top": "root_of"}), "upper-proofs")
    both = low.join(up, low["tree"].eqNullSafe(up["t"]) & (F.floor(low["idx"] / size) == up["b"]))
    return both.withColumns({"proof": F.concat("proof", "upper"), "top": F.col("root_of")}).drop("t", "b", "upper", "root_of")


def _under_root(low: DataFrame) -> DataFrame:
    """The uppermost buckets of all sources with the place, proof and root of their subroots in the tree above."""
    nodes = low.where("idx = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("top").alias("node"), F.lit(None).cast("binary").alias("other"))
    # The sources' names travel as tags; a null one, the first, is told apart by a mark.
    named = nodes.withColumn("tag", F.coalesce(F.concat(F.lit("="), "name"), F.lit("-")))
    above = proved(indexed(named, ["name"])).select("tag", F.col("idx").alias("place"), F.col("n").alias("sources"), F.col("proof").alias("proof_above"), F.col("top").alias("root"))
    above = stored(above.withColumnRenamed("tag", "named"), "sources")
    return low.join(above, F.coalesce(F.concat(F.lit("="), low["tree"]), F.lit("-")) == above["named"]).drop("named")


def hexed(c: Column | str) -> Column:
    return F.lower(F.hex(c))


def folded(node: Column, idx: Column, n: Column, proof: Column) -> Column:
    """The root that ``node`` (hex) leads to from place ``idx`` among ``n`` by ``proof`` (hex)."""
    levels = F.filter(F.array(*[F.lit(s).cast("bigint") for s in SIZES]), lambda s: s < n)
    zero = F.struct(node.alias("acc"), idx.alias("i"), n.alias("n"), F.lit(1).cast("bigint").alias("at"))

    def step(x: Column, _: Column) -> Column:
        p = x["i"] % FANOUT
        run = F.least(F.lit(FANOUT).cast("bigint"), x["n"] - x["i"] + p)
        left = F.substring(proof, x["at"].cast("int"), (p * DIGEST).cast("int"))
        right = F.substring(proof, (x["at"] + p * DIGEST).cast("int"), ((run - 1 - p) * DIGEST).cast("int"))
        acc = F.sha2(F.concat(left, x["acc"], right), 256)
        return F.struct(acc.alias("acc"), F.floor(x["i"] / FANOUT).alias("i"), F.ceil(x["n"] / FANOUT).alias("n"), (x["at"] + (run - 1) * DIGEST).alias("at"))

    return F.aggregate(levels, zero, step, lambda x: x["acc"])


def proofs(docs: DataFrame, other: Column | None = None) -> DataFrame:
    """doc_id, source, leaf, other, idx, n, proof, subroot, place, sources, proof_above, root (digests as hex): a row per row of ``docs``."""
    tune(docs.sparkSession)
    numbered = indexed(stored(leaves(docs, other), "leaves"), ["doc_id", "node"])
    whole = proved(numbered, _under_root)
    return whole.select(
        F.col("tag").cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.col("tree").alias("source"), hexed("node").alias("leaf"), hexed("other").alias("other"), "idx", "n", hexed("proof").alias("proof"),
        hexed("top").alias("subroot"), "place", "sources", hexed("proof_above").alias("proof_above"), hexed("root").alias("root"),
    )


def root_of(leaf_hex: Column) -> Column:
    """The root that a leaf leads to, in a row of ``proofs``."""
    subroot = folded(leaf_hex, F.col("idx"), F.col("n"), F.col("proof"))
    return folded(subroot, F.col("place"), F.col("sources"), F.col("proof_above"))


def write_manifest(docs: DataFrame, path: str) -> str | None:
    """Write the proofs of ``docs`` as Parquet below ``path`` and return the root (None for no rows)."""
    proofs(docs).drop("other").write.parquet(path)
    first = docs.sparkSession.read.parquet(path).select("root").first()
    return first[0] if first else None


def changed(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, kind: ``changed`` rows whose leaf the manifest at ``path`` doesn't hold at their doc_id, ``missing`` and ``added`` ones.

    Rows of one doc_id are compared as a set: as many times as a leaf occurs on either side.
    """
    here = docs.select("doc_id", leaf([F.col(c) for c in FIELDS]).alias("leaf"), F.lit(1).alias("side"))
    there = docs.sparkSession.read.parquet(path).select("doc_id", "leaf", F.lit(-1).alias("side"))
    odd = here.unionByName(there).groupBy("doc_id", "leaf").agg(F.sum("side").alias("d")).where("d <> 0")
    kind = F.when((F.max("d") > 0) & (F.min("d") < 0), "changed").when(F.max("d") > 0, "added").otherwise("missing")
    return odd.groupBy("doc_id").agg(kind.alias("kind"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified, with texts tampered by a hash of doc_id."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    p = proofs(docs, F.when(hit, F.translate("text", "\n", "")).otherwise(F.col("text")))
    # The fold leaves through a generator: it is computed once for the two columns that show it.
    p = p.select("*", F.inline(F.array(F.struct(root_of(F.col("other")).alias("folded_root")))))
    return p.select("doc_id", "leaf", "subroot", "root", F.sha2(F.concat("proof", "proof_above"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
