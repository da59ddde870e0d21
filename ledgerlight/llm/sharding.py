"""Sharding: fixed virtual slots and a versioned slot-to-shard map.

Records hash into ``SLOTS`` virtual slots; bytes are aggregated per slot before
anything moves; a map from slots to shards is stored under a version and edited,
slot by slot, to rebalance. Law: ``bytes``: shards hold nearly equal bytes.

The map has a fixed number of rows, so the driver edits it at any corpus size.
Positions inside a shard are the slot's offset plus a rank within the slot, so no
task ever holds a whole shard.

Edge cases: a null text counts 16 bytes and has the crc32 of no bytes; repeated
rows share a virtual slot and get positions of their own; a null doc_id hashes
like any value; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlight.llm.common import fingerprint, fresh_path, stored

SLOTS = 8192
SHARDS = 40
ROW_BYTES = 16
MAP_SCHEMA = "version int, vslot int, shard int"


def initial_map(slots: int, shards: int) -> list[int]:
    return [s % shards for s in range(slots)]


def rebalanced(owner: list[int], size: list[int], shards: int) -> list[int]:
    """An edit of ``owner``: slots leave shards above the mean, the largest first, and
    go to the lightest shard; then single slots move while that narrows the spread."""
    # Slots of shards that are no more go round the others before bytes are looked at.
    owner = [o if o < shards else s % shards for s, o in enumerate(owner)]
    load, held = [0] * shards, [[] for _ in range(shards)]
    for s, o in enumerate(owner):
        load[o] += size[s]
        held[o].append(s)
    mean = sum(load) / shards
    pool: list[int] = []
    for o in range(shards):
        for s in sorted(held[o], key=lambda s: (-size[s], s)):
            if load[o] <= mean:
                break
            load[o] -= size[s]
            pool.append(s)
    heap = [(load[o], o) for o in range(shards)]
    heapq.heapify(heap)
    for s in sorted(pool, key=lambda s: (-size[s], s)):
        _, o = heapq.heappop(heap)
        owner[s] = o
        load[o] += size[s]
        heapq.heappush(heap, (load[o], o))
    for _ in range(20 * shards):
        hi, lo = max(range(shards), key=lambda o: (load[o], o)), min(range(shards), key=lambda o: (load[o], o))
        gap = load[hi] - load[lo]
        best = min((s for s in range(len(owner)) if owner[s] == hi and 0 < size[s] < gap), key=lambda s: (abs(2 * size[s] - gap), s), default=None)
        if best is None:
            break
        owner[best] = lo
        load[hi] -= size[best]
        load[lo] += size[best]
    return owner


def store_map(spark: SparkSession, path: str, version: int, owner: list[int]) -> None:
    """Append one version of the map; earlier versions stay readable."""
    rows = [(version, s, o) for s, o in enumerate(owner)]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    m = spark.read.schema(MAP_SCHEMA).parquet(path)
    v = version if version is not None else m.agg(F.max("version")).first()[0]
    return m.where(F.col("version") == v)


def newest_map(spark: SparkSession, path: str) -> tuple[int, list[int]] | None:
    """(version, owner of each slot) of the newest map at ``path``, or None where none is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    rows = sorted((r.vslot, r.version, r.shard) for r in load_map(spark, path).collect())  # a row per slot
    return (rows[0][1], [o for _, _, o in rows]) if rows else None


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot: all that sharding needs of a record."""
    body = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(body) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id", fingerprint(F.col("text"))), F.lit(slots)).cast("int").alias("vslot"),
    )


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, map_version.

    The newest map at ``map_path`` is edited and stored as its next version; a new path starts with version 1.
    """
    spark = docs.sparkSession
    path = map_path or fresh_path(spark, "slot-map")
    held = newest_map(spark, path) if map_path else None
    if held is not None and len(held[1]) != slots:
        raise ValueError(f"the map at {path} has {len(held[1])} slots, not {slots}")
    narrow = stored(sized(docs, slots), "sized")
    size, rows = [0] * slots, [0] * slots
    for r in narrow.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():  # a row per slot
        size[r.vslot], rows[r.vslot] = r.b, r.n
    if held is None:
        held = 1, initial_map(slots, shards)
        store_map(spark, path, *held)
    version, owner = held[0] + 1, rebalanced(held[1], size, shards)
    store_map(spark, path, version, owner)
    offset, seen = [0] * slots, [0] * shards
    for s, o in enumerate(owner):
        offset[s] = seen[o]
        seen[o] += rows[s]
    placed = load_map(spark, path, version).join(spark.createDataFrame(list(enumerate(offset)), "vslot int, offset long"), "vslot")
    rank = F.row_number().over(W.partitionBy("vslot").orderBy("doc_id", "size", "text_crc32")) - 1
    return (
        narrow.withColumn("rank", rank)
        .join(F.broadcast(placed), "vslot")  # one row per slot: a fixed size
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("offset") + F.col("rank")).cast("bigint").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "vslot", F.col("version").alias("map_version"),
        )
    )
