"""Sharding with a map that exists: its newest version is edited and stored as the next."""

from collections import Counter

from ledgerlight.llm import sharding


def test_existing_map_is_edited(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    first = [(i, "x" * (i % 50)) for i in range(600)]
    grown = first + [(i, "y" * 300) for i in range(600, 700)]
    runs = [(first, 8), (grown, 8), (grown, 10), (grown, 6)]
    owners = []
    for k, (rows, shards) in enumerate(runs):
        got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=shards, slots=128, map_path=path).collect()
        assert Counter(x.doc_id for x in got) == Counter(i for i, _ in rows)
        assert {x.map_version for x in got} == {k + 2} and {x.shard for x in got} <= set(range(shards))
        owners.append([x.shard for x in sharding.load_map(spark, path).orderBy("vslot").collect()])
    assert len(owners[1]) == 128 and sum(a != b for a, b in zip(owners[0], owners[1], strict=True)) < 64
    assert len(set(owners[2])) == 10 and len(set(owners[3])) == 6
