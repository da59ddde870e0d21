"""Connected components by hooking and contraction; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """node, comp (smallest node reachable) for every node of ``edges`` (a, b: long).

    Every round hooks each node below its smallest neighbour, jumps pointers twice and
    contracts the edges; the number of rounds is about the logarithm of the longest chain.
    """
    live = stored(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct(), "edges")
    nodes = live.select(F.col("lo").alias("node")).union(live.select("hi")).distinct()
    label = nodes.select("node", F.col("node").alias("comp"))
    while not live.isEmpty():
        # Half of all nodes may hook below one node. The hooks are written before they meet themselves,
        # as only a join of two plain shuffles has its skewed partitions split.
        hooks = stored(live.groupBy("hi").agg(F.min("lo").alias("up")), "hooks")
        above, up = hooks.select(F.col("hi").alias("up"), F.col("up").alias("top")), hooks
        for _ in range(2):
            up = up.join(above, "up", "left").select("hi", F.coalesce("top", "up").alias("up"))
        up = stored(up, "jumps")
        label = stored(label.join(up.withColumnRenamed("hi", "comp"), "comp", "left").select("node", F.coalesce("up", "comp").alias("comp")), "labels")
        lo = live.join(up.select(F.col("hi").alias("lo"), F.col("up").alias("a")), "lo", "left").select(F.coalesce("a", "lo").alias("a"), "hi")
        both = lo.join(up.withColumnRenamed("up", "b"), "hi").select("a", "b")
        live = stored(both.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct(), "edges")
    return label
