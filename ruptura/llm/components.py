"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruptura.llm.common import checkpointed, stored


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from every node of an edge list.

    ``edges`` has two long columns ``a`` and ``b``; self loops and repeated edges
    are allowed, nulls are ignored. Returns ``node, component`` for every node of
    an edge between different nodes; no rows for an empty edge list.

    Each round points nodes at smaller ones: first all larger neighbours of a node
    at its smallest neighbour, then all smaller neighbours likewise. Both steps are
    a minimum per node (combined before the shuffle) and a join against it, where
    only the edge side can be skewed. The minima are written first: adaptive execution
    splits a hot key only where both sides of the join come straight from a shuffle.
    The number of rounds is logarithmic in the diameter.
    """
    now = checkpointed(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before = _signature(now)
    while before[0]:
        ends = now.select(F.col("b").alias("u"), F.lit(None).cast("long").alias("v")).union(now.select("a", "b"))
        low = stored(ends.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")), "minima")
        large = (
            now.join(low, now["b"] == low["u"]).select("a", F.col("m").alias("b")).where("a <> b").distinct()
        )
        low = stored(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "minima")
        small = large.join(low, large["a"] == low["u"]).select("a", "b", "m")
        now = checkpointed(
            small.select("a", F.col("m").alias("b"))
            .union(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
            .distinct()
        )
        after = _signature(now)
        if after == before:
            break
        before = after
    nodes = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return nodes.union(now.select("b", "b").distinct())
