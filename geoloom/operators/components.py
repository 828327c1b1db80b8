"""Connected components of an edge table (alternating large-star and small-star)."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def connected_components(edges: DataFrame, max_rounds: int | None = None, hubs: bool = False) -> DataFrame:
    """``node, component`` for every node of ``edges(src, dst)``; the component is its least node.

    Each round is two grouped minima and two equi-joins with linear output, whatever the
    degree of a node, and ends in a checkpoint.  With ``hubs`` the minima are stored before
    they are joined back: both sides of the join are then dealt anew, and Spark can split the
    partition of a node that holds a large part of all edges.
    """
    stored = cut_lineage if hubs else (lambda df: df)
    e = edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct()
    e = cut_lineage(e)
    state = _fingerprint(e)
    for _ in itertools.count() if max_rounds is None else range(max_rounds):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            e.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(e.where("a = b")).distinct()
        large = stored(large)
        parent = stored(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(parent, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut_lineage(small.unionByName(parent.select("a", F.col("m").alias("b"))).distinct())
        now = _fingerprint(e)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("connected components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component"))
    ).distinct()


def _fingerprint(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.bit_xor(F.xxhash64("a", "b"))).first())
