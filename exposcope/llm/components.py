"""Connected components of a distributed edge list by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from exposcope.llm.common import broadcast_if_small, written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its
    smallest node.

    Each round hooks every node to its smallest neighbour (map-side minima, so a
    star's centre is no hot key), shortens the hooks to their roots by pointer
    doubling, moves the labels and the edges there and drops edges that became
    loops.  Doubling takes a logarithm of the longest chain of hooks, so neither
    chains of ascending nodes nor stars need many rounds, and every step reads
    written tables only, so plans stay small.  Loops and repeated edges are fine;
    without edges the result is empty.
    """
    edges = written(_contracted(edges))
    labels = None
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = _rooted(written(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("up"))))
        if labels is None:  # the first round has every node
            labels = up.select(F.col("a").alias("node"), F.col("up").alias("component"))
        else:
            labels = written(_follow(labels, "component", up))
        edges = written(_contracted(_follow(_follow(edges, "a", up), "b", up)))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")) if labels is None else labels


def _contracted(edges: DataFrame) -> DataFrame:
    """Each undirected edge once, smaller node first, without loops."""
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _rooted(up: DataFrame) -> DataFrame:
    """Hooks (a, up) that lead straight to their roots: each step follows every hook by
    the hook of its end, which doubles its reach."""
    while True:
        table = broadcast_if_small(up, 32)
        after = written(_follow(up.withColumn("from", F.col("up")), "up", table))
        if not after.where(F.col("up") != F.col("from")).limit(1).count():
            return broadcast_if_small(up, 32)
        up = after.select("a", "up")


def _follow(df: DataFrame, col: str, up: DataFrame) -> DataFrame:
    """``col`` moved along its hook (a node without one stays)."""
    step = up.select(F.col("a").alias("__from"), F.col("up").alias("__to"))
    return df.join(step, F.col(col) == F.col("__from"), "left") \
        .withColumn(col, F.coalesce("__to", col)).drop("__from", "__to")
