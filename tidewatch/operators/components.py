"""Connected components by randomised contraction.

Published as a method for parallel databases: every node of a round points to the member of
its closed neighbourhood with the smallest hash, the edges are rewritten to those targets and
loops dropped. The graph shrinks by a constant factor per round in expectation, whatever its
shape, so long chains need no more than a logarithmic number of rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import settle, unsized
from .scale import HOT_ROWS, hot_key_join


def components(nodes: DataFrame, edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(id, component)`` for ``nodes(id)`` and undirected ``edges(a, b)``; a component is
    named after its smallest id. Nodes without an edge are their own component."""
    linked = linked_components(edges, hot_rows)
    return nodes.select("id").join(linked, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _ordered(edges: DataFrame) -> DataFrame:
    """Undirected edges once each, without loops."""
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def linked_components(edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(id, component)`` of the nodes that have an edge."""
    edges = unsized(settle(_ordered(edges)))
    merged: list[DataFrame] = []  # per round: which node each node was merged into
    has_hot = False
    while True:
        into = settle(_targets(edges, len(merged)))
        size, most = into.agg(F.count(F.lit(1)), F.max("n")).first()
        if size == 0:
            break
        # A node merges with neighbours only, so the most neighbours bound the joins below.
        has_hot = has_hot or most >= hot_rows
        hot = into.filter(F.col("n") >= hot_rows) if has_hot else None
        merged.append(into.select("id", "into"))
        edges = unsized(settle(_ordered(_renamed(_renamed(edges, "a", into, hot), "b", into, hot))))
    if not merged:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))

    # Back from the last round to the first: a node ends where its target ends.
    ends = merged[-1].withColumnRenamed("into", "end")
    for into in reversed(merged[:-1]):
        target = ends.withColumnsRenamed({"id": "into"})
        ends = hot_key_join(into, target, ["into"], _hot(into, "into", hot_rows, has_hot))
        ends = ends.select("id", F.coalesce("end", "into").alias("end"))
        ends = settle(ends) if has_hot else ends
    ends = settle(ends)
    lowest = ends.groupBy("end").agg(F.min("id").alias("component"))
    sized = ends.groupBy("end").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= hot_rows)
    return hot_key_join(ends, lowest, ["end"], settle(sized.select("end"))).select("id", "component")


def _hot(df: DataFrame, c: str, hot_rows: int, wanted: bool) -> DataFrame | None:
    if not wanted:
        return None
    return settle(df.groupBy(c).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= hot_rows).select(c))


def _targets(edges: DataFrame, turn: int) -> DataFrame:
    """``(id, into, n)``: smallest hash among a node and its ``n`` neighbours."""
    ranked = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("id"))
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    best = both.groupBy("a").agg(F.min(ranked("b")).alias("nearest"), F.count(F.lit(1)).alias("n"))
    return best.select(F.col("a").alias("id"), F.least("nearest", ranked("a"))["id"].alias("into"), "n")


def _renamed(edges: DataFrame, c: str, into: DataFrame, hot: DataFrame) -> DataFrame:
    target = into.select(F.col("id").alias(c), F.col("into").alias("_to"))
    keys = None if hot is None else hot.select(F.col("id").alias(c))
    return hot_key_join(edges, target, [c], keys, "inner").drop(c).withColumnRenamed("_to", c)
