"""Clusters of a sliding window, kept up to date by links instead of being found anew.

A link joins two posts within ``eps`` and lasts until the older one retires. What is kept of all links is a forest, for each
pair of blocks, that prefers links which last longer: dropping those that have ended leaves exactly the groups of the posts
that are left (the cycle property of spanning trees), at any moment and without looking at a vector again. A batch
compares only its own posts with the window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import settle
from .components import linked_components
from .scale import HOT_ROWS
from .similarity import BLOCK_ROWS, Pair, back_to_posts, block_vectors

MICROS = 60_000_000


def instant(ts: str = "ts"):
    """Microseconds since the epoch."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def lasting_forest(near: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, own: bool) -> list[tuple[int, int]]:
    """Edges ``(row, column)`` of a spanning forest of the graph ``near`` whose edges last as long as possible; an edge
    lasts until the earlier of ``at_a`` and ``at_b``. With ``own``, rows and columns are the same nodes.

    Nodes enter from the newest to the oldest. All edges of the entering node to earlier ones last equally long, as the node
    is the oldest: one to each group that it touches is kept.
    """
    n_a = len(at_a)
    at = at_a if own else np.concatenate([at_a, at_b])
    label = np.arange(len(at))
    entered = np.zeros(len(at), bool)
    edges = []
    touched = near.any(axis=1) if own else np.concatenate([near.any(axis=1), near.any(axis=0)])
    for v in np.argsort(-at, kind="stable"):
        if not touched[v]:
            continue
        if own:
            others = np.flatnonzero(near[v] & entered)
        elif v < n_a:
            others = n_a + np.flatnonzero(near[v] & entered[n_a:])
        else:
            others = np.flatnonzero(near[:, v - n_a] & entered[:n_a])
        entered[v] = True
        if not len(others):
            continue
        groups, first = np.unique(label[others], return_index=True)
        for w in others[first]:
            edges.append((int(v), int(w)) if own or v < n_a else (int(w), int(v)))
        if len(groups) > 1:
            label[np.isin(label, groups[1:])] = groups[0]
        label[v] = groups[0]
    return edges if own else [(i, j - n_a) for i, j in edges]


def fresh_links(posts: DataFrame, eps: float = 0.4, id: str = "seq", vec: str = "embedding", ts: str = "ts",
                block_rows: int = BLOCK_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(a, b, until)`` for the posts of an active window, whose new ones have ``fresh``: links of a new post with any
    other, enough of them to join the same groups for as long as both posts are active. ``until`` is in microseconds.

    Copies of a vector are joined to the latest of them, which alone is compared with other vectors. A zero vector
    is near nothing where ``eps`` is below 1, not even its copies.
    """
    posts = posts.select(F.col(id).cast("long").alias("id"), F.col(vec).alias("vec"), instant(ts).alias("at"), "fresh")
    newest = lambda when: F.max(F.when(when, F.struct("at", (-F.col("id")).alias("minus"))))
    base = posts.groupBy("vec").agg(
        newest(F.lit(True)).alias("_last"), newest(~F.col("fresh")).alias("_before"), F.count(F.lit(1)).alias("copies"),
        F.bool_or("fresh").alias("fresh"),
    )
    base = settle(base.select(
        "vec", (-F.col("_last.minus")).alias("rep"), "copies", F.col("_last.at").alias("at"), "fresh",
        (-F.col("_before.minus")).alias("before"), F.col("_before.at").alias("before_at"),
    ))
    alike = base.filter("copies > 1") if eps >= 1 else base.filter(F.col("copies") > 1).filter(~F.forall("vec", lambda e: e == 0))
    earlier = alike.filter("before <> rep and fresh").select(F.col("rep").alias("a"), F.col("before").alias("b"), F.col("before_at").alias("until"))
    hot = alike if not alike.filter(F.col("copies") >= hot_rows).isEmpty() else None
    own = back_to_posts(posts.filter("fresh").select("id", "vec", "at"), "vec", hot, alike.select("vec", "rep"), hot_rows)
    copies = earlier.unionByName(own.filter("rep <> id").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.col("at").alias("until")))

    blocks = block_vectors(base.select("vec", "rep", "copies", "at", "fresh"), eps, block_rows)
    shipped = blocks.shipped()

    def across(key: tuple, table: pa.Table) -> pa.Table:
        out = [], [], []
        if table["fresh"].to_numpy().any():
            a, b, pairs = shipped.meeting(key, table)
            fresh_a, fresh_b, all_a, all_b = (t[c].to_numpy() for c in ("fresh", "at") for t in (a, b))
            reps_a, reps_b = a["rep"].to_numpy(), b["rep"].to_numpy()
            for at, to, own, pair in pairs:
                new_a, new_b, at_a, at_b = fresh_a[at], fresh_b[to], all_a[at], all_b[to]
                if not new_a.any() and not new_b.any():
                    continue
                near = np.zeros((len(new_a), len(new_b)), bool)
                _fill(near, pair, new_a, new_b, shipped.eps)
                if own:
                    np.fill_diagonal(near, False)
                rep_a, rep_b = reps_a[at], reps_b[to]
                for i, j in lasting_forest(near, at_a, at_b, own):
                    for column, value in zip(out, (rep_a[i], rep_b[j], min(at_a[i], at_b[j]))):
                        column.append(value)
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["a", "b", "until"])

    rows = blocks.rows.select("vec", "rep", "at", "fresh", "cell", "block", "shard")
    new_cells = blocks.rows.filter("fresh").select("cell").distinct()
    meeting = blocks.met(rows.filter("fresh")).unionByName(blocks.met(rows.filter("not fresh"), cells_of=new_cells))
    return copies.unionByName(meeting.groupBy("lo", "hi").applyInArrow(across, "a long, b long, until long"))


def _fill(near: np.ndarray, pair: Pair, new_a: np.ndarray, new_b: np.ndarray, eps: float) -> None:
    """``near`` where one side is new; of two old posts the link is known already."""
    for rows, columns in ((np.flatnonzero(new_a), np.arange(len(new_b))), (np.flatnonzero(~new_a), np.flatnonzero(new_b))):
        if not len(rows) or not len(columns):
            continue
        part = Pair(pair.a[rows], pair.b[columns], pair.sure_a[rows], pair.open_a[rows], pair.sure_b[columns], pair.open_b[columns])
        for i, j, found in part.near(eps):
            near[np.ix_(rows[i], columns[j])] |= found


def linked_clusters(posts: DataFrame, links: DataFrame, id: str = "seq", min_samples: int = 2, min_window: int = 3,
                    hot_rows: int = HOT_ROWS) -> DataFrame:
    """``posts`` with ``cluster`` and ``is_core`` as :func:`~tidewatch.operators.incidents.cluster_window` gives them, from
    the links between them. Only for ``min_samples`` up to 2, where any neighbour makes a core."""
    if min_samples > 2:
        raise ValueError("links tell groups of two and more, not the number of neighbours")
    if posts.limit(min_window).count() < min_window:
        return posts.withColumns({"cluster": F.lit(None).cast("long"), "is_core": F.lit(False)})
    found = linked_components(links.select("a", "b"), hot_rows).select(F.col("id").alias(id), F.col("component").alias("cluster"))
    joined = posts.join(found, id, "left")
    if min_samples < 2:
        joined = joined.withColumn("cluster", F.coalesce("cluster", id))
    return joined.withColumn("is_core", F.col("cluster").isNotNull())
