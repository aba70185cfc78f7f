"""Clusters of a moving window, kept by links, against clustering it anew."""

import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import incidents as I, sliding as L
from tidewatch.operators.window import active_window

START = dt.datetime(2024, 5, 1, 10)


def groups(n, edges):
    label = list(range(n))
    for _ in range(n):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


@pytest.mark.parametrize("own", [True, False])
def test_forest_keeps_the_groups_at_every_moment(own):
    rng = np.random.default_rng(own)
    for _ in range(30):
        a, b = rng.integers(2, 9, 2)
        near = rng.random((a, a if own else b)) < 0.4
        if own:
            near = np.triu(near, 1) | np.triu(near, 1).T
        at_a = rng.integers(0, 5, a)
        at_b = at_a if own else rng.integers(0, 5, b)
        kept = L.lasting_forest(near, at_a, at_b, own)
        at = at_a if own else np.concatenate([at_a, at_b])
        shift = 0 if own else a
        edges = [(i, shift + j) for i, j in zip(*np.nonzero(near))]
        kept = [(i, shift + j) for i, j in kept]
        assert set(kept) <= set(edges) and len(kept) < len(at)
        for moment in range(6):
            alive = lambda e: min(at[e[0]], at[e[1]]) >= moment  # noqa: B023, E731
            assert groups(len(at), [e for e in kept if alive(e)]) == groups(len(at), [e for e in edges if alive(e)])


def test_window_after_every_batch(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 6))
    links, posts, seq = None, [], itertools.count()
    schema = "seq long, embedding array<float>, ts timestamp, batch int"
    for batch in range(4):
        minute = 7 * batch
        for _ in range(30):
            v = centres[rng.integers(5)] + 0.25 * rng.normal(size=6) if rng.random() < 0.8 else rng.normal(size=6)
            if rng.random() < 0.1:
                v = np.zeros(6)
            if posts and rng.random() < 0.25:
                v = np.array(posts[rng.integers(len(posts))][1])  # a copy of an earlier vector
            late = rng.integers(0, 15) if rng.random() < 0.3 else 0
            when = START + dt.timedelta(minutes=minute - int(late), seconds=int(rng.integers(60)))
            posts.append((next(seq), np.float32(v).tolist(), when, batch))
        now = max(p[2] for p in posts)
        window = active_window(spark.createDataFrame(posts, schema), now, 15)
        new = L.fresh_links(window.withColumn("fresh", F.col("batch") == batch), eps=0.1, block_rows=40, hot_rows=5)
        links = sorted({*(links or []), *map(tuple, new.collect())})
        cut = int((now - dt.timedelta(minutes=15) - dt.datetime(1970, 1, 1)).total_seconds() * 10**6)
        links = [x for x in links if x[2] >= cut]  # what has ended is forgotten
        kept = spark.createDataFrame(links, "a long, b long, until long")
        got = {r.seq: (r.cluster, r.is_core) for r in L.linked_clusters(window, kept, hot_rows=5).collect()}
        want = {r.seq: (r.cluster, r.is_core) for r in I.cluster_window(window, eps=0.1).collect()}
        assert got == want
        assert len({c for c, _ in got.values()}) > 3
    assert len(got) < len(posts)


def test_small_windows(spark):
    rows = spark.createDataFrame([(1, [1.0], START, True), (2, [1.0], START, True)], "seq long, embedding array<float>, ts timestamp, fresh boolean")
    links = L.fresh_links(rows)
    assert [r.cluster for r in L.linked_clusters(rows, links).collect()] == [None, None]
    assert {r.cluster for r in L.linked_clusters(rows, links, min_window=2).collect()} == {1}
    assert L.fresh_links(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        L.linked_clusters(rows, links, min_samples=3)
