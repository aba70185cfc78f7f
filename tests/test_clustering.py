import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import incidents as I, similarity as N
from tidewatch.operators.components import components
from tidewatch.operators.scale import hot_key_join, running_rank, running_totals


def brute_components(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(n)}


@pytest.mark.parametrize("hot_rows", [3, 1_000_000])
def test_components_on_chains_stars_and_random_graphs(spark, hot_rows):
    rng = random.Random(hot_rows)
    n = 300
    edges = [(i, i + 1) for i in range(99)] + [(100, 101 + i) for i in range(80)]
    edges += [(rng.randrange(190, n), rng.randrange(190, n)) for _ in range(60)]
    nodes = spark.createDataFrame([(i,) for i in range(n)], "id long")
    found = components(nodes, spark.createDataFrame(edges, "a long, b long"), hot_rows).collect()
    assert {r.id: r.component for r in found} == brute_components(n, edges)


def brute_clusters(x, eps, min_samples):
    """Density clustering by definition, labels being the smallest core index."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    u = x / np.where(norm == 0, 1, norm)
    near = (1 - u @ u.T) <= eps
    np.fill_diagonal(near, True)
    core = near.sum(axis=1) >= min_samples
    n = len(x)
    comp = brute_components(n, [(i, j) for i in range(n) for j in range(i) if near[i, j] and core[i] and core[j]])
    out = []
    for i in range(n):
        if core[i]:
            out.append(comp[i])
        else:
            out.append(min((comp[j] for j in range(n) if near[i, j] and core[j]), default=None))
    return out, near.sum(axis=1) - 1


def vectors(spark, x):
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "seq long, embedding array<float>")


def sample(seed=7):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 6))
    x = np.concatenate([c + 0.35 * rng.normal(size=(12, 6)) for c in centres] + [rng.normal(size=(20, 6))])
    x = np.concatenate([x, np.repeat(x[:1], 30, axis=0), np.zeros((3, 6))])  # many copies, zero vectors
    return x.astype(np.float32).astype(float)


@pytest.mark.parametrize("min_samples,block_rows,hot_rows", [(1, 40, 5), (2, 12, 5), (2, 1000, 10**6), (4, 30, 5)])
def test_clusters_match_brute_force_for_any_blocking(spark, min_samples, block_rows, hot_rows):
    x = sample()
    want, _ = brute_clusters(x, 0.08, min_samples)
    found = I.cluster_window(
        vectors(spark, x), eps=0.08, min_samples=min_samples, block_rows=block_rows, hot_rows=hot_rows
    ).collect()
    assert len(found) == len(x)
    assert {r.seq: r.cluster for r in found} == dict(enumerate(want))


def test_neighbour_counts_match_brute_force(spark):
    x = sample(3)
    _, degree = brute_clusters(x, 0.08, 2)
    found = N.neighbour_counts(vectors(spark, x), "seq", "embedding", 0.08, block_rows=10, hot_rows=5).collect()
    assert {r.seq: r.neighbours for r in found} == dict(enumerate(degree.tolist()))


def test_pivots_skip_far_pairs_and_keep_the_counts(spark):
    rng = np.random.default_rng(5)
    centres = np.linalg.qr(rng.normal(size=(16, 16)))[0]
    tight = np.concatenate([c + 0.02 * rng.normal(size=(40, 16)) for c in centres]).astype(np.float32).astype(float)
    loose = rng.normal(size=(640, 16)).astype(np.float32).astype(float)
    used = {}
    for name, x, eps in (("tight", tight, 0.01), ("sure", tight, 0.5), ("loose", loose, 0.4)):
        _, degree = brute_clusters(x, eps, 2)
        found = N.neighbour_counts(vectors(spark, x), "seq", "embedding", eps, block_rows=25).collect()
        assert {r.seq: r.neighbours for r in found} == dict(enumerate(degree.tolist()))
        used[name] = N.comparisons(vectors(spark, x), "seq", "embedding", eps, block_rows=25).first()
        assert used[name].vectors == 640 and used[name].every == 640 * 639 // 2
    assert used["loose"].compared > 0.5 * used["loose"].every
    assert used["tight"].compared < 0.12 * used["tight"].every  # 1 / 16 of all pairs are inside a cluster
    assert used["sure"].compared < 0.05 * used["sure"].every  # most need no comparison at all


def test_vectors_are_sent_as_often_however_many_blocks_there_are(spark):
    x = np.random.default_rng(9).normal(size=(900, 8)).astype(np.float32).astype(float)
    bound = math.ceil(math.sqrt(4 * spark.sparkContext.defaultParallelism)) + 1
    for rows in (150, 900):
        blocks = N.blocked(vectors(spark, x[:rows]), "seq", "embedding", 0.65, block_rows=10)
        assert blocks.rows.select("block").distinct().count() > bound
        assert blocks.met(blocks.rows).count() <= rows * bound
    assert N.shard_rows(10**7, 64, 12) * 64 * 8 <= N.SHARD_BYTES


@pytest.mark.parametrize("eps, min_samples", [(0.01, 5), (0.5, 3), (1.0, 2), (1.2, 4), (2.0, 3)])
def test_clusters_of_tight_groups(spark, eps, min_samples):
    rng = np.random.default_rng(6)
    x = np.concatenate([c + 0.03 * rng.normal(size=(25, 5)) for c in rng.normal(size=(5, 5))] + [np.zeros((2, 5)), -np.eye(5)])
    x = x.astype(np.float32).astype(float)
    want, _ = brute_clusters(x, eps, min_samples)
    found = I.cluster_window(vectors(spark, x), eps=eps, min_samples=min_samples, block_rows=20).collect()
    assert {r.seq: r.cluster for r in found} == dict(enumerate(want))


def test_chain_joins_ends_that_are_far_apart(spark):
    angles = [0.0, 0.8, 1.6]
    x = [[np.cos(a), np.sin(a)] for a in angles] + [[-1.0, -1.0]]
    found = {r.seq: r.cluster for r in I.cluster_window(vectors(spark, x), eps=0.4).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: None}


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_small_windows_are_all_noise(spark, n):
    found = I.cluster_window(vectors(spark, [[1.0, 0.0]] * n) if n else vectors(spark, [[1.0]]).limit(0)).collect()
    assert [r.cluster for r in found] == ([0, 0, 0] if n == 3 else [None] * n)


def test_density_and_representative(spark):
    rows = [(1, 1, "short", [1.0, 0.0]), (1, 2, "longer text", [0.0, 2.0]), (1, 3, "LONGER TEXT", [3.0, 3.0]), (2, 4, "x", [0.0, 0.0])]
    df = spark.createDataFrame(rows, "c long, seq long, text string, v array<double>")
    got = {r.c: r.density for r in I.cluster_density(df, "c", "v").collect()}
    assert got[2] == 0.5 and got[1] == pytest.approx((0 + 2 * 0.5**0.5) / 3)
    best = {r.c: r.t for r in df.groupBy("c").agg(I.representative("text", "seq").alias("t")).collect()}
    assert best == {1: "longer text", 2: "x"}


def test_running_totals_with_one_large_group(spark):
    rng = random.Random(1)
    rows = [("big" if i % 3 else f"g{i % 7}", rng.random(), i, rng.randrange(5)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, x double, i long, n long")
    got = running_totals(df, ["x", "i"], {"total": F.col("n")}, within=["g"], slices=9).collect()
    want, so_far = {}, {}
    for g, x, i, n in sorted(rows, key=lambda r: (r[1], r[2])):
        so_far[g] = so_far.get(g, 0) + n
        want[i] = so_far[g]
    assert {r.i: r.total for r in got} == want
    ranks = running_rank(df, [F.desc("x"), "i"], "place", slices=5).collect()
    order = sorted(rows, key=lambda r: (-r[1], r[2]))
    assert {r.i: r.place for r in ranks} == {r[2]: k + 1 for k, r in enumerate(order)}


def test_hot_key_join_equals_plain_join(spark):
    facts = spark.createDataFrame([(i % 3 if i % 2 else 0, i) for i in range(100)] + [(9, 100)], "k long, i long")
    dim = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "k long, v string")
    hot = spark.createDataFrame([(0,)], "k long")
    for how in ("left", "inner"):
        got = hot_key_join(facts, dim, ["k"], hot, how).select("k", "i", "v").collect()
        want = facts.join(dim, "k", how).select("k", "i", "v").collect()
        assert sorted(got, key=str) == sorted(want, key=str)


def posts(spark, rows):
    return spark.createDataFrame(rows, "post_id string, seq long, text string, ts timestamp_ntz, embedding array<float>")


def test_incidents_of_a_small_window(spark):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1, 12)
    near, far = [1.0, 0.0], [0.0, 1.0]
    rows = [
        ("a", 1, "help at the bridge", t0, near),
        ("b", 2, "water at the bridge is rising", t0 + dt.timedelta(minutes=5), near),
        ("c", 3, "calm", t0 + dt.timedelta(minutes=30), far),
    ]
    from tidewatch.operators.window import active_window

    df = posts(spark, rows)
    active = active_window(df, "2024-01-01 12:30:00", 30)
    assert active.count() == 3  # the bound belongs to the window
    found, members = I.find_incidents(active, "2024-01-01 12:30:00")
    by = {r.cluster_id if not r.lone else "lone": r for r in found.collect()}
    assert by["c_000"].post_count == 2 and by["c_000"].representative_text == "water at the bridge is rising"
    assert by["c_000"].urgency_score == pytest.approx(0.4 * 0.5 + 0.4 * 1.0 + 0.2 * (5 / 30))
    assert by["c_000"].urgency_label == "HIGH"
    assert by["lone"].urgency_score == pytest.approx(0.4) and by["lone"].urgency_label == "HIGH"
    assert members.count() == 3
    assert active_window(df, "2024-01-01 12:30:00.000001", 30).count() == 2


def test_distinct_text_counts_a_repeated_text_once(spark):
    import datetime as dt

    rows = [(str(i), i, "same", dt.datetime(2024, 1, 1), [1.0, 0.0]) for i in range(5)]
    rows += [("9", 9, "other", dt.datetime(2024, 1, 1), [0.0, 1.0]), ("8", 8, "third", dt.datetime(2024, 1, 1), [-1.0, 0.0])]
    plain, _ = I.find_incidents(posts(spark, rows), "2024-01-01 00:00:00")
    assert sorted(r.post_count for r in plain.collect()) == [1, 1, 5]
    once, _ = I.find_incidents(posts(spark, rows), "2024-01-01 00:00:00", distinct_text=True)
    assert sorted(r.post_count for r in once.collect()) == [1, 1, 1]


def test_size_estimates_do_not_multiply_from_round_to_round(spark, monkeypatch):
    from pyspark.sql import functions as F
    from tidewatch.operators import components as C

    bits, settle = [], C.settle

    def noted(df):
        bits.append(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length())
        return settle(df)

    monkeypatch.setattr(C, "settle", noted)
    chain = spark.range(600).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = C.linked_components(chain).collect()
    assert len(found) == 601 and {r.component for r in found} == {0}
    assert len(bits) > 10 and max(bits) < 2_000  # digits tripled in each round before
