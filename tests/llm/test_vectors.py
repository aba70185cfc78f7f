import numpy as np

from tidewatch.llm import vectors as V


def plain(rows, threshold):
    ok = lambda x: x is not None and len(x) and all(v is not None and np.isfinite(v) for v in x) and any(x)
    links = {k: set() for k in range(len(rows))}
    for p, (_, x, l) in enumerate(rows):
        for q, (_, y, m) in enumerate(rows):
            if p != q and l is not None and l == m and ok(x) and ok(y) and len(x) == len(y):
                u, v = np.array(x, float), np.array(y, float)
                if u @ v / np.sqrt((u @ u) * (v @ v)) >= threshold:
                    links[p].add(q)
    name = {k: rows[k][0] for k in links}
    changed = True
    while changed:
        changed = False
        for p in links:
            for q in links[p]:
                best = min((n for n in (name[p], name[q]) if n is not None), default=None)
                if name[p] != best or name[q] != best:
                    name[p] = name[q] = best
                    changed = True
    return sorted(((rows[k][0], len(links[k]), name[k], rows[k][0] == name[k]) for k in links), key=str)


def test_tile_finds_what_whole_products_find():
    rng = np.random.default_rng(1)
    x = V.unit(np.concatenate((rng.normal(size=(80, 48)), np.ones((20, 48)) + 0.3 * rng.normal(size=(20, 48)))))
    for threshold in (0.3, 0.9, 0.99):
        for axes in (V.principal_axes(x), np.eye(48)):
            i, j = V.tile_links(x, x[:70], axes, threshold, False)
            assert set(zip(i.tolist(), j.tolist())) == set(zip(*(v.tolist() for v in np.nonzero(x @ x[:70].T >= threshold))))
            i, j = V.tile_links(x, x, axes, threshold, True)
            assert set(zip(i.tolist(), j.tolist())) == set(zip(*(v.tolist() for v in np.nonzero(np.triu(x @ x.T >= threshold, 1)))))


def test_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 10))
    rows = [(i, (base[i % 12] + 0.12 * rng.normal(size=10)).astype(np.float32).tolist(), i % 3) for i in range(120)]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 0), (202, rows[0][1], 1), (203, rows[0][1], None), (200, rows[0][1], 0)]
    rows += [(204, [0.0] * 10, 0), (205, None, 0), (206, [float("nan")] + [1.0] * 9, 0), (207, [None] + [1.0] * 9, 0),
             (208, [float("inf")] + [1.0] * 9, 0), (209, [], 0), (210, [1.0, 2.0], 0), (211, [2.0, 4.0], 0),
             (None, rows[3][1], 0), (None, [5.0, -1.0], 2), (212, [2 * v for v in rows[0][1]], 0)]
    far = rng.normal(size=10).tolist()
    rows += [((1 << 62) + 9, far, 0), ((1 << 62) + 5, [3 * v for v in far], 0), ((1 << 63) - 1, far, 1), (None, far, 1), (-5, far, 2)]
    data = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, id int, n int")
    got = V.link_vectors(data, 0.93, block_rows=16).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, 0.93)
    assert V.link_vectors(data.limit(0)).count() == 0
