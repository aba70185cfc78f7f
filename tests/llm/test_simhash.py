import random
import re

import numpy as np
import xxhash

from tidewatch.llm import simhash as S
from tidewatch.llm.common import forest, link_labels


def plain(text):
    """The definition, one bit at a time."""
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(points, radius):
    """doc -> smallest linked doc, by comparing every pair."""
    best = {i: i for i, _ in points}
    changed = True
    while changed:
        changed = False
        for i, a in points:
            for j, b in points:
                if bin(a ^ b).count("1") <= radius and best[j] > best[i]:
                    best[j], changed = best[i], True
    return best


def test_fingerprint_is_the_definition():
    rng = random.Random(1)
    texts = [None, "", " \t\r\n", "One", "one TWO", "a b c", "Ä é\x0bzwei\x0c drei  vier", "x " * 70000]
    texts += [" ".join(rng.choice("the cat sat On a Mat".split()) for _ in range(rng.randrange(60))) for _ in range(50)]
    for t in texts:
        assert S.fingerprint((t or "").encode()) == plain(t), t


def test_near_pairs_finds_all():
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**63, 400, dtype=np.uint64)
    near = [s ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for s in seeds[:200] for a, b in rng.integers(0, 64, (4, 2))]
    fp = np.unique(np.concatenate((seeds, np.array(near, np.uint64))))
    want = {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if int(fp[i] ^ fp[j]).bit_count() <= 2}
    got = {(min(a, b), max(a, b)) for i, j in S.near_pairs(fp, 2, leaf=32) for a, b in zip(i.tolist(), j.tolist())}
    assert got == want
    tree = S.grow_tree(fp, 4, 2)
    row, shard = S.route(fp, *tree, 2)
    homes = {}
    for r, s in zip(row.tolist(), shard.tolist()):
        homes.setdefault(r, set()).add(s)
    assert all(homes[i] & homes[j] for i, j in want)
    assert len(row) < 4 * len(fp)


def test_forest_keeps_components():
    a, b = np.array([5, 1, 2, 7, 7]), np.array([1, 2, 3, 8, 8])
    assert link_labels(9, a, b).tolist() == [0, 1, 1, 1, 4, 1, 6, 7, 7]
    assert sorted(zip(*(x.tolist() for x in forest(9, a, b)))) == [(2, 1), (3, 1), (5, 1), (8, 7)]


def test_groups_against_all_pairs(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefghijklmnop") * 3 for _ in range(80)) for _ in range(12)]
    rows = [(100 + i, t) for i, t in enumerate(base)]
    rows += [(200 + i, t.replace("aaa", "zzz", 1)) for i, t in enumerate(base)] + [(300, base[0]), (300, base[0])]
    rows += [(1, None), (2, ""), (3, "  "), (None, base[1]), (None, "alone without any number")]
    docs = spark.createDataFrame([(i, t, "other", 1, "x") for i, t in rows], "doc_id long, text string, fp string, id int, component string")
    got = S.simhash_groups(docs).collect()
    assert len(got) == len(rows)
    want = groups([(i, plain(t)) for i, t in rows if i is not None], 2)
    for r in got:
        if r["doc_id"] is not None:
            assert r["component_id"] == want[r["doc_id"]]
    assert sorted(str(r["component_id"]) for r in got if r["doc_id"] is None) == ["101", "None"]
    assert {r["fingerprint"] for r in got if r["doc_id"] in (1, 2, 3)} == {"0" * 16}
    assert S.simhash_groups(docs.limit(0)).count() == 0


def test_any_64_bit_id(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(2**63 - 1, text), (2**62 + 5, text), (2**62 + 9, "other words here"), (-(2**63), ""), (None, text), (2**62 + 9, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.component_id) for r in S.simhash_groups(docs).collect())
    assert got == sorted([(str(2**63 - 1), 2**62 + 5), (str(2**62 + 5), 2**62 + 5), (str(2**62 + 9), 2**62 + 9),
                          (str(-(2**63)), -(2**63)), ("None", 2**62 + 5), (str(2**62 + 9), -(2**63))])


def test_sharded_links_equal_unsharded(spark):
    rng = np.random.default_rng(9)
    seeds = rng.integers(-(2**62), 2**62, 300)
    fp = np.unique(np.concatenate((seeds, seeds[:150] ^ 5, seeds[:100] ^ 12)))
    points = spark.createDataFrame([(int(i), int(f)) for i, f in enumerate(fp)], "id long, fp long")
    links = S.near_links(points, 2, shard_rows=40).toPandas()
    whole = link_labels(len(fp), *S.shard_links(fp.astype(np.int64).view(np.uint64), 2))
    assert np.array_equal(link_labels(len(fp), links["a"].to_numpy(), links["b"].to_numpy()), whole)
