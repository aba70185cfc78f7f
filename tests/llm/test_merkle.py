import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import merkle as M

SCHEMA = "text string, doc_id long, source string, lang string, n_chars long, tree string, at string, part string"


def H(parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return H("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text))


def runs(nodes):
    return [nodes[i : i + 3] for i in range(0, len(nodes), 3)]


def root(nodes):
    while len(nodes) > 1:
        nodes = [H(r) for r in runs(nodes)]
    return nodes[0]


def siblings(nodes, i):
    out = []
    while len(nodes) > 1:
        out.append([d if k != i % 3 else None for k, d in enumerate(runs(nodes)[i // 3])])
        nodes, i = [H(r) for r in runs(nodes)], i // 3
    return out


def plain(rows):
    """The definition, one leaf at a time."""
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        trees.append(sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))))
    tops = [root([leaf(*r) for r in t]) for t in trees]
    out = []
    for s, t in enumerate(trees):
        leaves = [leaf(*r) for r in t]
        for i, r in enumerate(t):
            path = siblings(leaves, i) + siblings(tops, s)
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            cur = leaf(*r[:4], r[4].replace("\n", "") if even and r[4] is not None else r[4])
            for run in path:
                cur = H(d or cur for d in run)
            flat = [d for run in path for d in run if d]
            out.append((r[0], leaves[i], tops[s], root(tops), H(flat), cur, cur == root(tops), tuple(flat)))
    return sorted(out, key=str)


def made(n, seed=1):
    rng = random.Random(seed)
    sources = [None, "", "é", "z", "Z", "\U0001f600", "hot", "hot", "hot", "hot"]
    texts = [None, "", "\n", "a\nb", "plain", "\n\nü\n", "x" * 3000 + "\n"]
    return [(i if i % 17 else None, rng.choice(sources), rng.choice([None, "en"]), rng.choice([None, 5]), rng.choice(texts)) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(r[4], *r[:4], "x", "y", "z") for r in rows], SCHEMA).repartition(5)


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "siblings"]


def got(df):
    return sorted((tuple(tuple(v) if isinstance(v, list) else v for v in (r[c] for c in NAMES)) for r in df.collect()), key=str)


@pytest.mark.parametrize("span", [1, 2, 7])
def test_against_the_definition(spark, span):
    rows = made(230) + made(5) + [(7, "hot", "en", 1, "twice\n")] * 3
    found = M.verify_manifest(frame(spark, rows), M.deleted_newlines(), siblings=True, span=span, hot_rows=10 if span == 2 else 10**6)
    want = plain(rows)
    assert got(found) == want
    assert {w[6] for w in want} == {True, False}


def test_proofs_of_some_rows_fetch_lower_nodes(spark):
    rows = made(200, 4)
    some = F.coalesce(F.col("doc_id") % 29 == 3, F.lit(False))
    found = M.verify_manifest(frame(spark, rows), F.col("text"), where=some, siblings=True, span=2)
    want = [(*w[:5], w[3], True, w[7]) for w in plain(rows) if w[0] is not None and w[0] % 29 == 3]
    assert got(found) == sorted(want, key=str) and len(want) == 6  # the seventh id is null


def test_missing_nodes_are_needed_and_enough():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 4, 9, 10, 28, 100):
        for _ in range(10):
            at = rng.choice(n, rng.integers(1, n + 1), replace=False)
            missing = {(k, int(i)) for k, x in M.missing_nodes(at, n) for i in x}
            known, needed, size, level = set(at.tolist()), set(), n, 0
            while size > 1:
                for i in known:
                    needed |= {(level, j) for j in range(i // 3 * 3, min(i // 3 * 3 + 3, size)) if j not in known}
                known, size, level = {i // 3 for i in known}, -(-size // 3), level + 1
            assert missing == needed


@pytest.mark.parametrize("rows", [[], [(5, "s", "en", 1, "one\nonly")], [(5, None, None, None, None)] * 4, made(3)])
def test_small_tables(spark, rows):
    assert got(M.verify_manifest(frame(spark, rows), M.deleted_newlines(), siblings=True)) == plain(rows)
