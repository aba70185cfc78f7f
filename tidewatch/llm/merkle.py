"""Merkle manifest of a table: a tree per source, a tree over the sources, and proofs by octopus multiproofs.

A node is named by its coordinates ``(tree, level, at)``; every three consecutive nodes of a level have one parent.
Trees are built in rounds of :data:`SPAN` levels, a task folding complete subtrees. For proofs the leaves are dealt into
parts. A part works out from positions alone which nodes it can neither read nor derive (the multiproof), fetches each of
them once by a join, derives what its leaves share, and expands the proof of each leaf.
"""

from __future__ import annotations

from collections.abc import Iterable
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.scale import HOT_ROWS, hot_key_join, running_totals
from ..session import settle
from .common import join_slices, range_slices

FAN = 3
SPAN = 7  # levels that one task builds; a part of leaves has at most two such subtrees' leaves
TOP = -1  # the tree over the sources


def digest_of(fields: Iterable[Column]) -> Column:
    """sha256 (32 bytes) of the fields: ``-`` for null, else UTF-8 byte count, a colon, the value."""
    text = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def levels_above(n: int) -> int:
    """Levels over ``n`` nodes up to the single one."""
    k = 0
    while n > 1:
        n, k = -(-n // FAN), k + 1
    return k


def place_leaves(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves ``(source, doc_id, leaf, ...)`` with their place: ``tree`` (rank of the source, null first, UTF-8 bytewise),
    ``at`` in it by doc_id (null first, equal ones by digest), ``n`` leaves of the tree, ``first``, the leaves of earlier
    trees. Also ``(source, tree, n, first)`` for each source."""
    rows, slices = range_slices(leaves, "source", ["doc_id", "leaf"])
    sources = slices.groupBy("source").agg(F.max("_total").alias("n"))
    ranked = running_totals(sources, ["source"], {"tree": F.lit(1).cast("long"), "first": F.col("n")})
    ranked = settle(ranked.select("source", F.col("tree") - 1, "n", F.col("first") - F.col("n")).toDF("source", "tree", "n", "first"))
    named = ranked.withColumnRenamed("source", "_name")
    slices = slices.join(named, slices["source"].eqNullSafe(named["_name"])).drop("_name", "_total")
    local = F.expr("row_number() over (partition by source, _slice order by doc_id, leaf)") - 1
    placed = join_slices(rows, slices, "source").withColumn("at", F.col("_before") + local)
    return placed.drop("_slice", "_before"), ranked


def _part(first: Column, at: Column, span: int) -> Column:
    """Consecutive leaves, complete subtrees of ``span`` levels only: under ``2 * FAN**span`` of them."""
    size = FAN**span
    return F.floor((first + at - at % size) / size).cast("long")


def _folding(level: int, span: int):
    return lambda table: _subtrees(table, level, span)


def _subtrees(table: pa.Table, level: int, span: int) -> pa.Table:
    """All nodes up to ``span`` levels above the complete subtrees whose base, at ``level``, is in ``table(tree, at, n, digest)``."""
    out: list[tuple] = []
    rows = sorted(zip(table["tree"].to_pylist(), table["at"].to_pylist(), table["n"].to_pylist(), table["digest"].to_pylist()))
    start = 0
    for end in range(1, len(rows) + 1):
        tree, at, n, _ = rows[start]
        if end < len(rows) and rows[end][0] == tree and rows[end][1] // FAN**span == at // FAN**span:
            continue
        nodes = [r[3].hex() for r in rows[start:end]]
        for k in range(1, span + 1):
            if n == 1:
                break
            nodes = [sha256("".join(nodes[i : i + FAN]).encode()).hexdigest() for i in range(0, len(nodes), FAN)]
            at, n = at // FAN, -(-n // FAN)
            out += [(tree, level + k, at + i, n, bytes.fromhex(d)) for i, d in enumerate(nodes)]
        start = end
    columns = zip(*out) if out else [[]] * 5
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["tree", "level", "at", "n", "digest"])


def inner_nodes(base: DataFrame, most: int, span: int = SPAN) -> DataFrame:
    """``(tree, level, at, n, digest)`` of all nodes over the leaves ``base(tree, at, n, digest, first)``; ``n`` counts the
    nodes of the level. ``most`` is the largest tree's number of leaves."""
    key: list = [_part(F.col("first"), F.col("at"), span).alias("part")]
    base, found, level = base.select("tree", "at", "n", "digest", *key), [], 0
    while True:
        nodes = base.groupBy("part").applyInArrow(_folding(level, span), "tree long, level int, at long, n long, digest binary")
        found.append(settle(nodes))
        level += span
        if levels_above(most) <= level:
            break
        up = found[-1].filter((F.col("level") == level) & (F.col("n") > 1)).drop("level")
        base = up.withColumn("part", F.xxhash64("tree", F.floor(F.col("at") / FAN**span)))
    nodes = found[0]
    for more in found[1:]:
        nodes = nodes.unionByName(more)
    return nodes


def missing_nodes(at: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
    """The least set of nodes, by level, from which with the leaves ``at`` of a tree of ``n`` all their proofs follow."""
    known, out, level = np.unique(at), [], 0
    while n > 1:
        parents = np.unique(known // FAN)
        children = (parents[:, None] * FAN + np.arange(FAN)).ravel()
        out.append((level, np.setdiff1d(children[children < n], known, assume_unique=True)))
        known, n, level = parents, -(-n // FAN), level + 1
    return out


def requests_of(asked: DataFrame, n_trees: int) -> DataFrame:
    """``(part, tree, level, at)``: the nodes that each part of ``asked(part, tree, at, n)`` has to fetch."""

    def run(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        tree, at, n = (table[c].to_numpy() for c in ("tree", "at", "n"))
        order = np.argsort(tree, kind="stable")
        trees, starts = np.unique(tree[order], return_index=True)
        wanted = []
        for t, rows in zip(trees.tolist(), np.split(order, starts[1:])):
            wanted += [(t, k, x) for k, x in missing_nodes(at[rows], int(n[rows[0]]))]
        wanted += [(TOP, k, x) for k, x in missing_nodes(trees, n_trees)]
        sizes = np.array([len(x) for _, _, x in wanted], np.int64)
        every = np.concatenate([x for _, _, x in wanted] or [np.zeros(0, np.int64)])
        return pa.table({
            "part": pa.array(np.full(len(every), part, np.int64)),
            "tree": pa.array(np.repeat(np.array([t for t, _, _ in wanted], np.int64), sizes)),
            "level": pa.array(np.repeat(np.array([k for _, k, _ in wanted], np.int32), sizes)),
            "at": pa.array(every.astype(np.int64)),
        })

    return asked.select("part", "tree", "at", "n").groupBy("part").applyInArrow(run, "part long, tree long, level int, at long")


class Derived:
    """The nodes of one tree that a part knows: leaves, fetched ones, and what follows from them. Digests are hex bytes."""

    def __init__(self, leaves: dict[int, bytes], fetched: dict[int, dict[int, bytes]], n: int):
        self.sides: list[dict[int, tuple[bytes, bytes]]] = []  # per level, of nodes on a leaf's path: left and right of it
        known, level = leaves, 0
        while n > 1:
            held, sides, above = known | fetched.get(level, {}), {}, {}
            for parent in {at // FAN for at in known}:
                first = parent * FAN
                run = [held[i] for i in range(first, min(first + FAN, n))]
                for i in range(len(run)):
                    if first + i in known:
                        sides[first + i] = b"".join(run[:i]), b"".join(run[i + 1 :])
                above[parent] = sha256(b"".join(run)).hexdigest().encode()
            self.sides.append(sides)
            known, n, level = above, -(-n // FAN), level + 1
        self.root = next(iter(known.values()))

    def proofs(self, above: bytes) -> dict[int, bytes]:
        """Per leaf all siblings from its level up, end to end, then ``above``; equal upper parts are joined once."""
        path = {0: above}
        for sides in reversed(self.sides):
            path = {at: left + right + path[at // FAN] for at, (left, right) in sides.items()}
        return path

    def fold(self, at: int, digest: bytes) -> bytes:
        """The root that follows from ``digest`` in the place of the leaf ``at``."""
        for sides in self.sides:
            left, right = sides[at]
            digest = sha256(left + digest + right).hexdigest().encode()
            at //= FAN
        return digest


def expand_proofs(asked: DataFrame, fetched: DataFrame, n_trees: int, siblings: bool) -> DataFrame:
    """Per leaf of ``asked`` its subroot, the root, the digest of its siblings, the root that ``checked`` folds to, and, if
    wanted, the siblings themselves."""
    schema = "doc_id long, source string, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    schema += ", siblings array<string>" if siblings else ""

    def run(leaves: pa.Table, nodes: pa.Table) -> pa.Table:
        fetched: dict[int, dict[int, dict[int, bytes]]] = {}
        for tree, level, at, digest in zip(*(nodes[c].to_pylist() for c in ("tree", "level", "at", "digest"))):
            fetched.setdefault(tree, {}).setdefault(level, {})[at] = digest.hex().encode()
        tree, at, n = (leaves[c].to_pylist() for c in ("tree", "at", "n"))
        digests, sizes = {}, {}
        for t, a, size, leaf in zip(tree, at, n, leaves["leaf"].to_pylist()):
            digests.setdefault(t, {})[a], sizes[t] = leaf.hex().encode(), size
        trees = {t: Derived(d, fetched.get(t, {}), sizes[t]) for t, d in digests.items()}
        top = Derived({t: tree.root for t, tree in trees.items()}, fetched.get(TOP, {}), n_trees)
        above = top.proofs(b"")
        proofs = {t: tree.proofs(above[t]) for t, tree in trees.items()}
        paths = [proofs[t][a] for t, a in zip(tree, at)]
        folded = [top.fold(t, trees[t].fold(a, c.hex().encode())) for t, a, c in zip(tree, at, leaves["checked"].to_pylist())]
        columns = [
            leaves["doc_id"], leaves["source"], [d.hex() for d in leaves["leaf"].to_pylist()], [trees[t].root.decode() for t in tree],
            [top.root.decode()] * len(tree), [sha256(p).hexdigest() for p in paths], [f.decode() for f in folded],
        ]
        if siblings:
            each = [[p[i : i + 64].decode() for i in range(0, len(p), 64)] for p in paths]
            columns.append(pa.array(each, pa.list_(pa.string())))
        names = [c.split()[0] for c in schema.split(", ")]
        return pa.table(columns, names=names)

    return asked.groupBy("part").cogroup(fetched.groupBy("part")).applyInArrow(run, schema)


def verify_manifest(docs: DataFrame, checked: Column, where: Column | None = None, siblings: bool = False,
                    span: int = SPAN, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Build the manifest of ``docs(doc_id, source, lang, n_chars, text)`` and check texts against it.

    Per row: ``doc_id, source, leaf, subroot, root, proof_sha256``, all of the table as it is, ``folded_root``, which follows
    from the row with the text ``checked`` in place of its own and the row's original siblings, and ``verified``, whether
    that is the root. ``where`` picks rows to prove; all of them if none is given. ``siblings`` adds the proof itself, from
    the leaf's level up to the root, left to right.

    Nulls are a value of their own in every column, different from empty texts; a null source is the first tree, null
    ids come first in theirs. Repeated rows are leaves of their own, ordered by digest where ids are equal, so the result
    does not depend on the order of the input. Texts are hashed where they lie, whatever their length, and never
    shuffled. An empty table gives no rows. Other columns are ignored. ``doc_id`` has to be an integer.
    """
    own = [F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang"), F.col("n_chars")]
    text = F.col("text").cast("string")
    rows = docs.select(
        own[0].alias("doc_id"), own[1].alias("source"), digest_of([*own, text]).alias("leaf"),
        digest_of([*own, checked.cast("string")]).alias("checked"), (F.lit(True) if where is None else where).alias("wanted"),
    )
    placed, sources = place_leaves(settle(rows))
    leaves = settle(placed.withColumn("part", _part(F.col("first"), F.col("at"), span)))
    n_trees, most = sources.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()

    inner = inner_nodes(leaves.select("tree", "at", "n", "first", F.col("leaf").alias("digest")), most, span)
    single = leaves.filter("n = 1").select("tree", F.col("leaf").alias("digest"))
    roots = settle(single.unionByName(inner.filter("n = 1").select("tree", "digest")))
    top = roots.select(
        F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(n_trees).cast("long").alias("n"), "digest",
        F.lit(0).cast("long").alias("first"),
    )
    named = ["tree", "level", "at", "digest"]
    nodes = inner.select(*named).unionByName(top.withColumn("level", F.lit(0)).select(*named))
    nodes = nodes.unionByName(inner_nodes(top, n_trees, span).select(*named))

    asked = leaves.filter("wanted")
    requests = settle(requests_of(asked, n_trees))
    key = ["tree", "level", "at"]
    # Whole parts ask for no single leaf; only then are the leaves not needed as nodes.
    if not requests.filter(f"level = 0 and tree <> {TOP}").isEmpty():
        nodes = nodes.unionByName(leaves.select("tree", F.lit(0).alias("level"), "at", F.col("leaf").alias("digest")))
    hot = settle(requests.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") >= hot_rows))
    fetched = hot_key_join(requests, nodes, key, hot, "inner")
    proven = expand_proofs(asked.drop("wanted", "first"), fetched, n_trees, siblings)
    return proven.withColumn("verified", F.col("folded_root") == F.col("root"))


def deleted_newlines(key: str = "doc_id", text: str = "text") -> Column:
    """The text as a careless copy has it: without line feeds where 2 divides the crc32 of the decimal id."""
    hit = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 2 == 0, F.lit(False))
    return F.when(hit, F.translate(F.col(text), "\n", "")).otherwise(F.col(text))
