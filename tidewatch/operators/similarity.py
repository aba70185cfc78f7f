"""Neighbours under cosine distance, exactly, with spherical pivots.

Vectors are dealt to the nearest of a bounded number of pivots and on into blocks of bounded size. Angles obey the triangle
inequality: two blocks whose pivots are further apart than both radii and the search angle hold no neighbours and never
meet. Blocks near each other travel together, as shards: a vector is sent once to each shard that it meets, and shards are as
few as cores and a task's memory allow, so what is shuffled grows with the vectors, not with pairs of blocks. In a pair of blocks that does, a vector is left out if it is too far from the other block's pivot, and needs no
comparison if it is so near that everything there is its neighbour. On data without clusters little is left out, and
all pairs of blocks are compared. What leaves a task is linear in its rows (counts, or the links that join groups), never
the pairs themselves. Exact copies are compared once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import let
from ..session import settle
from .scale import HOT_ROWS, hot_key_join

BLOCK_ROWS = 8192
TILE_ROWS = 1024
SHARD_BYTES = 64 << 20  # vectors of a shard in double precision; a task holds two shards
MAX_PIVOTS = 1024  # bounds what is sent to every task: the pivots, and which of their cells may hold neighbours
PIVOT_SAMPLE = 4096  # vectors that the pivots are chosen from; the choice decides the work, never a neighbour
MARGIN = 1e-6  # of an angle, far above the rounding of arccos


def unit_vector(c) -> Column:
    """Scale to length 1; the zero vector stays as it is."""
    v = F.col(c) if isinstance(c, str) else c
    return let(
        v.cast("array<double>"),
        lambda x: let(
            F.sqrt(F.aggregate(x, F.lit(0.0), lambda acc, e: acc + e * e)),
            lambda n: F.transform(x, lambda e: e / F.when(n == 0, F.lit(1.0)).otherwise(n)),
        ),
    )


def distinct_vectors(df: DataFrame, id: str, vec: str) -> DataFrame:
    """One row per different vector: smallest id, number of copies. The vectors keep their type (floats are shipped as floats)."""
    return df.groupBy(F.col(vec).alias("vec")).agg(F.min(id).cast("long").alias("rep"), F.count(F.lit(1)).alias("copies"))


def pivot_count(n: int, parallelism: int, block_rows: int = BLOCK_ROWS) -> int:
    """Enough cells to give every core a pair of them and to tell clusters apart, few enough to send to every task."""
    wanted = max(math.ceil(n / block_rows), math.ceil(math.sqrt(2 * parallelism)), math.ceil(math.sqrt(n) / 4))
    return min(n, wanted, MAX_PIVOTS)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit rows in double precision; the zero vector stays as it is."""
    if not len(column):
        return np.zeros((0, 1))
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    norm[norm == 0] = 1.0
    return x / norm


def _angles(x: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    """Angles to a pivot, or to each of several (columns). The zero vector is at a right angle to all, as its distance says."""
    return np.arccos(np.clip(x @ pivot.T, -1.0, 1.0)) if len(x) else np.zeros((0, *pivot.shape[:-1]))


def spread_pivots(x: np.ndarray, count: int) -> np.ndarray:
    """``count`` rows of ``x``, each the furthest from all before it, so that no cluster of the sample is left without one."""
    picked, angle = [0], _angles(x, x[0]) if len(x) else []
    while len(picked) < min(count, len(x)):
        picked.append(int(angle.argmax()))
        angle = np.minimum(angle, _angles(x, x[picked[-1]]))
    return x[picked] if len(x) else x


def _chain(apart: np.ndarray) -> np.ndarray:
    """An order of the pivots in which each is followed by the nearest one left."""
    left, order = np.ones(len(apart), bool), []
    while len(order) < len(apart):
        at = int(np.where(left, apart[order[-1]], np.inf).argmin()) if order else 0
        left[at] = False
        order.append(at)
    return np.array(order, np.int64)


def search_angle(eps: float) -> float:
    return float(np.arccos(np.clip(1.0 - eps, -1.0, 1.0)))


def _tiles(a: np.ndarray, b: np.ndarray, eps: float):
    """Boolean ``distance <= eps`` in slices of rows of ``a``."""
    for start in range(0, len(a), TILE_ROWS):
        yield start, (1.0 - a[start : start + TILE_ROWS] @ b.T) <= eps


@dataclass
class Pair:
    """Two blocks that meet (or one with itself), as unit rows, split by the triangle bounds: ``sure`` rows are near all rows
    of the other side, ``open`` ones have to be compared with the other side's open ones, the others are near its sure
    rows only."""

    a: np.ndarray
    b: np.ndarray
    sure_a: np.ndarray
    open_a: np.ndarray
    sure_b: np.ndarray
    open_b: np.ndarray

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray, pivot_a: np.ndarray, pivot_b: np.ndarray, eps: float) -> Pair:
        theta = search_angle(eps)

        def split(x: np.ndarray, other: np.ndarray, pivot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            radius, angle = _angles(other, pivot).max(initial=0.0), _angles(x, pivot)
            sure = angle + radius < theta - MARGIN
            return sure, (angle - radius <= theta + MARGIN) & ~sure

        return cls(a, b, *split(a, b, pivot_b), *split(b, a, pivot_a))

    @property
    def compared(self) -> int:
        return int(self.open_a.sum()) * int(self.open_b.sum())

    def tiles(self, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(rows of a, rows of b, near)`` of the open rows."""
        i, j = np.flatnonzero(self.open_a), np.flatnonzero(self.open_b)
        if len(i) and len(j):
            y = self.b[j]
            for start, near in _tiles(self.a[i], y, eps):
                yield i[start : start + len(near)], j, near

    def near(self, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """As :meth:`tiles`, with the sure rows too; together every near pair once."""
        for i in np.array_split(np.flatnonzero(self.sure_a), max(1, -(-int(self.sure_a.sum()) // TILE_ROWS))):
            if len(i):
                yield i, np.arange(len(self.b)), np.ones((len(i), len(self.b)), bool)
        i, j = np.flatnonzero(self.open_a), np.flatnonzero(self.sure_b)
        for part in np.array_split(i, max(1, -(-len(i) // TILE_ROWS))):
            if len(part) and len(j):
                yield part, j, np.ones((len(part), len(j)), bool)
        yield from self.tiles(eps)


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def _join_groups(parent: np.ndarray, rows: np.ndarray, cols: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Merge groups that ``near`` connects. ``parent`` holds each node's group root; ``rows``
    and ``cols`` say which node a matrix row or column stands for.

    Each step keeps one link per row that still reaches another group, so a dense matrix
    costs a few passes over it instead of one step per pair.
    """
    while True:
        parent = _roots(parent)
        foreign = near & (parent[rows][:, None] != parent[cols][None, :])
        pick = foreign.argmax(axis=1)
        hit = foreign[np.arange(len(rows)), pick]
        if not hit.any():
            return parent
        a, b = parent[rows[hit]], parent[cols[pick[hit]]]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


@dataclass
class Blocks:
    """Distinct vectors ``rows(vec, rep, copies, cell, block, shard, ...)`` in blocks around pivots, and those in shards."""

    rows: DataFrame
    pivots: np.ndarray
    cells: DataFrame  # cell, first, last: the shards that its blocks are in
    partners: DataFrame  # cell, others: cells that may hold neighbours; at most MAX_PIVOTS squared numbers in all
    meets: np.ndarray  # the same as a matrix
    eps: float
    posts: int
    most: int

    def met(self, rows: DataFrame, own: bool = True, cells_of: DataFrame | None = None) -> DataFrame:
        """``rows`` once for each pair of shards ``(lo, hi)`` that they meet in; without ``own``, no shard meets itself.
        ``cells_of`` leaves only partners among its cells."""
        others = self.cells if cells_of is None else cells_of.join(self.cells, "cell")
        others = others.select(F.col("cell").alias("other"), F.explode(F.sequence("first", "last")).alias("to"))
        meeting = self.partners.select("cell", F.explode("others").alias("other")).join(F.broadcast(others), "other")
        meeting = meeting.groupBy("cell").agg(F.collect_set("to").alias("shards"))  # a row per pivot
        each = rows.join(F.broadcast(meeting), "cell").withColumn("to", F.explode("shards")).drop("shards")
        each = each.withColumns({"lo": F.least("shard", "to"), "hi": F.greatest("shard", "to")}).drop("to")
        return each if own else each.filter("lo <> hi")

    def meeting(self, key: tuple, table: pa.Table) -> tuple[pa.Table, pa.Table, Iterator[tuple[slice, slice, bool, Pair]]]:
        """In a task: the rows of both shards of a pair (or of one), and of each two blocks that may hold neighbours where
        they are in those, whether they are the same block, and how they compare."""
        lo, hi = key[0].as_py(), key[-1].as_py()
        shard = table["shard"].to_numpy()
        a = _by_block(table if lo == hi else table.filter(pa.array(shard == lo)))
        b = a if lo == hi else _by_block(table.filter(pa.array(shard == hi)))
        return a, b, self._pairs(a, b, lo == hi)

    def _pairs(self, a: pa.Table, b: pa.Table, same: bool) -> Iterator[tuple[slice, slice, bool, Pair]]:
        xa = _matrix(a["vec"])
        xb = xa if same else _matrix(b["vec"])
        blocks_a, blocks_b = _spans(a["block"].to_numpy()), _spans(b["block"].to_numpy())
        for block, at in blocks_a:
            for other, to in blocks_b:
                if (same and other < block) or not self.meets[block >> 32, other >> 32]:
                    continue
                own = same and other == block
                yield at, to, own, Pair.of(xa[at], xb[to], self.pivots[block >> 32], self.pivots[other >> 32], self.eps)

    def shipped(self) -> Blocks:
        """Without what belongs to the driver."""
        return Blocks(None, self.pivots, None, None, self.meets, self.eps, self.posts, self.most)


def _by_block(table: pa.Table) -> pa.Table:
    return table.combine_chunks().take(pa.array(np.argsort(table["block"].to_numpy(), kind="stable")))


def _spans(block: np.ndarray) -> list[tuple[int, slice]]:
    """Each block of sorted rows and where it lies."""
    each, first = np.unique(block, return_index=True)
    return [(int(k), slice(int(s), int(e))) for k, s, e in zip(each, first, np.append(first[1:], len(block)))]


def shard_rows(n: int, width: int, parallelism: int) -> int:
    """Rows of a shard: pairs of shards for every core, or as many rows as a task holds, whichever is less. Each vector is sent
    to at most ``n / shard_rows`` shards."""
    return max(1, min(math.ceil(n / math.ceil(math.sqrt(4 * parallelism))), SHARD_BYTES // (8 * max(1, width))))


def blocked(df: DataFrame, id: str, vec: str, eps: float, block_rows: int = BLOCK_ROWS) -> Blocks:
    """The distinct vectors of ``df`` in blocks, with the number of posts and the most copies of one vector."""
    return block_vectors(settle(distinct_vectors(df, id, vec)), eps, block_rows)


def block_vectors(base: DataFrame, eps: float, block_rows: int = BLOCK_ROWS) -> Blocks:
    """Blocks of a written table ``(vec, rep, copies, ...)`` of different vectors."""
    spark = base.sparkSession
    n, posts, most, width = base.agg(F.count(F.lit(1)), F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.max("copies"), F.lit(0)),
                                     F.coalesce(F.max(F.size("vec")), F.lit(1))).first()
    parallelism = spark.sparkContext.defaultParallelism
    count = pivot_count(n, parallelism, block_rows)
    chosen = base.select("vec", "rep").orderBy(F.xxhash64("rep"), "rep").limit(min(PIVOT_SAMPLE, 4 * count)).select("vec").toArrow()
    pivots = spread_pivots(_matrix(chosen["vec"]), count)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vec"))
            cell, angle = np.zeros(len(x), np.int32), np.zeros(len(x))
            for start in range(0, len(x), TILE_ROWS):
                angles = _angles(x[start : start + TILE_ROWS], pivots)
                cell[start : start + TILE_ROWS] = angles.argmin(axis=1)
                angle[start : start + TILE_ROWS] = angles.min(axis=1)
            yield batch.append_column("cell", pa.array(cell)).append_column("angle", pa.array(angle))

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    dealt = settle(base.mapInArrow(assign, f"{columns}, cell int, angle double"))
    facts = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).toArrow()  # a row per pivot
    cell, radius, size = (facts[c].to_numpy() for c in ("cell", "radius", "n"))
    apart = _angles(pivots[cell], pivots[cell]) if len(cell) else np.zeros((0, 0))
    order = _chain(apart)
    cell, radius, size, apart = cell[order], radius[order], size[order], apart[np.ix_(order, order)]
    met = apart - radius[:, None] - radius[None, :] <= search_angle(eps) + MARGIN
    subs = -(-size // block_rows)
    before, each, per = np.cumsum(size) - size, size / np.maximum(subs, 1), shard_rows(n, width, parallelism)
    shard = lambda sub: ((before + (sub + 0.5) * each) // per).astype(np.int64)
    facts = {"cell": pa.array(cell, pa.int32()), "subs": pa.array(subs, pa.int64()), "before": pa.array(before, pa.int64()),
             "each": pa.array(each), "first": pa.array(shard(0)), "last": pa.array(shard(subs - 1))}
    facts = spark.createDataFrame(pa.table(facts))
    others = pa.array([cell[row].tolist() for row in met], pa.list_(pa.int32()))
    partners = spark.createDataFrame(pa.table({"cell": pa.array(cell, pa.int32()), "others": others}))
    meets = np.zeros((len(pivots), len(pivots)), bool)
    meets[np.ix_(cell, cell)] = met
    rows = dealt.drop("angle").join(F.broadcast(facts.drop("first", "last")), "cell").withColumn("sub", F.pmod(F.xxhash64("rep"), F.col("subs")))
    rows = rows.withColumns({
        "block": F.shiftleft(F.col("cell").cast("long"), 32) + F.col("sub"),
        "shard": F.floor((F.col("before") + (F.col("sub") + 0.5) * F.col("each")) / per),
    }).drop("sub", "subs", "before", "each")
    cells = facts.select("cell", "first", "last")
    return Blocks(rows, pivots, cells, partners, meets, eps, posts, most)


def back_to_posts(df: DataFrame, vec: str, base: DataFrame | None, per_vector: DataFrame, hot_rows: int) -> DataFrame:
    """Give every row of ``df`` the columns of its vector. ``base`` tells which vectors hold
    very many copies, None if none does."""
    key = lambda t: t.withColumn("_vkey", F.xxhash64("vec"))
    posts = key(df.withColumn("vec", F.col(vec)))
    hot = None if base is None else key(base.filter(F.col("copies") >= hot_rows)).select("_vkey", "vec")
    return hot_key_join(posts, key(per_vector), ["_vkey", "vec"], hot).drop("_vkey", "vec")


def _vector_degrees(blocks: Blocks) -> DataFrame:
    """Per distinct vector, how many posts lie within ``eps`` of a copy of it (itself and its
    other copies included); zero vectors are near nothing but themselves."""
    local = blocks.shipped()

    def count_pair(key: tuple, table: pa.Table) -> pa.Table:
        a, b, pairs = local.meeting(key, table)
        copies_a, copies_b, same = a["copies"].to_numpy(), b["copies"].to_numpy(), a is b
        all_a = np.zeros(len(copies_a), np.int64)
        all_b = all_a if same else np.zeros(len(copies_b), np.int64)
        for at, to, own, pair in pairs:
            ca, cb, na, nb = copies_a[at], copies_b[to], all_a[at], all_b[to]
            for i, j, near in pair.tiles(local.eps):
                if own:
                    near[i[:, None] == j[None, :]] = False
                na[i] += near @ cb[j]
                if not own:
                    nb[j] += ca[i] @ near
            na[pair.sure_a] += cb.sum() - (ca[pair.sure_a] if own else 0)
            na[pair.open_a] += cb[pair.sure_b].sum()
            if not own:
                nb[pair.sure_b] += ca.sum()
                nb[pair.open_b] += ca[pair.sure_a].sum()
        if same:
            found = pa.table({"rep": a["rep"], "n": pa.array(all_a)})
        else:
            found = pa.table({"rep": pa.chunked_array([*a["rep"].chunks, *b["rep"].chunks], pa.int64()), "n": pa.array(np.append(all_a, all_b))})
        return found.filter(pa.array(found["n"].to_numpy() > 0))

    pairs = blocks.met(blocks.rows.select("vec", "rep", "copies", "cell", "block", "shard")).groupBy("lo", "hi")
    return pairs.applyInArrow(count_pair, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("others"))


def with_degree(blocks: Blocks) -> DataFrame:
    """``rows`` with ``degree``: posts within ``eps`` of one copy of the vector, itself included."""
    is_zero = F.forall("vec", lambda e: e == 0) & F.lit(blocks.eps < 1)
    own = F.when(is_zero, F.lit(1)).otherwise(F.col("copies"))
    return blocks.rows.join(_vector_degrees(blocks), "rep", "left").withColumn(
        "degree", own + F.coalesce("others", F.lit(0))
    )


def neighbour_counts(
    df: DataFrame, id: str, vec: str, eps: float = 0.4, block_rows: int = BLOCK_ROWS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``(id, neighbours)``: posts within ``eps`` of each post, itself not counted."""
    blocks = blocked(df, id, vec, eps, block_rows)
    per_vector = with_degree(blocks).select("vec", "degree")
    hot = blocks.rows if blocks.most >= hot_rows else None
    return back_to_posts(df.select(id, vec), vec, hot, per_vector, hot_rows).select(id, (F.col("degree") - 1).alias("neighbours"))


def comparisons(df: DataFrame, id: str, vec: str, eps: float = 0.4, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """What the pivots save, in one row: ``vectors`` (different ones), ``block_pairs`` that meet, ``compared`` pairs of
    vectors, and ``every``, the pairs without pivots."""
    blocks = blocked(df, id, vec, eps, block_rows)
    local = blocks.shipped()

    def count(key: tuple, table: pa.Table) -> pa.Table:
        _, _, pairs = local.meeting(key, table)
        each = [(p.compared - int(p.open_a.sum())) // 2 if own else p.compared for _, _, own, p in pairs]
        return pa.table({"pairs": pa.array([len(each)], pa.int64()), "compared": pa.array([sum(each)], pa.int64())})

    met = blocks.met(blocks.rows.select("vec", "cell", "block", "shard")).groupBy("lo", "hi").applyInArrow(count, "pairs long, compared long")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in (("pairs", "block_pairs"), ("compared", "compared"))]
    found = met.agg(*sums)
    n = blocks.rows.agg(F.count(F.lit(1)).alias("vectors"))  # two tables of one row
    return n.join(F.broadcast(found)).withColumn("every", F.expr("vectors * (vectors - 1) div 2"))


def core_points(degrees: DataFrame, min_samples: int = 2) -> DataFrame:
    """Posts with at least ``min_samples`` neighbours, themselves included."""
    return degrees.withColumn("core", F.col("neighbours") + 1 >= min_samples)


def group_links(blocks: Blocks, cores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Connect the core vectors, rows of ``blocks.rows``, that lie within ``eps``.

    First every shard finds its own groups, then every pair of shards reports which groups it
    joins: ``local`` maps a vector to its group in the shard (smallest id), ``links`` holds at
    most one row per group and pair of shards.
    """
    shipped = blocks.shipped()
    kind = blocks.rows.schema["vec"].dataType.simpleString()

    def join(parent: np.ndarray, ka: np.ndarray, kb: np.ndarray, own: bool, pair: Pair) -> np.ndarray:
        """``parent`` of the nodes of two blocks, ``ka`` and ``kb``, joined where their vectors are near."""
        parent = _roots(parent)
        if not own and (parent[ka] == parent[ka[0]]).all() and (parent[kb] == parent[ka[0]]).all():
            return parent
        for sure, one, all_ in ((pair.sure_a, ka, kb), (pair.sure_b, kb, ka)):
            if sure.any():
                parent = _join_groups(parent, one[sure][:1], all_, np.ones((1, len(all_)), bool))
                parent = _join_groups(parent, all_[:1], one[sure], np.ones((1, int(sure.sum())), bool))
        if own and pair.sure_a.any():  # one row is near all others
            return parent
        for i, j, near in pair.tiles(shipped.eps):
            parent = _join_groups(parent, ka[i], kb[j], near)
        return parent

    def inside(key: tuple, table: pa.Table) -> pa.Table:
        table, _, pairs = shipped.meeting(key, table)
        ids, code = np.unique(table["rep"].to_numpy(), return_inverse=True)
        parent = np.arange(len(ids))
        for at, to, own, pair in pairs:
            parent = join(parent, code[at], code[to], own, pair)
        return table.append_column("local", pa.array(ids[_roots(parent)[code]]))

    cores = cores.select("vec", "rep", "copies", "cell", "block", "shard")
    schema = f"vec {kind}, rep long, copies long, cell int, block long, shard long, local long"
    local = settle(cores.groupBy("shard").applyInArrow(inside, schema))

    def across(key: tuple, table: pa.Table) -> pa.Table:
        a, b, pairs = shipped.meeting(key, table)
        groups, code = np.unique(np.concatenate([a["local"].to_numpy(), b["local"].to_numpy()]), return_inverse=True)
        ka, kb, parent = code[: len(a)], code[len(a) :], np.arange(len(groups))
        for at, to, _, pair in pairs:
            parent = join(parent, ka[at], kb[to], False, pair)
        root = _roots(parent)
        moved = root != np.arange(len(groups))
        return pa.table({"a": groups[root[moved]], "b": groups[moved]})

    links = blocks.met(local.drop("copies"), own=False).groupBy("lo", "hi").applyInArrow(across, "a long, b long").distinct()
    return local, links


def border_links(blocks: Blocks, base: DataFrame) -> DataFrame:
    """``(rep, core_rep)`` for every non-core vector of ``base`` (rows of the blocks with ``core``) and each core vector
    within ``eps``.

    A non-core vector has fewer than ``min_samples`` neighbours, so the output is bounded.
    """
    shipped = blocks.shipped()

    def reach(key: tuple, table: pa.Table) -> pa.Table:
        a, b, pairs = shipped.meeting(key, table)
        reps_a, reps_b, core_a, core_b = a["rep"].to_numpy(), b["rep"].to_numpy(), a["core"].to_numpy(), b["core"].to_numpy()
        out = [(reps_a[:0], reps_a[:0])]
        for at, to, own, pair in pairs:
            ra, rb, ca, cb = reps_a[at], reps_b[to], core_a[at], core_b[to]
            for i, j, near in pair.near(shipped.eps):
                r, c = np.nonzero(near & ~ca[i][:, None] & cb[j][None, :])
                out.append((ra[i[r]], rb[j[c]]))
                if not own:
                    r, c = np.nonzero(near & ca[i][:, None] & ~cb[j][None, :])
                    out.append((rb[j[c]], ra[i[r]]))
        return pa.table({"rep": np.concatenate([x for x, _ in out]), "core_rep": np.concatenate([y for _, y in out])})

    pairs = blocks.met(base.select("vec", "rep", "cell", "block", "shard", "core")).groupBy("lo", "hi")
    return pairs.applyInArrow(reach, "rep long, core_rep long")
