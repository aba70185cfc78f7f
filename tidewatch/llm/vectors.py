"""Near-duplicate embeddings by tiled comparison in PCA order with early stops."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.components import linked_components
from ..operators.scale import HOT_ROWS, hot_key_join
from ..session import settle
from .common import forest

THRESHOLD = 0.93
BLOCK_ROWS = 1024
SAMPLE_ROWS = 20_000  # vectors that the axes are fitted on; they decide the order of work, never a link
STEPS = (8, 16, 32, 64, 128, 256, 512)
MARGIN = 1e-9  # rounding of rotated products; what is closer to the threshold is computed from the given numbers


def principal_axes(x: np.ndarray) -> np.ndarray:
    """Orthogonal axes as columns, in descending order of the second moment of the rows of ``x``."""
    return np.linalg.eigh(x.T @ x)[1][:, ::-1]


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def tile_links(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of unit rows with cosine >= ``threshold``; of one block with itself each pair once.

    Leading axes first: a pair stays open while its product so far plus the product of what is left of both
    lengths (Cauchy-Schwarz) reaches the threshold. The tile ends when none is open; few open pairs go on alone.
    """
    x, y = a @ axes, b @ axes
    rest = lambda z: np.sqrt(np.maximum(0, np.cumsum((z * z)[:, ::-1], axis=1)[:, ::-1]))
    rest_x, rest_y = rest(x), rest(y)
    dim, done = x.shape[1], 0
    product, open_ = np.zeros((len(x), len(y))), None
    for step in [s for s in STEPS if s < dim] + [dim]:
        if open_ is None:
            product += x[:, done:step] @ y[:, done:step].T
            bound = product + (np.outer(rest_x[:, step], rest_y[:, step]) if step < dim else 0)
            held = bound >= threshold - MARGIN
            if same:
                held &= np.tri(len(x), k=-1, dtype=bool).T
            if np.count_nonzero(held) < 0.05 * held.size or step == dim:
                i, j = np.nonzero(held)
                open_ = i, j, product[i, j]
        else:
            i, j, so_far = open_
            so_far = so_far + np.einsum("ij,ij->i", x[i, done:step], y[j, done:step])
            left = rest_x[i, step] * rest_y[j, step] if step < dim else 0
            held = so_far + left >= threshold - MARGIN
            open_ = i[held], j[held], so_far[held]
        done = step
        if open_ is not None and not len(open_[0]):
            break
    i, j, cosine = open_
    close = np.abs(cosine - threshold) <= MARGIN
    cosine[close] = (a[i[close]] * b[j[close]]).sum(axis=1)
    linked = cosine >= threshold
    return i[linked], j[linked]


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per row of ``vectors(vec_id, embedding, label)``.

    Vectors link when their labels are equal and not null and their cosine, in double precision, is ``threshold`` or
    more. Null, empty and zero vectors and those with null or non-finite components link with nothing; different
    lengths never link. Repeated rows count as vectors of their own. A null vec_id takes part and gets its
    group's smallest vec_id (null if there is none); any 64-bit number may be an id. ``threshold`` must be above 0. An empty
    table gives no rows, and other columns are ignored.

    Equal vectors are one point. The points of a label are dealt into blocks by hash, and every pair of blocks is
    one task, which returns link counts and a spanning forest: linear in the block, however dense the links.
    """
    finite = "forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(embedding, x -> x <> 0)"
    rows = vectors.select(
        F.col("vec_id").cast("long"), F.col("label"), "embedding", F.size("embedding").alias("dim"),
        F.xxhash64("embedding").alias("k1"), F.xxhash64(F.reverse("embedding")).alias("k2"),
        (F.col("label").isNotNull() & F.coalesce(F.expr(finite), F.lit(False))).alias("valid"),
    )
    key = ["label", "dim", "k1", "k2"]
    points = rows.filter("valid").groupBy(*key).agg(
        F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"), F.any_value("embedding").alias("embedding"))
    # Points are numbered, and written with their numbers; vec_ids only give each group its smallest one.
    points = settle(points.withColumn("id", F.monotonically_increasing_id()))
    found = settle(_compare(points, threshold, block_rows))
    counts = found.filter("other is null").groupBy("id").agg(F.sum("n").alias("links"))
    edges = found.filter("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b"))
    members = settle(points.select("id", "first").join(linked_components(edges), "id"))
    lowest = members.groupBy("component").agg(F.min("first").alias("lowest"), F.count(F.lit(1)).alias("n"))
    hot = lowest.filter(F.col("n") >= HOT_ROWS).select("component")
    linked = hot_key_join(members.select("id", "component"), lowest.drop("n"), ["component"], hot).select("id", "lowest")
    named = points.join(counts, "id", "left").join(linked, "id", "left").select(
        *key, (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("lowest", "first").alias("component"))
    narrow = settle(rows.select("vec_id", *key, "valid"))
    joined = narrow.filter("valid").join(settle(named), key).select("vec_id", "links", "component")
    alone = narrow.filter("not valid").select("vec_id", F.lit(0).cast("long"), F.col("vec_id"))
    return joined.union(alone).select(
        "vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.col("component")).alias("kept"))


def _compare(points: DataFrame, threshold: float, block_rows: int) -> DataFrame:
    """``(id, n, other)``: link counts (other null) and links of a spanning forest, of every pair of blocks."""
    spark = points.sparkSession
    total = points.count()
    part = F.pmod(F.xxhash64("id"), F.lit(max(1, total // SAMPLE_ROWS))) == 0
    sample = points.filter(part).select("embedding").limit(2 * SAMPLE_ROWS).toArrow().column(0).to_pylist()
    by_dim: dict[int, list] = {}
    for x in sample:
        by_dim.setdefault(len(x), []).append(x)
    axes = spark.sparkContext.broadcast({d: principal_axes(unit(np.array(x))) for d, x in by_dim.items()})
    kind = np.float32 if dict(points.dtypes)["embedding"] == "array<float>" else np.float64

    sized = points.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).alias("blocks"))
    dealt = points.join(F.broadcast(sized) if sized.count() < 10_000 else sized, ["label", "dim"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("long"))

    def pack(table: pa.Table) -> pa.Table:
        matrix = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind)
        ints = lambda c: pa.array([table.column(c).to_numpy().astype("<i8").tobytes()], pa.binary())
        head = {c: table.column(c).slice(0, 1) for c in ("label", "dim", "block", "blocks")}
        return pa.table(head | {"ids": ints("id"), "ns": ints("n"), "matrix": pa.array([matrix.tobytes()], pa.binary())})

    label = points.schema["label"].dataType.simpleString()
    schema = f"label {label}, dim int, block long, blocks long, ids binary, ns binary, matrix binary"
    blocks = settle(dealt.select("label", "dim", "block", "blocks", "id", "n", "embedding")
                    .groupBy("label", "dim", "block").applyInArrow(pack, schema))
    left = blocks.select("label", "dim", F.col("block").alias("i"), "blocks", *[F.col(c).alias(f"{c}_i") for c in ("ids", "ns", "matrix")])
    right = blocks.select("label", "dim", F.col("block").alias("j"), *[F.col(c).alias(f"{c}_j") for c in ("ids", "ns", "matrix")])
    tiles = left.withColumn("j", F.explode(F.sequence("i", F.col("blocks") - 1)))
    tiles = tiles.join(right, ["label", "dim", "j"]).drop("label", "blocks")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                t = {name: batch.column(c)[k].as_py() for c, name in enumerate(batch.schema.names)}
                dim, same = t["dim"], t["i"] == t["j"]
                ids, ns = (np.concatenate([np.frombuffer(t[f"{c}_{s}"], "<i8") for s in "ij"]) for c in ("ids", "ns"))
                a, b = (unit(np.frombuffer(t[f"matrix_{s}"], kind).reshape(-1, dim)) for s in "ij")
                turn = axes.value.get(dim)
                i, j = tile_links(a, b, np.eye(dim) if turn is None else turn, threshold, same)
                j = j if same else j + len(a)
                links = np.bincount(i, ns[j], len(ids)) + np.bincount(j, ns[i], len(ids))
                has = np.flatnonzero(links)
                p, q = forest(len(ids), i, j)
                yield pa.record_batch([
                    pa.array(np.concatenate((ids[has], ids[p]))),
                    pa.array(np.concatenate((links[has].astype(np.int64), np.zeros(len(p), np.int64)))),
                    pa.concat_arrays([pa.nulls(len(has), pa.int64()), pa.array(ids[q], pa.int64())]),
                ], names=["id", "n", "other"])

    return tiles.mapInArrow(compare, "id long, n long, other long")
