"""Near duplicates by SimHash, found with vantage-point trees over the Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..operators.components import linked_components
from ..operators.scale import HOT_ROWS, hot_key_join
from ..session import settle
from .common import LOWER, forest, utf8

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
SHARD_ROWS = 8192  # rows a shard should hold; its task splits them further
MAX_DEPTH = 16  # so the tree has at most 65,536 shards and is fitted on at most 64 rows for each
SAMPLE_PER_SHARD = 64
LEAF_ROWS = 1024
SHRINK = 0.6  # part of a node's rows that a child receives, copies at the border included


def fingerprint(data: bytes, width: int = SHINGLE_WORDS) -> int:
    """SimHash of one text: bit i is set where more than half of the shingle hashes have it. No word: 0."""
    words = data.translate(LOWER).split()
    if not words:
        return 0
    text, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return hashed(text, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1]
    hashes = [hashed(text[s:e], SEED) for s, e in zip(starts.tolist(), ends[width - 1 :].tolist())]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, fp)`` per row of ``docs(doc_id, text)``; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x, width) for x in utf8(batch.column(1))], "<u8").view("<i8")
            yield pa.record_batch([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _split(points: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[int, int]:
    """Vantage point and ball radius whose two sides, with the copies at the border, are cheapest to compare."""
    best = (float("inf"), int(points[0]), 64)
    for vantage in points[rng.integers(0, len(points), 8)]:
        within = np.cumsum(np.bincount(np.bitwise_count(points ^ vantage), minlength=65))
        inner = np.concatenate((within[radius:], np.full(radius, len(points))))[:65]
        outer = len(points) - within
        cost = inner.astype(float) ** 2 + outer.astype(float) ** 2
        at = int(np.argmin(cost))
        best = min(best, (float(cost[at]), int(vantage), at))
    return best[1], best[2]


def grow_tree(sample: np.ndarray, depth: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A vantage-point tree of ``depth`` levels as heap arrays: points and ball radii (64: all inside)."""
    rng = np.random.default_rng(SEED)
    points, balls = np.zeros(2**depth, np.uint64), np.full(2**depth, 64, np.uint8)
    held = {1: sample.astype(np.uint64)}
    for node in range(1, 2**depth):
        here = held.pop(node, np.zeros(0, np.uint64))
        if len(here) < 4:
            continue
        vantage, ball = _split(here, radius, rng)
        points[node], balls[node] = vantage, ball
        far = np.bitwise_count(here ^ np.uint64(vantage))
        held[2 * node], held[2 * node + 1] = here[far <= ball], here[far > ball]
    return points, balls


def route(fp: np.ndarray, points: np.ndarray, balls: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, shard)`` for every shard a fingerprint belongs to.

    A point goes to its own side of each ball. One that lies outside by no more than ``radius`` also goes
    inside: by the triangle inequality only such points can be near one inside, so any two points within
    ``radius`` of each other meet in at least one shard.
    """
    row, node = np.arange(len(fp)), np.ones(len(fp), np.int64)
    for _ in range(int(len(points)).bit_length() - 1):
        far = np.bitwise_count(fp[row] ^ points[node]).astype(np.int64)
        ball = balls[node].astype(np.int64)
        outside = far > ball
        border = outside & (far <= ball + radius)
        row = np.concatenate((row, row[border]))
        node = np.concatenate((2 * node + outside, 2 * node[border]))
    return row, node


def near_pairs(fp: np.ndarray, radius: int, leaf: int = LEAF_ROWS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within ``radius``, from a vantage-point tree over one shard (a pair may come twice)."""
    rng = np.random.default_rng(SEED)
    todo = [np.arange(len(fp))]
    while todo:
        rows = todo.pop()
        here = fp[rows]
        if len(rows) > leaf:
            vantage, ball = _split(here[rng.integers(0, len(here), min(len(here), 4096))], radius, rng)
            far = np.bitwise_count(here ^ np.uint64(vantage))
            inner, outer = rows[far <= ball + radius], rows[far > ball]
            if max(len(inner), len(outer)) < 0.9 * len(rows):
                todo += [inner, outer]
                continue
        for at in range(0, len(rows), leaf):  # a small or inseparable set: all of it, in blocks
            block = here[at : at + leaf]
            for to in range(at, len(rows), leaf):
                i, j = np.nonzero(np.bitwise_count(block[:, None] ^ here[None, to : to + leaf]) <= radius)
                ahead = i + at < j + to
                if ahead.any():
                    yield rows[i[ahead] + at], rows[j[ahead] + to]


def shard_links(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``len(fp) - 1`` links that join what is within ``radius``, directly or in steps."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for i, j in near_pairs(fp, radius):
        a, b = np.concatenate((a, i)), np.concatenate((b, j))
        if len(a) > 4 * len(fp) + 1_000_000:
            a, b = forest(len(fp), a, b)
    return forest(len(fp), a, b)


def near_links(points: DataFrame, radius: int = MAX_BITS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links ``(a, b)`` between ids of ``points(id, fp)`` (fp unique) that join all within ``radius`` bits.

    The tree is fitted on a bounded sample; every point is routed. Each shard sends back a spanning forest,
    so a dense group costs a link per member and shard, never its pairs.
    """
    spark = points.sparkSession
    n = points.count()
    depth = int(np.clip(np.ceil(np.log(max(n, 1) / shard_rows) / -np.log(SHRINK)), 0, MAX_DEPTH))
    wanted = SAMPLE_PER_SHARD * 2**depth
    chosen = points.filter(F.pmod(F.xxhash64("fp"), F.lit(max(1, n // wanted))) == 0).select("fp").limit(2 * wanted)
    sample = chosen.toArrow().column("fp").to_numpy() if depth else np.zeros(0, np.int64)
    tree = spark.sparkContext.broadcast(grow_tree(np.sort(sample).astype(np.int64).view(np.uint64), depth, radius))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(1).to_numpy(zero_copy_only=False)
            row, node = route(fp.view(np.uint64), *tree.value, radius)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.record_batch(
                [pa.array(node), pa.array(ids[row]), pa.array(fp[row])], names=["shard", "id", "fp"]
            )

    def link(shard: pa.Table) -> pa.Table:
        ids = shard.column("id").to_numpy()
        a, b = shard_links(np.ascontiguousarray(shard.column("fp").to_numpy()).view(np.uint64), radius)
        return pa.table({"a": pa.array(ids[a], pa.int64()), "b": pa.array(ids[b], pa.int64())})

    dealt = points.select("id", "fp").mapInArrow(deal, "shard long, id long, fp long")
    return dealt.groupBy("shard").applyInArrow(link, "a long, b long")


def simhash_groups(docs: DataFrame, width: int = SHINGLE_WORDS, radius: int = MAX_BITS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` per row of ``docs(doc_id, text)``.

    Documents link when their fingerprints differ in at most ``radius`` bits; ``component_id`` is the smallest
    doc_id reachable. Equal fingerprints are one point, so copies are never paired with each other. Null and
    empty texts have fingerprint zero and link like any other. Rows with a null doc_id take part: they get their
    group's smallest doc_id, or null where the group has none. Repeated rows each come back. ``doc_id`` is any 64-bit
    number; texts may be of any length; an empty table gives no rows, and other columns are ignored.
    """
    rows = settle(fingerprints(docs, width))
    # Points are named by their fingerprint; the ids, any 64-bit numbers or null, only give each group its smallest one.
    points = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    links = settle(near_links(points.select(F.col("fp").alias("id"), "fp"), radius))
    linked = settle(linked_components(links).withColumnsRenamed({"id": "fp"}))
    members = points.join(linked, "fp")
    lowest = members.groupBy("component").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n"))
    hot = lowest.filter(F.col("n") >= HOT_ROWS).select("component")
    grouped = hot_key_join(members.select("fp", "component"), lowest.drop("n"), ["component"], hot).select("fp", "component_id")
    alone = points.join(linked, "fp", "left_anti").select("fp", F.col("first").alias("component_id"))
    named = grouped.unionByName(alone)
    joined = rows.join(settle(named), "fp")
    return joined.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
