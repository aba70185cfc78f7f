"""Token ids in binary files of patched frame-of-reference blocks.

A file (all numbers little-endian):

    magic, part u32, before u64        part of the ordered corpus, ids before this file in that part
    blocks of 256 ids                  min u32, width u8, exceptions u8, high bytes u8, 0 u8,
                                       256 x width bits (id - min, low bits), positions u8, high bits u16 or u32
    block starts u64                   one per block
    documents                          doc_id i64, is null u8, first id u64 (in this file)
    footer                             ids u64, blocks u64, documents u64, start of the block index u64, magic

The last block is filled up with its minimum. The width is that of a percentile of the block's differences; ids
above it keep their low bits in place and their high bits in the exception list.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import settle, shuffle_width
from .common import read_blobs, write_blobs
from .tokens import encoded

MAGIC = b"TWPFOR1\n"
BLOCK = 256
PERCENTILES = (0.90, 0.95, 0.98, 1.0)
ROLL_IDS = 2_000_000
HEAD, FOOT = "<8sIQ", "<QQQQ8s"


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Low ``width`` bits of (m, 32) numbers as (m, width) 32-bit words."""
    columns = np.ascontiguousarray(values.T.astype(np.uint64) & np.uint64((1 << width) - 1))
    words = np.zeros((width + 1, len(values)), np.uint64)
    for i in range(32):
        word, shift = divmod(i * width, 32)
        wide = columns[i] << np.uint64(shift)
        words[word] |= wide & np.uint64(0xFFFFFFFF)
        words[word + 1 if word < width else word] |= wide >> np.uint64(32)
    return np.ascontiguousarray(words[:width].T.astype("<u4"))


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    """The opposite of :func:`pack`."""
    columns = np.zeros((width + 2, len(words)), np.uint64)
    columns[:width] = words.T
    out = np.empty((32, len(words)), np.uint32)
    for i in range(32):
        word, shift = divmod(i * width, 32)
        wide = columns[word] | (columns[word + 1] << np.uint64(32))
        out[i] = (wide >> np.uint64(shift)) & np.uint64((1 << width) - 1)
    return out.T


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits needed for each number below 2**32."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """The blocks of an array of unsigned 32-bit ids."""
    if not len(ids):
        return []
    n = -(-len(ids) // BLOCK)
    filled = np.empty(n * BLOCK, np.uint32)
    filled[: len(ids)] = ids
    filled[len(ids) :] = ids[(n - 1) * BLOCK :].min()
    rows = filled.reshape(n, BLOCK)
    low = rows.min(axis=1)
    delta = rows - low[:, None]
    ordered = np.sort(delta, axis=1)
    most = _bits(ordered[:, -1])
    width, cost = most.copy(), BLOCK // 8 * most
    for p in PERCENTILES[:-1]:
        w = _bits(ordered[:, int(p * BLOCK) - 1])
        outside = (ordered >> w[:, None].astype(np.uint32)).astype(bool).sum(axis=1)
        size = BLOCK // 8 * w + outside * np.where(most - w > 16, 5, 3)
        better = size < cost
        width, cost = np.where(better, w, width), np.where(better, size, cost)
    high = np.where(width[:, None] < 32, delta >> np.minimum(width, 31)[:, None].astype(np.uint32), 0)
    bodies: list = [b""] * n
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        packed = pack(delta[at].reshape(-1, 32), w).tobytes()
        size = BLOCK // 8 * w
        for k, b in enumerate(at.tolist()):
            bodies[b] = packed[k * size : (k + 1) * size]
    where = high != 0
    count = where.sum(axis=1)
    bytes_each = np.where(high.max(axis=1) > 0xFFFF, 4, 2)
    block, place = np.nonzero(where)
    values, ends = high[where], np.cumsum(count).tolist()
    places, short, long = place.astype(np.uint8).tobytes(), values.astype("<u2").tobytes(), values.astype("<u4").tobytes()
    heads = np.zeros(n, np.dtype([("low", "<u4"), ("width", "u1"), ("count", "u1"), ("each", "u1"), ("zero", "u1")]))
    heads["low"], heads["width"], heads["count"], heads["each"] = low, width, count, bytes_each
    heads, out = heads.tobytes(), []
    for b, (c, e, end) in enumerate(zip(count.tolist(), bytes_each.tolist(), ends)):
        s = end - c
        tail = places[s:end] + (short[2 * s : 2 * end] if e == 2 else long[4 * s : 4 * end]) if c else b""
        out.append(heads[8 * b : 8 * b + 8] + bodies[b] + tail)
    return out


def decode_blocks(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ids of the blocks that start at ``starts`` in the bytes ``data``."""
    take = lambda at, n: data[at[:, None] + np.arange(n)]
    heads = take(starts, 8)
    low = np.ascontiguousarray(heads[:, :4]).view("<u4")[:, 0]
    width, count, each = (heads[:, k].astype(np.int64) for k in (4, 5, 6))
    out = np.empty((len(starts), BLOCK), np.uint32)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        words = np.ascontiguousarray(take(starts[at] + 8, BLOCK // 8 * w)).view("<u4").reshape(-1, w) if w else None
        out[at] = unpack(words, w).reshape(-1, BLOCK) if w else 0
    lists = starts + 8 + BLOCK // 8 * width
    for size in (2, 4):
        at = np.flatnonzero((each == size) & (count > 0))
        c = count[at]
        block = np.repeat(at, c)
        k = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        place = data[lists[block] + k]
        value = np.ascontiguousarray(take(lists[block] + count[block] + size * k, size)).view(f"<u{size}").reshape(-1)
        out[block, place] |= value.astype(np.uint32) << width[block].astype(np.uint32)
    return (out + low[:, None]).reshape(-1)


class File(NamedTuple):
    part: int
    before: int
    n_ids: int
    starts: np.ndarray
    doc_ids: np.ndarray
    is_null: np.ndarray
    firsts: np.ndarray
    data: np.ndarray

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start:stop`` of the file; only the blocks that hold them are decoded."""
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first = start // BLOCK
        return decode_blocks(self.data, self.starts[first : -(-stop // BLOCK)])[start - first * BLOCK : stop - first * BLOCK]


def build_file(part: int, before: int, docs: list[tuple]) -> bytes:
    """The file of ``docs``: (doc_id or None, ids as 32-bit bytes), in order."""
    sizes = np.array([len(x) // 4 for _, x in docs], np.int64)
    blocks = encode_blocks(np.frombuffer(b"".join(x for _, x in docs), "<u4"))
    lengths = np.array([len(b) for b in blocks], np.int64)
    starts = struct.calcsize(HEAD) + np.cumsum(lengths) - lengths
    index = struct.calcsize(HEAD) + int(lengths.sum())
    return b"".join([
        struct.pack(HEAD, MAGIC, part, before), *blocks, starts.astype("<u8").tobytes(),
        np.array([0 if i is None else i for i, _ in docs], "<i8").tobytes(),
        np.array([i is None for i, _ in docs], np.uint8).tobytes(), (np.cumsum(sizes) - sizes).astype("<u8").tobytes(),
        struct.pack(FOOT, int(sizes.sum()), len(blocks), len(docs), index, MAGIC),
    ])


def open_file(content: bytes) -> File:
    """Header, index and documents of a file; damage raises."""
    content = content.removesuffix(b"\0")
    data = np.frombuffer(content, np.uint8)
    magic, part, before = struct.unpack_from(HEAD, content)
    n_ids, blocks, docs, index, end = struct.unpack_from(FOOT, content, len(content) - struct.calcsize(FOOT))
    if magic != MAGIC or end != MAGIC or index + 8 * blocks + 17 * docs + struct.calcsize(FOOT) != len(content):
        raise ValueError("not a whole token file")
    at = index + 8 * blocks
    read = lambda kind, n, place: np.frombuffer(content, kind, n, place)
    return File(part, before, n_ids, read("<u8", blocks, index).astype(np.int64), read("<i8", docs, at),
                read("u1", docs, at + 8 * docs).astype(bool), read("<u8", docs, at + 9 * docs).astype(np.int64), data)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, roll_ids: int = ROLL_IDS) -> None:
    """Encode ``docs(doc_id, text)``, append ``end_id`` to each, and write the ids in ascending doc_id order.

    Null texts are empty; documents without a doc_id come first, those of one doc_id by text, so ``start`` does not depend
    on the order of the rows. Texts of any length; an empty table gives no ids; other columns are ignored. The rows are
    range-partitioned by doc_id: a part is one range, and its files are rolled at ``roll_ids`` ids, between documents.
    """
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, held, size = TaskContext.get().partitionId(), 0, [], 0
        done = lambda: pa.record_batch([pa.array([build_file(part, before, held)], pa.binary())], names=["blob"])
        for doc_id, ids in encoded(batches, tokenizer):
            held.append((doc_id, ids + end))
            size += len(ids) // 4 + 1
            if size >= roll_ids:
                yield done()
                before, held, size = before + size, [], 0
        if held:
            yield done()

    keyed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ranged = keyed.repartitionByRange(shuffle_width(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    write_blobs(ranged.mapInArrow(run, "blob binary"), path)


def read_token_files(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """Per document of the files in ``path``: ``part, local_start`` (ids before it in its part), ``doc_id, n_tokens,
    ids_crc32`` and, if wanted, ``ids`` (array). A folder without files gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                if not len(content.as_buffer()):  # Spark leaves an empty file where there was no row
                    continue
                file = open_file(content.as_py())
                every = file.ids()
                ends = np.append(file.firsts[1:], file.n_ids)
                spans = list(zip(file.firsts.tolist(), ends.tolist()))
                columns = {
                    "part": pa.array(np.full(len(spans), file.part, np.int64)),
                    "local_start": pa.array(file.before + file.firsts),
                    "doc_id": pa.array(file.doc_ids, pa.int64(), mask=file.is_null),
                    "n_tokens": pa.array(ends - file.firsts),
                    "ids_crc32": pa.array([zlib.crc32(every[s:e]) for s, e in spans], pa.int64()),
                }
                if ids:
                    columns["ids"] = pa.array([every[s:e].astype(np.int64) for s, e in spans], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(columns)

    schema = "part long, local_start long, doc_id long, n_tokens long, ids_crc32 long" + (", ids array<long>" if ids else "")
    return read_blobs(spark, path).select("content").mapInArrow(run, schema)


def with_global_start(rows: DataFrame) -> DataFrame:
    """Replace ``part, local_start`` by ``start``, the ids of all documents before. Only the totals of the parts
    (one row for each shuffle partition of the writer) are put in one order."""
    rows = settle(rows)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    joined = rows.join(F.broadcast(base), "part")
    return joined.withColumn("start", F.col("base") + F.col("local_start")).drop("part", "local_start", "base")
