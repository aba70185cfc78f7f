"""Documents packed into sequences of bounded length: best fit, then a local search by swaps."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import settle
from .tokens import encoded

CAPACITY = 2048
GROUP_BINS = 2048  # sequences that one task packs together
GROUP_ROWS = 200_000
LOOSE = 0.97  # sequences filled less than this are packed once more, across groups


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each size: largest first, each into the fullest bin that still has room."""
    bins = np.zeros(len(sizes), np.int64)
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, used = 0, 0  # bit r of rooms: some bin has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room, used = used, capacity, used + 1
        bins[i] = b
        with_room[room - size].append(b)
        rooms |= 1 << (room - size)
    return bins


def local_search(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Empty underfull bins by moves and exchanges that each increase the sum of squared fills.

    Taken in order of fill, a bin gives a document away (move), gives a longer one for a shorter one, or gives two
    for one, always the exchange that shifts most tokens into a fuller bin with room for them. Sweeps go on
    until one changes nothing or the number of bins has reached the sum of the sizes over the capacity.
    """
    bins = bins.copy()
    fill = np.bincount(bins, weights=sizes, minlength=1).astype(np.int64)
    least = -(-int(sizes.sum()) // capacity)
    changed = True
    while changed and np.count_nonzero(fill) > least:
        changed = False
        open_bins = np.flatnonzero((fill > 0) & (fill < capacity))
        items = np.flatnonzero((fill[bins] < capacity))
        for a in open_bins[np.argsort(fill[open_bins], kind="stable")].tolist():
            while fill[a] and _step(sizes, bins, fill, items, a, capacity):
                changed = True
            if not fill[a] and np.count_nonzero(fill) <= least:
                break
    return bins


def _step(sizes: np.ndarray, bins: np.ndarray, fill: np.ndarray, items: np.ndarray, a: int, capacity: int) -> bool:
    """The best single change that takes tokens out of bin ``a``; False if there is none."""
    mine = items[bins[items] == a]
    others = items[(bins[items] != a) & (fill[bins[items]] > 0) & (fill[bins[items]] < capacity)]
    if not len(others):
        return False
    home = bins[others]
    room, back = capacity - fill[home], sizes[others]
    gain_ok = lambda d: (d > 0) & (d <= room) & (fill[home] + d > fill[a])
    best, change = 0, None
    singles = {int(sizes[i]): (i,) for i in mine.tolist()}
    pairs = {}
    if len(mine) > 1:
        i, j = np.triu_indices(len(mine), 1)
        sums, first = np.unique(sizes[mine[i]] + sizes[mine[j]], return_index=True)
        pairs = {int(s): (int(mine[i[k]]), int(mine[j[k]])) for s, k in zip(sums, first) if s <= capacity}
    for given in (singles, pairs):
        for size, out in given.items():
            if size <= best:
                continue
            if given is singles:  # a move gives all of it
                ok = np.flatnonzero(gain_ok(np.full(len(others), size)))
                if len(ok):
                    best, change = size, (out, None, int(home[ok[np.argmin(room[ok])]]))
                    continue
            shift = size - back
            ok = np.where(gain_ok(shift), shift, 0)
            k = int(np.argmax(ok))
            if ok[k] > best:
                best, change = int(ok[k]), (out, int(others[k]), int(home[k]))
    if change is None:
        return False
    out, taken, b = change
    bins[list(out)] = b
    if taken is not None:
        bins[taken] = a
    fill[a] -= best
    fill[b] += best
    return True


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: ids of each document with ``end_id``, cut only where longer
    than ``capacity``. A null text is empty and has just the end id."""
    end = np.array([end_id], "<u4").tobytes()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        flush = lambda: pa.RecordBatch.from_pydict(dict(zip(
            ("doc_id", "piece", "start", "length", "ids_crc32"),
            (pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), *[pa.int64()] * 3))))))
        for doc_id, ids in encoded(batches, tokenizer):
            ids += end
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            if len(rows) >= 10_000:
                yield flush()
                rows = []
        if rows:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def _pack_groups(rows: DataFrame, capacity: int) -> DataFrame:
    """Pack ``rows(uid, length, ...)`` in groups dealt by hash: adds ``_group, _bin, offset, fill``."""
    tokens, n = rows.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    groups = max(1, -(-tokens // (capacity * GROUP_BINS)), -(-n // GROUP_ROWS))
    columns = rows.columns

    def run(table: pa.Table) -> pa.Table:
        sizes = table.column("length").to_numpy()
        bins = local_search(sizes, best_fit(sizes, capacity), capacity)
        order = np.lexsort((np.arange(len(sizes)), bins))
        ends = np.cumsum(sizes[order])
        first = np.flatnonzero(np.diff(bins[order], prepend=-1))
        base = np.repeat((ends - sizes[order])[first], np.diff(np.append(first, len(order))))
        fill = np.bincount(bins, weights=sizes).astype(np.int64)[bins[order]]
        out = table.take(pa.array(order))
        return out.append_column("_bin", pa.array(bins[order])).append_column(
            "offset", pa.array(ends - sizes[order] - base)).append_column("fill", pa.array(fill))

    kinds = {"piece": "int"}
    schema = ", ".join(f"{c} {kinds.get(c, 'long')}" for c in columns) + ", _group long, _bin long, offset long, fill long"
    dealt = rows.withColumn("_group", F.pmod(F.xxhash64("uid"), F.lit(groups)).cast("long"))
    return dealt.groupBy("_group").applyInArrow(run, schema)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id, offset`` to ``pieces(doc_id, piece, start, length, ids_crc32)``.

    Pieces that fill a sequence stand alone. The others are dealt into groups of bounded size by a hash of their
    row, whatever their document, and packed group by group; loosely filled sequences of all groups are then packed
    together once more. No pieces, no sequences. Repeated rows are packed each.
    """
    rows = settle(pieces).withColumn("uid", F.monotonically_increasing_id())  # stable: the rows are written
    number = lambda kind: (F.col("_group") * (1 << 32) + F.col("_bin")) * 4 + kind
    keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = rows.filter(F.col("length") == capacity).withColumn("sequence_id", F.col("uid") * 4)
    first = settle(_pack_groups(rows.filter(F.col("length") < capacity), capacity))
    tight = first.filter(F.col("fill") >= LOOSE * capacity).withColumn("sequence_id", number(1))
    loose = first.filter(F.col("fill") < LOOSE * capacity).select(*rows.columns)
    again = _pack_groups(loose, capacity).withColumn("sequence_id", number(2))
    whole = full.withColumn("offset", F.lit(0).cast("long"))
    return whole.select(*keep, "sequence_id", "offset").unionByName(
        tight.select(*keep, "sequence_id", "offset")).unionByName(again.select(*keep, "sequence_id", "offset"))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """:func:`token_pieces` of ``docs(doc_id, text)`` and :func:`pack_pieces`."""
    return pack_pieces(token_pieces(docs, tokenizer, end_id, capacity), capacity)
