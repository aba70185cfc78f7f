"""Benchmark passages in training texts, found with suffix arrays over shards of the training words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import LOWER, utf8

WINDOW = 10
MAX_BLOCK_BYTES = 32 << 20  # benchmark text that one pass ships to the executors
SHARD_WORDS = 4_000_000
SHARD_BYTES = 64 << 20
EXPAND = 4_000_000

# Word characters are digits, letters and all beyond ASCII; the rest of ASCII separates.
WORDS = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(128)) + bytes(range(128, 256))
WORDS = LOWER.translate(WORDS)


class Windows(NamedTuple):
    """The searched suffixes of a benchmark block: one for each place where a window starts."""

    vocabulary: dict[bytes, int]
    words: np.ndarray  # word numbers of all items, end to end
    item: np.ndarray  # per suffix: number of its item
    place: np.ndarray  # per suffix: word position in the item
    start: np.ndarray  # per suffix: position in ``words``
    width: np.ndarray  # per suffix: words of its window
    item_ids: list

    @property
    def shortest(self) -> int:
        return int(self.width.min()) if len(self.width) else 0


def benchmark_windows(items: list[tuple], window: int = WINDOW) -> Windows:
    vocabulary: dict[bytes, int] = {}
    words, item, place, start, width, at = [], [], [], [], [], 0
    for n, (_, text) in enumerate(items):
        own = (text or "").encode().translate(WORDS).split()
        size = min(window, len(own))
        words += [vocabulary.setdefault(w, len(vocabulary) + 1) for w in own]
        starts = range(len(own) - size + 1) if own else ()
        item += [n] * len(starts)
        place += starts
        start += [at + s for s in starts]
        width += [size] * len(starts)
        at += len(own)
    ints = lambda x: np.array(x, np.int64)
    return Windows(vocabulary, ints(words), ints(item), ints(place), ints(start), ints(width), [i for i, _ in items])


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes in the order of their first ``depth`` words or more (prefix doubling)."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.zeros(n, np.int64)
    rank[order[1:]] = np.cumsum(text[order[1:]] != text[order[:-1]])
    done = 1
    while done < depth and n and rank[order[-1]] < n - 1:
        ahead = np.full(n, -1)
        ahead[: n - done] = rank[done:]
        key = rank * (n + 1) + ahead + 1
        order = np.argsort(key, kind="stable")
        rank = np.zeros(n, np.int64)
        rank[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
        done *= 2
    return order


def _bound(column, lo: np.ndarray, hi: np.ndarray, wanted: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of every query at once, each in its own range of the suffix array."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        value = column(np.where(open_, mid, 0))
        up = open_ & ((value <= wanted) if right else (value < wanted))
        lo, hi = np.where(up, mid + 1, lo), np.where(open_ & ~up, mid, hi)
    return lo


def search(text: np.ndarray, order: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per window that occurs: its number and its range in the suffix array, narrowed word by word."""
    padded = np.concatenate((text, np.zeros(int(windows.width.max(initial=0)), text.dtype)))
    live = np.arange(len(windows.item))
    lo, hi = np.zeros(len(live), np.int64), np.full(len(live), len(order))
    found = []
    for k in range(int(windows.width.max(initial=0))):
        wanted = windows.words[windows.start[live] + k]
        column = lambda m: padded[order[m] + k]  # noqa: B023, E731
        lo, hi = _bound(column, lo, hi, wanted, False), _bound(column, lo, hi, wanted, True)
        held = hi > lo
        live, lo, hi = live[held], lo[held], hi[held]
        full = windows.width[live] == k + 1
        found.append((live[full], lo[full], hi[full]))
        live, lo, hi = live[~full], lo[~full], hi[~full]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (live, lo, hi)


class Shard:
    """Words of some documents that may matter: runs of benchmark words at least a window long."""

    def __init__(self, windows: Windows):
        self.windows, self.parts = windows, []
        self.docs = self.size = self.bytes = 0

    def add(self, data: bytes) -> int:
        """Take one document; its number of words."""
        words = data.translate(WORDS).split()
        ids = np.fromiter(map(self.windows.vocabulary.get, words, repeat(0)), np.int32, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], ids > 0, [0])).astype(np.int8)))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if e - s >= max(1, self.windows.shortest):
                self.parts.append((self.docs, s, ids[s:e]))
                self.size += e - s + 1
        self.docs += 1
        self.bytes += len(data)
        return len(words)

    def matches(self):
        """Hit words as (document, word) arrays in order, and the longest match of each (document, item) as rows
        ``(doc, item, item start, document start, words)``."""
        w, gap = self.windows, [np.zeros(1, np.int32)]
        none = np.zeros((0, 5), np.int64)
        if not self.parts:
            return (none[:, 0], none[:, 0]), none
        text = np.concatenate([x for _, _, run in self.parts for x in (run, *gap)])
        sizes = np.array([len(run) + 1 for _, _, run in self.parts])
        doc = np.repeat([d for d, _, _ in self.parts], sizes)
        begin = np.repeat(np.array([s for _, s, _ in self.parts]) - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
        order = suffix_array(text, int(w.width.max()))
        window, lo, hi = search(text, order, w)
        edge = np.zeros(len(text) + 1, np.int64)
        rows = [none]
        cut = np.flatnonzero(np.diff(np.cumsum(hi - lo) // EXPAND, prepend=-1)).tolist()  # bounded parts
        for a, b in zip(cut, [*cut[1:], len(window)]):
            count = (hi - lo)[a:b]
            of = np.repeat(window[a:b], count)
            within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at = order[np.repeat(lo[a:b], count) + within]
            np.add.at(edge, at, 1)
            np.add.at(edge, at + w.width[of], -1)
            rows.append(_longest(np.stack((doc[at], w.item[of], w.place[of], at + begin[at], w.width[of]), 1)))
        hit = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        return (doc[hit], begin[hit] + hit), _best(np.concatenate(rows))


def _longest(rows: np.ndarray) -> np.ndarray:
    """Windows that follow each other at the same shift make one match."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows[:, 2], rows[:, 3] - rows[:, 2], rows[:, 1], rows[:, 0]))]
    step = np.diff(rows, axis=0)
    new = np.concatenate(([True], (step[:, :2] != 0).any(1) | (step[:, 2] != 1) | (step[:, 3] != 1)))
    first = np.flatnonzero(new)
    runs = np.diff(np.concatenate((first, [len(rows)])))
    out = rows[first].copy()
    out[:, 4] += runs - 1
    return _best(out)


def _best(rows: np.ndarray) -> np.ndarray:
    """The longest row of each (document, item); the first place on ties."""
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], -rows[:, 4], rows[:, 1], rows[:, 0]))]
    new = np.concatenate((np.ones(min(1, len(rows)), bool), (np.diff(rows[:, :2], axis=0) != 0).any(1)))
    return rows[new]


def find_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = MAX_BLOCK_BYTES):
    """Per row of ``docs(doc_id, text)``: ``doc_id, n_words, n_hit, matches``.

    ``matches`` has, for every item of ``items(item_id, text)`` with a window in the document, the longest verbatim
    match: ``item_id, item_start, doc_start, n_words`` (word positions; ids as strings). A document word counts as
    hit inside any occurrence of a window; an item shorter than ``window`` is one window. Null and empty texts have
    no words; null or repeated ids are kept as they are, repeated rows each come back, and no items means no hits.

    No shuffle: every task builds suffix arrays over shards of its own documents. A shard keeps only runs of
    benchmark words that a window fits in, which loses no match. The items are shipped in blocks of about
    ``block_bytes``, with one more pass over the documents for each block; sizes are summed before any is fetched.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 64
    total = items.agg(F.sum(size)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    out = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    for n in range(blocks):
        part = items.filter(block == n) if blocks > 1 else items
        rows = [tuple(r) for r in part.select(F.col("item_id").cast("string"), "text").collect()]
        out = _search_block(out, rows, window, n > 0, n + 1 == blocks)
    return out


_MATCH = pa.list_(
    pa.struct([("item_id", pa.string()), ("item_start", pa.int64()), ("doc_start", pa.int64()), ("n_words", pa.int64())])
)
_MATCH_SQL = "array<struct<item_id string, item_start long, doc_start long, n_words long>>"


def _search_block(docs: DataFrame, items: list[tuple], window: int, more: bool, last: bool) -> DataFrame:
    """One pass. Between passes the text goes along with a bit per word for the hits so far."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(benchmark_windows(items, window))

    def result(held: list, counts: list[int], shard: Shard) -> pa.RecordBatch:
        (doc, word), rows = shard.matches()
        found: list[list] = [[] for _ in counts]
        for d, i, at, place, n in rows.tolist():
            found[d].append(dict(item_id=shard.windows.item_ids[i], item_start=at, doc_start=place, n_words=n))
        hits, bits = np.bincount(doc, minlength=len(counts)), [None] * len(counts)
        if more or not last:
            cut = np.searchsorted(doc, np.arange(len(counts) + 1))
            for d, n in enumerate(counts):
                seen = np.zeros(n, bool)
                if more:
                    seen |= np.unpackbits(np.frombuffer(held[d][2], np.uint8), count=n).astype(bool)
                    found[d] = held[d][3] + found[d]
                seen[word[cut[d] : cut[d + 1]]] = True
                hits[d], bits[d] = seen.sum(), np.packbits(seen).tobytes()
        columns = {
            "doc_id": pa.array([h[0] for h in held], ids), "n_words": pa.array(counts, pa.int64()),
            "n_hit": pa.array(hits.astype(np.int64)), "matches": pa.array(found, _MATCH),
        }
        if not last:
            columns |= {"text": pa.array([h[1].decode() for h in held]), "hit": pa.array(bits, pa.binary())}
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal ids
        held, counts, shard = [], [], Shard(shipped.value)
        for batch in batches:
            ids = batch.column(0).type
            more_columns = [c.to_pylist() for c in batch.columns[2:]] or [[None] * batch.num_rows] * 2
            for doc_id, data, *rest in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), *more_columns):
                counts.append(shard.add(data))
                held.append((doc_id, data if not last else None, *rest))
                if shard.size >= SHARD_WORDS or shard.bytes >= SHARD_BYTES:
                    yield result(held, counts, shard)
                    held, counts, shard = [], [], Shard(shipped.value)
        if held:
            yield result(held, counts, shard)

    ids = None
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_hit long, matches {_MATCH_SQL}" + ("" if last else ", text string, hit binary")
    columns = ["doc_id", "text", *(["hit", "matches"] if more else [])]
    return docs.select(*columns).mapInArrow(run, schema)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """:func:`find_matches` with ``contaminated`` (a word is hit). What to remove is the caller's choice."""
    return find_matches(docs, items, window).withColumn("contaminated", F.col("n_hit") > 0)
