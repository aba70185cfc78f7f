"""Language-model scores: a small causal self-attention model in numpy on subword ids, mixed with counts of word
beginnings in the corpus and earlier in the document."""

from __future__ import annotations

import copy
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import LOWER, shared_path, utf8
from .tokens import encoder, release

DIM, CLASSES, WINDOW, STRIDE, TOPICS = 16, 64, 32, 28, 6
STEPS, BATCH, RATE = 500, 96, 0.02  # a task trains on at least so many batches of windows, if the corpus has them
ROUNDS, BUFFER = 4, 4096  # weights are averaged after each round; windows that are mixed before they are dealt to batches
SKETCH, TURNS = 32, 10  # numbers that stand for a document's subwords; rounds of clustering
RATIOS = 8  # steps of a factor of two, by which places are told apart when the mixture is fitted
FIXED = 1 << 20  # sums over tasks are of whole numbers, so that they do not depend on the order of the tasks
FREQUENT = 300_000  # words whose counts go to every task; the others are joined
DEPTH, BEGINNINGS = 8, 400_000  # subwords of a word beginning; how many of the commonest go to every task, others are joined
CHUNK, PLACES, BATCH_BYTES = 64, 30_000, 500_000  # windows and places (few enough for a core's cache), and bytes of text, that are worked on at once
SLOT_BITS, LEVELS = 20, 5  # bits that find a beginning in its table; steps of its count in the document
NO_ROWS = np.zeros((0, 3), np.int64)


def words_of(data: bytes) -> list[str]:
    """Words between ASCII blanks, with A-Z in lower case."""
    return b" ".join(data.translate(LOWER).split()).decode().split(" ") if data.strip(b" \t\n\r\x0b\x0c") else []


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, so that few texts at a time are copied into Python."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder once, in compressed columns."""
    path = shared_path(df.sparkSession, "attention-lm")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept_by(df: DataFrame, key: str) -> DataFrame:
    """As :func:`kept`, in buckets by ``key``: a join on it moves the other side only."""
    spark, name = df.sparkSession, f"tidewatch_{uuid.uuid4().hex}"
    buckets = 4 * spark.sparkContext.defaultParallelism
    df.write.format("parquet").bucketBy(buckets, key).option("path", shared_path(spark, "attention-lm")).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name alone: the files are in the shared folder
    return table


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, c)`` over all rows of ``docs(doc_id, text)``, summed up inside each task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        out = lambda: pa.record_batch([pa.array(list(held.keys())), pa.array(list(held.values()), pa.int64())], names=["word", "c"])
        for batch in _slices(batches):
            for data in utf8(batch.column(0)):
                held.update(words_of(data))
                if len(held) > 500_000:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def beginnings(ids: np.ndarray, begins: np.ndarray, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Per subword, a hash of its word up to it and how many subwords that is; ``begins`` marks the ids that start a word.
    Words start at the places ``first``, too."""
    at = np.arange(len(ids))
    starts = begins[ids]
    if first is not None:
        starts[first] = True
    depth = at - np.maximum.accumulate(np.where(starts, at, 0)) + 1
    out = (ids + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(2, DEPTH + 1):
        deep = np.flatnonzero(depth == k)
        if not len(deep):
            break
        out[deep] += (out[deep - 1] ^ (out[deep - 1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out.view(np.int64), depth


def earlier(doc: np.ndarray, key: np.ndarray, flag: np.ndarray, over_all: bool = True) -> tuple[np.ndarray, ...]:
    """Per place: how many earlier places of its document have its key, how many of those are flagged, and, if ``over_all``, both
    numbers over the whole document."""
    n = len(key)
    bits = np.uint64(max(1, int(n).bit_length()))
    mixed = (key.view(np.uint64) ^ (doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0x9E3779B97F4A7C15)
    packed = np.sort((mixed >> bits << bits) | np.arange(n, dtype=np.uint64))  # by key, then by place
    place, group = (packed & np.uint64((1 << int(bits)) - 1)).astype(np.int64), packed >> bits
    new = np.append(True, group[1:] != group[:-1])
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    marked = flag[place].astype(np.int64)
    flagged = np.cumsum(marked) - marked  # before the place, in sorted order
    out = np.empty((4 if over_all else 2, n), np.int64)
    out[0, place] = np.arange(n) - np.take(first, group)
    out[1, place] = flagged - np.take(flagged[first], group)
    if over_all:
        out[2, place], out[3, place] = np.take(np.diff(np.append(first, n)), group), np.take(np.add.reduceat(marked, first), group)
    return tuple(out)


def shifted(x: np.ndarray, first: np.ndarray, at_first: int) -> np.ndarray:
    """Per place, what the place before it has; ``at_first`` where a document begins."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[first] = at_first
    return out


def doublings(x: np.ndarray) -> np.ndarray:
    """0 for 0, else one more than the whole part of the number's logarithm to the base 2."""
    return np.maximum((x.astype(np.float64).view(np.int64) >> 52) - 1022, 0)


def subword_counts(counts: DataFrame, tokenizer: str, begins: np.ndarray) -> DataFrame:
    """``(kind, key, n, ended)`` over the counted words. Kind 0: how often the subword id ``key`` occurs. Kind 1: words that
    begin with the subwords hashed in ``key``, and those that consist of them. Summed up inside each batch first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            found = coder.encode_each(batch.column(0).to_pylist())
            sizes = np.array([len(x) // 4 for x in found], np.int64)
            ids = np.frombuffer(b"".join(found), "<u4").astype(np.int64)
            n = np.repeat(batch.column(1).to_numpy(), sizes)
            last = np.zeros(len(ids), bool)
            last[np.cumsum(sizes)[sizes > 0] - 1] = True
            key, depth = beginnings(ids, begins)
            short = depth <= DEPTH
            for kind, keys, c, done in ((0, ids, n, n * 0), (1, key[short], n[short], (n * last)[short])):
                each, inverse = np.unique(keys, return_inverse=True)
                total, ended = (np.bincount(inverse, x, len(each)).astype(np.int64) for x in (c, done))
                yield pa.record_batch([pa.array(np.full(len(each), kind, np.int32)), *map(pa.array, (each, total, ended))], names=["kind", "key", "n", "ended"])

    parts = counts.select("word", "c").mapInArrow(run, "kind int, key long, n long, ended long")
    return kept(parts.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("ended").alias("ended")))


def commonest(df: DataFrame, c: str, bound: int) -> DataFrame | None:
    """The rows with a count that at most ``bound`` rows reach; all rows of equal counts, or none."""
    least, held = None, 0
    for r in df.groupBy(c).agg(F.count("*").alias("k")).orderBy(F.desc(c)).limit(bound).collect():
        held += r["k"]
        if held > bound:
            break
        least = r[c]
    return None if least is None else df.filter(F.col(c) >= least)


def sketch(docs: list[np.ndarray], place: np.ndarray, rays: np.ndarray) -> np.ndarray:
    """A few numbers per document: the square roots of the shares of the commonest subwords, whose column ``place`` gives,
    on random rays."""
    common = len(rays)
    share = np.array([np.bincount(place[d], minlength=common + 1)[:-1] / max(1, len(d)) for d in docs]).reshape(-1, common)
    return np.sqrt(share) @ rays


def topics(docs: list[np.ndarray], size: int) -> np.ndarray:
    """The cluster of documents that uses each subword most, by k-means on sketches of ``docs``; subwords
    that the documents don't have are a topic of their own."""
    docs = [d for d in docs if len(d)]
    place, rays = commonest_places(np.bincount(np.concatenate(docs), minlength=size) if docs else np.zeros(size))
    x = sketch(docs, place, rays)
    if len(docs) < 2 * TOPICS:
        return np.full(size, TOPICS)
    centre, mean = first_centres(), x.mean(axis=0)
    for _ in range(TURNS):
        near = nearest(x - mean, centre)
        centre = np.array([(x - mean)[near == k].mean(axis=0) if (near == k).any() else centre[k] for k in range(TOPICS)])
    near = nearest(x - mean, centre)
    return topics_of(np.array([np.bincount(np.concatenate([d for d, m in zip(docs, near) if m == k] or [docs[0][:0]]), minlength=size) for k in range(TOPICS)]))


def commonest_places(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The column of each subword among the 1,000 commonest, and the rays that these are sketched on."""
    common = np.argsort(-total, kind="stable")[:1000]
    place = np.full(len(total), len(common))
    place[common] = np.arange(len(common))
    return place, np.random.default_rng(3).normal(size=(len(common), SKETCH))


def first_centres() -> np.ndarray:
    return np.random.default_rng(4).normal(size=(TOPICS, SKETCH))


def nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centre.T / np.maximum(1e-9, np.linalg.norm(centre, axis=1)), axis=1)


def topics_of(use: np.ndarray) -> np.ndarray:
    """From the counts of subwords by cluster, the cluster that uses each most."""
    share = use / np.maximum(1, use.sum(axis=1, keepdims=True))
    return np.where(use.sum(axis=0) > 0, np.argmax(share, axis=0), TOPICS)


class Table:
    """The word beginnings that go to every task: rows of key, words with that beginning, words that end there."""

    def __init__(self, table: np.ndarray, begins: np.ndarray):
        self.begins = begins
        table = table[np.argsort(table[:, 0].copy().view(np.uint64))]
        self.keys = table[:, 0].copy().view(np.uint64)
        self.n, self.ended = (np.append(table[:, k], 0) for k in (1, 2))  # the last row is for beginnings that are not there
        self.slot = np.searchsorted(self.keys, np.arange(1 << SLOT_BITS, dtype=np.uint64) << np.uint64(64 - SLOT_BITS))
        self.slot = np.append(self.slot, len(self.keys)).astype(np.int32)
        alone = np.arange(len(begins))
        self.single = self.counted(beginnings(alone, begins, alone)[0])  # rows of the beginnings of one subword

    def counted(self, key: np.ndarray) -> np.ndarray:
        """Row of the corpus's table per beginning, -1 where it has none."""
        key = key.view(np.uint64)
        slot = (key >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        at, stop = self.slot[slot].astype(np.int64), self.slot[slot + 1]
        out = np.full(len(key), -1)
        open_ = np.flatnonzero(at < stop)
        while len(open_):
            same = self.keys[at[open_]] == key[open_]
            out[open_[same]] = at[open_[same]]
            open_ = open_[~same]
            at[open_] += 1
            open_ = open_[at[open_] < stop[open_]]
        return out

    def rows_of(self, ids: np.ndarray, key: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """As :meth:`counted`, for beginnings with that last subword and depth; -1 for those that are too deep, too."""
        at = np.take(self.single, ids)
        deep = np.flatnonzero(depth > 1)
        at[deep] = -1
        deep = deep[np.take(depth, deep) <= DEPTH]
        at[deep] = self.counted(np.take(key, deep))
        return at

    def counts_of(self, ids: np.ndarray, key: np.ndarray, depth: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of the corpus that begin so, and those that end there too; ``rare`` as the table, for keys it does not have."""
        at = self.rows_of(ids, key, depth)
        n, ended = np.take(self.n, at), np.take(self.ended, at)
        if len(rare):
            rare = rare[np.argsort(rare[:, 0])]
            open_ = np.flatnonzero((at < 0) & (depth <= DEPTH))
            spot = np.minimum(np.searchsorted(rare[:, 0], key[open_]), len(rare) - 1)
            same = rare[spot, 0] == key[open_]
            n[open_[same]], ended[open_[same]] = rare[spot[same], 1], rare[spot[same], 2]
        return n, ended

    def unknown(self, ids: np.ndarray) -> np.ndarray:
        """The word beginnings of one document that the table does not have."""
        return self.unknown_of([ids])[0]

    def unknown_of(self, docs: list[np.ndarray]) -> list[np.ndarray]:
        """As :meth:`unknown`, of several documents, each of which starts a word."""
        sizes = np.array([len(d) for d in docs], np.int64)
        if not sizes.sum():
            return [np.zeros(0, np.int64) for _ in docs]
        flat, first = np.concatenate(docs), (np.cumsum(sizes) - sizes)[sizes > 0]
        key, depth = beginnings(flat, self.begins, first)
        missing = np.flatnonzero((self.rows_of(flat, key, depth) < 0) & (depth <= DEPTH))
        doc = np.repeat(np.arange(len(docs)), sizes)[missing]
        return [np.unique(k) for k in np.split(key[missing], np.searchsorted(doc, np.arange(1, len(docs))))]

class Model(Table):
    """p(subword | before): a mixture of four ways to go on.

    1. Attention: p(class | before) x p(subword | class). 2. Counts: how the words of the corpus go on that begin like
    the present one, and if it ends, what words begin with. 3. Counts inside words, attention for the next word's
    beginning. 4. As 2, by the words earlier in the same document; where none begins like the present one, the corpus
    says how it goes on. The weights of the mixture depend on how often the present beginning was counted in the corpus
    and in the document so far.

    Classes are ranges of about equal mass of the subwords in order of topic (a cluster of documents),
    whether they begin a word, and frequency. One causal attention head over position
    and subword vectors gives the class; the share inside a class is that of the whole corpus, plus one.
    """

    def __init__(self, counts: np.ndarray, size: int, ends: int, docs: list[np.ndarray], begins: np.ndarray, table: np.ndarray, words: int,
                 topic: np.ndarray | None = None):
        """``table``: rows of key, words with that beginning, words that end there; ``words``: all counted words; ``topic``: of
        each subword, if it is known, else that of ``docs``."""
        self.end = size  # the id that starts and ends a document
        begins = np.asarray(begins, bool).copy()
        begins[size] = True
        super().__init__(table, begins)
        self.ends, self.words = ends, words
        self.level = np.minimum(doublings(np.arange(1, 1 << LEVELS)) - 1, LEVELS - 1)  # by the count in the document so far
        # By the beginning's count in the corpus (none, or its power of two) and in the document. Ways that know nothing have no weight.
        self.prior = np.full((65, LEVELS, 4), 1 / 4)
        self.prior[0, 0], self.prior[0, 1:] = (1, 0, 0, 0), (0.5, 0, 0, 0.5)
        self.prior = self.prior.reshape(-1, 4)
        self.weights = self.prior.copy()
        n = np.zeros(size + 1)
        n[: len(counts)] = counts
        n[size] = ends
        n += 1
        order = np.lexsort((-n, begins, topics(docs, size + 1) if topic is None else topic))
        mass = np.cumsum(n[order]) / n.sum()
        self.of = np.empty(size + 1, np.int64)
        self.of[order] = np.minimum((mass - n[order] / n.sum() / 2) * CLASSES, CLASSES - 1).astype(np.int64)
        mass = np.bincount(self.of, n, CLASSES)
        self.inside = np.log(n / mass[self.of])
        self.starts = (np.bincount(self.of, n * begins, CLASSES) / np.maximum(mass, 1e-9)).astype(np.float32)  # share of word beginnings
        rng = np.random.default_rng(11)
        draw = lambda *shape: (rng.normal(size=shape) * 0.1).astype(np.float32)
        self.p = {
            "token": np.zeros((size + 1, DIM), np.float32), "class": draw(CLASSES, DIM), "place": draw(WINDOW, DIM),
            "q": draw(DIM, DIM), "k": draw(DIM, DIM), "v": draw(DIM, DIM), "o": draw(DIM, DIM), "out": draw(DIM, CLASSES),
            "bias": np.log(np.bincount(self.of, n, CLASSES) / n.sum() + 1e-9).astype(np.float32),
        }
        self.mask = np.tril(np.ones((WINDOW, WINDOW), np.float32))
        self.freeze()

    def _last_layer(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The attention's outcome at the places that count. The sums of the weights come from a column of ones in the values,
        so the weights themselves are passed over as seldom as can be."""
        x = np.take(self.embedded, ids, axis=0)
        x += self.p["place"]
        rows = x.reshape(-1, DIM)
        q, k = ((rows @ w).reshape(x.shape) for w in (self.query, self.p["k"]))
        v = rows @ self.value
        v[:, DIM] = 1  # the value's last column is zero
        v = v.reshape(*ids.shape, DIM + 1)
        a = q @ np.ascontiguousarray(k.transpose(0, 2, 1))
        np.clip(a, -60, 60, out=a)
        np.exp(a, out=a)
        a *= self.mask
        mixed = np.take((a @ v).reshape(-1, DIM + 1), counts, axis=0)
        return np.take(rows, counts, axis=0) + (mixed[:, :DIM] / mixed[:, DIM:]) @ self.p["o"]

    def attend(self, ids: np.ndarray, targets: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """At the places that count: probability of the target, and of any word beginning, after the ids of the
        window up to there."""
        counts = np.flatnonzero(counts)
        h, targets = self._last_layer(ids, counts), np.take(targets, counts)
        z = np.concatenate((h, np.ones((len(h), 1), np.float32)), axis=1) @ self.outward
        np.clip(z, -80, 80, out=z)
        np.exp(z, out=z)
        total, begin = (z @ self.sums).T
        own = np.take(z, np.arange(len(z)) * CLASSES + np.take(self.of, targets)) / total
        return own * np.take(self.share, targets), (begin / total).astype(np.float64)

    def ways(self, docs: list[np.ndarray], counted_too: bool = False, rare: np.ndarray = NO_ROWS) -> tuple[np.ndarray, np.ndarray]:
        """``(probabilities, bucket)`` per subword of ``docs``, each followed by its end: one column per part of the
        mixture, and the row of its weights. ``counted_too``: the documents were counted, so each one's own counts
        are taken off again. ``rare``: rows of the whole corpus's table for beginnings that the model's has not."""
        parts = [self.windows(d) for d in docs]
        ids, targets, counts = (np.concatenate(x) for x in zip(*parts))
        found = [self.attend(ids[k : k + CHUNK], targets[k : k + CHUNK], counts[k : k + CHUNK]) for k in range(0, len(ids), CHUNK)]
        attention, begin = (np.concatenate(x) for x in zip(*found))
        sizes = np.array([len(d) + 1 for d in docs])
        flat = np.concatenate([x for d in docs for x in (d, [self.end])])
        doc, first = np.repeat(np.arange(len(docs)), sizes), np.cumsum(sizes) - sizes
        key, depth = beginnings(flat, self.begins)
        starts = self.begins[flat]
        last = np.append(starts[1:], True)  # the word ends here
        n, ended = self.counts_of(flat, key, depth, rare)
        before, before_ended, *whole = earlier(doc, key + (depth > DEPTH), last, counted_too)
        words = np.float64(max(1, self.words + self.ends))
        if counted_too:
            n, ended = np.maximum(n - whole[0], 0), np.maximum(ended - whole[1], 0)
            words = np.maximum(1, self.words + self.ends - np.add.reduceat(starts.astype(np.int64), first))[doc]
        is_end = first + sizes - 1
        n[is_end] = ended[is_end] = self.ends - counted_too
        n_before, ended_before = shifted(n, first, self.ends), shifted(ended, first, self.ends)
        deep = np.flatnonzero(shifted(depth, first, 1) >= DEPTH)
        n_before[deep] = ended_before[deep] = 0
        doc_before, doc_ended = shifted(before, first, 0), shifted(before_ended, first, 0)
        doc_before[deep] = 0
        bucket = doublings(n_before) * LEVELS + np.take(self.level, np.minimum(doc_before, len(self.level) - 1))
        out = np.empty((4, len(flat)))  # a row per part; the transpose is returned
        over = np.maximum(n_before, 1)
        within = np.minimum(1, n / over)
        out[0] = attention
        out[1:] = within
        new = np.flatnonzero(starts)
        stop, first_n = np.minimum(1, ended_before[new] / over[new]), n[new]
        out[1, new] = stop * first_n / (words if np.ndim(words) == 0 else words[new])
        out[2, new] = np.minimum(1, stop * attention[new] / np.maximum(begin[new], 1e-9))
        words_before = np.cumsum(starts) - starts
        words_before = np.maximum(1, words_before - words_before[first][doc])[new]
        inside = np.flatnonzero(doc_before)
        seen = np.take(doc_before, inside)
        out[3, inside] = before[inside] / seen
        here = stop
        of_seen = np.flatnonzero(np.take(doc_before, new))
        here[of_seen] = doc_ended[new[of_seen]] / doc_before[new[of_seen]]
        out[3, new] = here * before[new] / words_before
        out[3, is_end] = 0
        out[3, first] = out[1, first]  # no word before: the corpus says what words begin with
        np.minimum(out[3], 1, out=out[3])
        return out.T, bucket

    def tune(self, docs: list[np.ndarray], rare: np.ndarray = NO_ROWS) -> None:
        """Weights of the mixture from ``docs``, which were counted."""
        if docs:
            p, bucket = self.ways(docs, True, rare)
            self.weigh(p, bucket, np.ones(len(p)))

    def weigh(self, p: np.ndarray, bucket: np.ndarray, times: np.ndarray, rounds: int = 25) -> None:
        """Weights of the mixture by expectation maximisation; each row counts ``times``. Each bucket starts with a few
        doubtful rows, so a rare one keeps some weight on each way that may know something."""
        for _ in range(rounds):
            share = p * self.weights[bucket]
            share *= (times / np.maximum(share.sum(axis=1), 1e-300))[:, None]
            total = np.stack([np.bincount(bucket, share[:, k], len(self.prior)) for k in range(4)], axis=1) + 4 * self.prior
            self.weights = total / total.sum(axis=1, keepdims=True)

    def freeze(self) -> None:
        """What scoring needs of the trained weights."""
        self.embedded = self.p["token"] + self.p["class"][self.of]
        self.query = self.p["q"] * np.float32(DIM**-0.5)
        self.value = np.concatenate((self.p["v"], np.zeros((DIM, 1), np.float32)), axis=1)
        self.outward = np.concatenate((self.p["out"], self.p["bias"][None]))
        self.share = np.exp(self.inside)
        self.sums = np.stack([np.ones(CLASSES, np.float32), self.starts], axis=1)

    def windows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs, targets and which places count, of overlapping windows over one document: each target counts
        once, after the first window with at least ``WINDOW - STRIDE`` ids before it."""
        whole = np.concatenate(([self.end], ids, [self.end]))
        n = len(whole) - 1
        count = 1 + max(0, -(-(n - WINDOW) // STRIDE))
        at = (np.arange(count) * STRIDE)[:, None] + np.arange(WINDOW)
        padded = np.concatenate((whole, np.full(WINDOW, self.end)))
        counts = (at < n) & ((np.arange(WINDOW) >= WINDOW - STRIDE) | (np.arange(count) == 0)[:, None])
        return padded[np.minimum(at, n)], padded[np.minimum(at + 1, n)], counts

    def scores(self, docs: list[np.ndarray], rare: np.ndarray = NO_ROWS) -> np.ndarray:
        """log10 probability of each document, its end included."""
        if not docs:
            return np.zeros(0)
        p, bucket = self.ways(docs, rare=rare)
        whole = sum(np.take(self.weights[:, k], bucket) * p[:, k] for k in range(4))
        first = np.concatenate(([0], np.cumsum([len(d) + 1 for d in docs])[:-1]))
        return np.add.reduceat(np.log10(np.maximum(whole, 1e-300)), first)

    def train(self, docs: list[np.ndarray], steps: int = STEPS) -> None:
        """Adam on random batches of the windows of ``docs``."""
        if not docs:
            return
        ids, targets, counts = (np.concatenate(x) for x in zip(*[self.windows(d) for d in docs]))
        rng, state = np.random.default_rng(5), self.moments()
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(ids), BATCH)
            self.step(ids[pick], targets[pick], counts[pick], state, RATE * min(1.0, 2 * (1 - step / (steps + 1))))
        self.freeze()

    def moments(self) -> dict:
        return {"step": 0, "met": np.zeros(self.end + 1, np.int64), "first": {k: np.zeros_like(v) for k, v in self.p.items()}, "second": {k: np.zeros_like(v) for k, v in self.p.items()}}

    def step(self, b: np.ndarray, targets: np.ndarray, live: np.ndarray, state: dict, rate: float) -> None:
        """One step of Adam on a batch of windows."""
        p, first, second = self.p, state["first"], state["second"]
        state["step"] += 1
        scale, flat = np.float32(DIM**-0.5), lambda m: m.reshape(-1, m.shape[-1])
        x = np.take(p["token"], b, axis=0)
        x += np.take(p["class"], np.take(self.of, b), axis=0)
        x += p["place"]
        rows = flat(x)
        # A column of ones in the values sums up the weights of a place, which are never divided themselves.
        q, k, v = (rows @ (p["q"] * scale)).reshape(x.shape), (rows @ p["k"]).reshape(x.shape), np.ones((*b.shape, DIM + 1), np.float32)
        v[..., :DIM] = (rows @ p["v"]).reshape(x.shape)
        a = q @ np.ascontiguousarray(k.transpose(0, 2, 1))
        np.clip(a, -60, 60, out=a)  # so that no row needs its maximum taken off
        np.exp(a, out=a)
        a *= self.mask
        mixed = flat(a @ v)
        over = 1 / mixed[:, DIM:]
        mixed = mixed[:, :DIM] * over
        at = np.flatnonzero(live)  # the others have no loss
        own = np.arange(len(at)) * CLASSES + np.take(self.of, targets.reshape(-1)[at])
        h = np.ones((len(at), DIM + 1), np.float32)
        h[:, :DIM] = np.take(rows + mixed @ p["o"], at, axis=0)
        g = h @ np.concatenate((p["out"], p["bias"][None]))
        np.clip(g, -80, 80, out=g)
        np.exp(g, out=g)
        share = np.float32(1 / max(1, len(at)))
        g *= (share / (g @ np.ones(CLASSES, np.float32)))[:, None]
        g.reshape(-1)[own] -= share
        out = h.T @ g
        d = {"out": out[:DIM], "bias": out[DIM]}
        dx = np.zeros_like(rows)
        dx[at] = g @ p["out"].T
        d["o"] = mixed.T @ dx
        dm = dx @ p["o"].T
        # By the weights' logarithms: the weight times (its value's gain less the place's mean gain).
        gain = np.empty_like(v)
        np.multiply(dm, over, out=flat(gain)[:, :DIM])
        flat(gain)[:, DIM] = -np.einsum("ij,ij->i", dm, mixed) * over[:, 0]
        da = gain @ np.ascontiguousarray(v.transpose(0, 2, 1))
        da *= a
        dq, dk, dv = da @ k, da.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ np.ascontiguousarray(gain[..., :DIM])
        dq *= scale
        inner = np.concatenate((flat(dq), flat(dk), flat(dv)), axis=1)
        d |= zip("qkv", np.split(rows.T @ inner, 3, axis=1))
        dx += inner @ np.concatenate([p[n] for n in "qkv"], axis=1).T
        d["place"] = dx.reshape(x.shape).sum(axis=0)
        order = np.argsort(b.reshape(-1).astype(np.uint16 if self.end < 1 << 16 else np.int64), kind="stable")  # short keys are sorted by radix
        rows = b.reshape(-1)[order]
        start = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        rows, seen = rows[start], np.add.reduceat(np.take(dx, order, axis=0), start, axis=0)
        d["class"] = np.take(np.eye(CLASSES, dtype=np.float32), self.of[rows], axis=0).T @ seen
        state["met"][rows] += np.diff(np.append(start, b.size))
        one, two = 1 - 0.9 ** state["step"], 1 - 0.99 ** state["step"]
        for n, grad in [*d.items(), ("token", seen)]:
            at = rows if n == "token" else slice(None)
            held = (lambda x: np.take(x, at, axis=0)) if n == "token" else np.copy  # noqa: B023
            m, s, now = held(first[n]), held(second[n]), held(p[n])
            m *= np.float32(0.9)
            m += 0.1 * grad
            s *= np.float32(0.99)
            s += 0.01 * grad * grad
            now -= np.float32(rate) * (m / np.float32(one)) / (np.sqrt(s / np.float32(two)) + np.float32(1e-8))
            first[n][at], second[n][at], p[n][at] = m, s, now

    def trainee(self) -> Model:
        """What training needs of the model: without the counts of beginnings and what only scoring reads."""
        light, none = copy.copy(self), np.zeros(0, np.int64)
        light.keys = light.n = light.ended = light.slot = light.single = light.embedded = light.share = light.inside = none
        return light

    def parameters(self) -> np.ndarray:
        """All trained weights as rows of ``DIM``, those of the subwords first."""
        return np.concatenate([v.reshape(-1, DIM) for v in self.p.values()])

    def put(self, rows: np.ndarray) -> None:
        at = 0
        for k, v in self.p.items():
            self.p[k] = rows[at : at + v.size // DIM].astype(np.float32).reshape(v.shape)
            at += v.size // DIM
        self.freeze()


def encoded_words(words: DataFrame, tokenizer: str) -> DataFrame:
    """``words(word, c)`` with the ids of each word, a blank before it, as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            found = coder.encode_each(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=["word", "c", "ids"])

    return words.select("word", "c").mapInArrow(run, "word string, c long, ids binary")


class Frequent:
    """The words that go to every task, with their counts and ids; the others are encoded where they are met."""

    def __init__(self, words: list[str], counts: np.ndarray, ids: list[bytes]):
        self.place = dict(zip(words, range(len(words))))
        self.counts = counts
        self.sizes = np.array([len(x) // 4 for x in ids], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.ids = np.frombuffer(b"".join(ids), "<u4")

    def encode(self, words: list[str], tokenizer: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per word its place here, or -1, and how many ids it has; and all ids, end to end."""
        place = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        known = place >= 0
        others = list(compress(words, (~known).tolist()))
        found = encoder(tokenizer).encode_each(others)
        sizes = np.empty(len(words), np.int64)
        sizes[known] = self.sizes[place[known]]
        sizes[~known] = [len(x) // 4 for x in found]
        source = np.concatenate((self.ids, np.frombuffer(b"".join(found), "<u4")))
        first = np.empty(len(words), np.int64)
        first[known] = self.first[place[known]]
        first[~known] = len(self.ids) + np.cumsum(sizes[~known]) - sizes[~known]
        at = np.arange(sizes.sum()) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
        return place, sizes, np.take(source, at)


def _packed(ids: np.ndarray) -> bytes:
    """The ids of one document, small, for the way from the splitting to the scoring."""
    kind = "<u2" if len(ids) == 0 or ids.max() < 1 << 16 else "<u4"
    return kind.encode() + zs.ZstdCompressor(level=1).compress(ids.astype(kind).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zs.ZstdDecompressor().decompress(data[3:]), data[:3].decode()).astype(np.int64)


def _rows(table: DataFrame) -> np.ndarray:
    """Rows of key, n, ended of a bounded table."""
    return np.stack([c.to_numpy() for c in table.select("key", "n", "ended").toArrow().columns], axis=1).astype(np.int64).reshape(-1, 3)


def _topics(learned: DataFrame, size: int) -> np.ndarray:
    """As :func:`topics`, over all rows of ``learned(ids, sketch)``: each turn adds up the sketches by cluster in the tasks."""
    small = kept(learned.select("sketch")).coalesce(learned.sparkSession.sparkContext.defaultParallelism)
    points = lambda batch: np.frombuffer(b"".join(batch.column("sketch").to_pylist()), "<f4").reshape(-1, SKETCH).astype(np.float64)

    def sums(centre: np.ndarray | None, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = np.zeros(TOPICS, np.int64), np.zeros((TOPICS, SKETCH), np.int64)
            for batch in batches:
                x = points(batch) - mean
                near = np.zeros(len(x), np.int64) if centre is None else nearest(x, centre)
                np.add.at(n, near, 1)
                np.add.at(total, near, np.rint(x * FIXED).astype(np.int64))
            yield pa.record_batch([pa.array(np.repeat(np.arange(TOPICS), SKETCH)), pa.array(np.tile(np.arange(SKETCH), TOPICS)),
                                   pa.array(np.repeat(n, SKETCH)), pa.array(total.reshape(-1))], names=["k", "d", "n", "x"])

        found = small.mapInArrow(run, "k long, d long, n long, x long").groupBy("k", "d").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).toArrow()
        n, total = np.zeros((TOPICS, SKETCH), np.int64), np.zeros((TOPICS, SKETCH))
        at = found["k"].to_numpy(), found["d"].to_numpy()
        n[at], total[at] = found["n"].to_numpy(), found["x"].to_numpy() / FIXED
        return n[:, 0], total

    n, total = sums(None, np.zeros(SKETCH))
    if n.sum() < 2 * TOPICS:
        return np.full(size, TOPICS)
    mean, centre = total.sum(axis=0) / n.sum(), first_centres()
    for _ in range(TURNS):
        n, total = sums(centre, mean)
        centre = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centre)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, held, some = np.zeros(TOPICS * size, np.int64), [], 0
        for batch in batches:
            for data, k in zip(batch.column("ids"), nearest(points(batch) - mean, centre).tolist()):
                held.append(_unpacked(data.as_py()) + k * size)
                some += len(held[-1])
                if some > len(use):
                    use += np.bincount(np.concatenate(held), minlength=len(use))
                    held, some = [], 0
        if held:
            use += np.bincount(np.concatenate(held), minlength=len(use))
        at = np.flatnonzero(use)
        yield pa.record_batch([pa.array(at), pa.array(use[at])], names=["at", "n"])

    wide = learned.select("ids", "sketch").coalesce(learned.sparkSession.sparkContext.defaultParallelism)
    found = wide.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # a row per subword and topic
    use = np.zeros(TOPICS * size, np.int64)
    use[found["at"].to_numpy()] = found["n"].to_numpy()
    return topics_of(use.reshape(TOPICS, size))


def _train(model: Model, learned: DataFrame, windows: float) -> None:
    """Train the attention on all windows of all rows of ``learned(row, ids)``. In each round every task goes on from the
    same weights over its own documents; the results are averaged, a subword's by how often the tasks met it, the others by
    their windows. A large corpus is passed over once, a part in each round; a small one once a round."""
    spark = learned.sparkSession
    tasks = int(min(spark.sparkContext.defaultParallelism, max(1, windows // (STEPS * BATCH))))
    parts = ROUNDS if windows >= ROUNDS * STEPS * BATCH else 1
    names = [f"v{k}" for k in range(DIM)]
    for turn in range(ROUNDS):
        shipped = spark.sparkContext.broadcast(model.trainee())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release()  # all is encoded by now
            model = copy.copy(shipped.value)
            model.p = {k: v.copy() for k, v in model.p.items()}
            rng, state, size = np.random.default_rng((turn, TaskContext.get().partitionId())), model.moments(), model.end + 1
            met, all_, held, waiting = state["met"], 0, [], 0

            def fit(held: list, last: bool) -> list:
                ids, targets, live = (np.concatenate(x) for x in zip(*held))
                mixed = rng.permutation(len(ids))
                stop = len(ids) if last else len(ids) // BATCH * BATCH
                for at in range(0, stop, BATCH):
                    pick = mixed[at : min(at + BATCH, stop)]
                    model.step(ids[pick], targets[pick], live[pick], state, RATE / 2**turn)
                rest = mixed[stop:]
                return [(ids[rest], targets[rest], live[rest])] if len(rest) else []

            for batch in batches:
                for data in batch.column("ids"):
                    found = model.windows(_unpacked(data.as_py()))
                    all_ += len(found[0])
                    for at in range(0, len(found[0]), BUFFER):
                        held.append(tuple(x[at : at + BUFFER] for x in found))
                        waiting += len(held[-1][0])
                        if waiting >= BUFFER:
                            held = fit(held, False)
                            waiting = sum(len(x) for x, _, _ in held)
            if held:
                fit(held, True)
            rows = model.parameters().astype(np.float64)
            weight = np.full(len(rows), all_)
            weight[:size] = met
            at = np.flatnonzero(weight)
            rows = np.rint(rows[at] * weight[at][:, None] * FIXED).astype(np.int64)
            yield pa.record_batch([pa.array(at), pa.array(weight[at]), *(pa.array(rows[:, k]) for k in range(DIM))], names=["at", "w", *names])

        part = learned.filter(F.pmod(F.xxhash64("row"), F.lit(parts)) == turn % parts).select("row", "ids").coalesce(tasks)
        part = part.sortWithinPartitions("row") if tasks == 1 else part  # a small corpus
        schema = ", ".join(f"{c} long" for c in ("at", "w", *names))
        found = part.mapInArrow(run, schema).groupBy("at").agg(*[F.sum(c).alias(c) for c in ("w", *names)]).toArrow()  # a row per subword
        rows = model.parameters().astype(np.float64)
        rows[found["at"].to_numpy()] = np.stack([found[c].to_numpy() for c in names], axis=1) / FIXED / found["w"].to_numpy()[:, None]
        model.put(rows)
        shipped.destroy()  # its files, too


def _cells(p: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per place, a number that says in steps of a factor of two how its ways compare, in its bucket; and a row for each way of
    how they do exactly."""
    ratio = p.T / np.maximum(p.max(axis=1), 1e-300)
    level = np.minimum(1022 - ((ratio * 0.5**0.5).view(np.int64) >> 52), RATIOS - 1)  # the nearest power of two, from the exponent
    cell = bucket
    for k in range(4):
        cell = cell * RATIOS + level[k]
    return cell, np.rint(ratio * FIXED).astype(np.int64)


def _summed(key: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sums of the values by key, which is below 2**31."""
    packed = np.sort(key << 32 | np.arange(len(key)))
    key, order = packed >> 32, packed & (1 << 32) - 1
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else key
    return key[start], [np.add.reduceat(np.take(x, order), start) for x in values]


def _tune(model: Model, learned: DataFrame) -> None:
    """Fit the mixture to every place of all rows of ``learned(ids, rare)``. A place counts by its bucket and by how its ways
    compare, to a factor of two; the means of the exact ratios stand for the places that are alike."""
    spark = learned.sparkSession
    shipped = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held, some, least = shipped.value, [], 0, 0

        def merged() -> tuple[np.ndarray, list[np.ndarray]]:
            return _summed(np.concatenate([k for k, _ in held]), [np.concatenate(x) for x in zip(*(v for _, v in held))])

        for batch in batches:
            for docs, rare in _portions(batch):
                cell, ratio = _cells(*model.ways(docs, True, rare))
                held.append(_summed(cell, [np.ones(len(cell), np.int64), *ratio]))
                some += len(held[-1][0])
                if some > 2 * least + 4 * PLACES:  # merged when there are many more than the last time
                    held = [merged()]
                    some = least = len(held[0][0])
        if held:
            keys, sums = merged()
            yield pa.record_batch([pa.array(keys), *map(pa.array, sums)], names=["cell", "n", "a", "b", "c", "d"])

    parts = learned.select("ids", "rare").mapInArrow(run, "cell long, n long, a long, b long, c long, d long")
    found = parts.groupBy("cell").agg(*[F.sum(c).alias(c) for c in "nabcd"]).orderBy("cell").toArrow()  # at most RATIOS**4 rows a bucket
    if len(found):
        n = found["n"].to_numpy()
        p = np.stack([found[c].to_numpy() for c in "abcd"], axis=1) / FIXED / n[:, None]
        model.weigh(p, found["cell"].to_numpy() // RATIOS**4, n)
    shipped.destroy()


def _portions(batch: pa.RecordBatch) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Some documents at a time, with the rows for the beginnings that the table does not have."""
    docs, rare, size = [], [], 0
    for ids, found in zip(batch.column("ids"), batch.column("rare")):
        docs.append(_unpacked(ids.as_py()))
        if found.is_valid:
            rare.append(np.frombuffer(zs.ZstdDecompressor().decompress(found.as_py()), "<i8").reshape(-1, 3))
        size += len(docs[-1]) + 1
        if size >= PLACES:
            yield docs, _distinct(rare)
            docs, rare, size = [], [], 0
    if docs:
        yield docs, _distinct(rare)


def _distinct(rare: list[np.ndarray]) -> np.ndarray:
    if not rare:
        return NO_ROWS
    rows = np.concatenate(rare)
    return rows[np.unique(rows[:, 0], return_index=True)[1]]


def _with_rare(rows: DataFrame, begun: DataFrame) -> DataFrame:
    """``rows``, which are in buckets by row, with ``rare``, where the tasks' table lacks beginnings: each document's missing
    ones are joined to the counts of the whole corpus, so the score does not depend on how many the table holds. A document
    gets at most as many rows as it has subwords. Its ids stay where they are, and nothing is split again."""
    asked = rows.select("row", F.explode("keys").alias("key"))
    known = asked.join(begun, "key").groupBy("row").agg(F.collect_list(F.struct("key", "n", "ended")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for found in batch.column("found"):
                data = np.stack([found.values.field(k).to_numpy() for k in range(3)], axis=1).astype("<i8").tobytes()
                packed.append(zs.ZstdCompressor(level=1).compress(data))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(packed, pa.binary())], names=["row", "rare"])

    packed = kept(known.select("row", "found").mapInArrow(run, "row long, rare binary"))
    return rows.select("row", "doc_id", "n_tokens", "known", "base", "ids").join(packed, "row", "left")


def _scored(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` with their score in place of ids and counts."""
    shipped, columns = rows.sparkSession.sparkContext.broadcast(model), ["row", "doc_id", "n_tokens", "known", "base"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shipped.value.scores(docs, rare) for docs, rare in _portions(batch)]
            out = pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], out], names=[*columns, "score"])

    return rows.select(*columns, "ids", "rare").mapInArrow(run, "row long, doc_id long, n_tokens long, known long, base double, score double")


def score_documents(docs: DataFrame, tokenizer: str, vocabulary: int) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row of ``docs(doc_id, text)``.

    Tokens are words and one end. All documents but the held-out ones are counted; subword shares come from the same
    counts, and so do all word beginnings: the commonest ``BEGINNINGS`` go to every task, a document's others are joined to
    it, so how many are sent changes no score. The classes, the attention weights and the weights of the mixture are fitted
    on every place of the same documents. Frequent words are looked up in the task; how often the others occur in a document is
    joined to the counts by word. Null and empty texts have the end alone; null ids are not held out; repeated rows
    each come back.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    learned = docs.filter(~held_out())
    counts = kept(word_counts(learned))
    n_docs = learned.count()
    v, n = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    n, v = n + n_docs, v + (n_docs > 0)
    top = commonest(counts, "c", FREQUENT)
    found = None if top is None else encoded_words(top, tokenizer).toArrow().sort_by([("c", "descending")])  # the commonest lie close together
    frequent = Frequent([], np.zeros(0, np.int64), []) if found is None else Frequent(found["word"].to_pylist(), found["c"].to_numpy(), found["ids"].to_pylist())
    name = encoder(tokenizer).tokenizer.id_to_token
    begins = np.array([(name(i) or "")[:1] in ("Ġ", "▁") for i in range(vocabulary)] + [True])  # Ġ and ▁ stand for a blank
    pieces = subword_counts(counts, tokenizer, begins)
    seen = pieces.filter("kind = 0").select("key", "n").toArrow()  # at most one row per subword of the tokenizer
    total_of = np.zeros(vocabulary)
    total_of[seen["key"].to_numpy()] = seen["n"].to_numpy()
    begun = pieces.filter("kind = 1").select("key", "n", "ended")
    table = commonest(begun, "n", BEGINNINGS)
    rows_of = _rows(table) if table is not None else NO_ROWS
    whole = begun.count() == len(rows_of)  # the table holds every beginning, so no task asks for one
    place, rays = commonest_places(total_of)
    shipped = spark.sparkContext.broadcast((Table(rows_of, begins), frequent, place, rays))
    total = n + v + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, frequent, column, rays = shipped.value
        logs = np.log10((frequent.counts + 1) / total)
        row = TaskContext.get().partitionId() << 33
        end_base = np.log10(((n_docs or 0) + 1) / total)
        for batch in _slices(batches):
            texts, doc_ids = utf8(batch.column(1)), batch.column(0).to_pylist()
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) < BATCH_BYTES):
                    size += len(texts[to])
                    to += 1
                words = [words_of(t) for t in texts[at:to]]
                place, sizes, flat = frequent.encode(list(chain.from_iterable(words)), tokenizer)
                ends = np.cumsum([len(x) for x in words])
                ids = np.split(flat.astype(np.int64), np.append(0, np.cumsum(sizes))[ends[:-1]])
                later = None if whole else table.unknown_of(ids)
                tokens, known, base, rest, times = [], [], [], [], []
                for here, spot in zip(words, np.split(place, ends[:-1])):
                    have = spot >= 0
                    others = Counter(compress(here, (~have).tolist()))
                    tokens.append(len(here) + 1)
                    known.append(int(have.sum()) + (n_docs > 0))
                    base.append(float(logs[spot[have]].sum() + end_base))
                    rest.append(list(others.keys()))
                    times.append(list(others.values()))
                yield pa.RecordBatch.from_pydict({
                    "row": pa.array(np.arange(row, row + to - at)), "doc_id": pa.array(doc_ids[at:to], pa.int64()),
                    "n_tokens": pa.array(tokens, pa.int64()), "known": pa.array(known, pa.int64()), "base": pa.array(base, pa.float64()),
                    "rest": pa.array(rest, pa.list_(pa.string())), "times": pa.array(times, pa.list_(pa.int64())),
                    "ids": pa.array(list(map(_packed, ids)), pa.binary()),
                    "sketch": pa.array([x.tobytes() for x in sketch(ids, column, rays).astype("<f4")], pa.binary()),
                    "keys": pa.array(later, pa.list_(pa.int64())) if not whole else pa.nulls(len(ids), pa.list_(pa.int64())),
                })
                row, at = row + to - at, to

    schema = "row long, doc_id long, n_tokens long, known long, base double, rest array<string>, times array<long>, ids binary, sketch binary, keys array<long>"
    rows = docs.mapInArrow(run, schema)
    rows = kept(rows) if whole else kept_by(rows, "row")
    shipped.destroy()
    fitted = rows.filter(~held_out())
    topic = np.append(_topics(fitted, vocabulary), TOPICS)
    model = Model(total_of, vocabulary, n_docs, [], begins, rows_of, n - n_docs, topic)
    _train(model, fitted, n_docs + total_of.sum() / STRIDE)
    ready = rows.withColumn("rare", F.lit(None).cast("binary")) if whole else _with_rare(rows, begun)
    _tune(model, ready.filter(~held_out()))
    scored = _scored(ready, model)
    apart = rows.select("row", F.explode(F.arrays_zip("rest", "times")).alias("w")).select("row", F.col("w.rest").alias("word"), F.col("w.times").alias("k"))
    joined = apart.join(counts.withColumnRenamed("c", "seen"), "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("seen") > 0, F.col("k")).otherwise(0)).alias("more"),
        F.sum(F.col("k") * F.log10((F.coalesce("seen", F.lit(0)) + 1) / F.lit(float(total)))).alias("more_base"))
    return scored.select("row", "doc_id", "n_tokens", "known", "base", "score").join(joined, "row", "left").select(
        "doc_id", held_out().alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), "score")
