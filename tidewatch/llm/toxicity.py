"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text, compared window by window."""

from __future__ import annotations

import sys
import types
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame, functions as F

from .common import LOWER, utf8

# The sample that the model is fitted on; scoring and everything else covers all rows and whole texts.
MAX_TOXIC, MAX_ORDINARY, MAX_FIT_BYTES = 1500, 5000, 30_000
BASE_BYTES, TOXIC_BYTES, ORDINARY_BYTES = 32_768, 8_192, 32_768
ROUNDS, LEVEL = 4, 19
STEPS = (1, 2, 3, 4, 5, 6, 8)  # bytes by which the toxic dictionary must be ahead
CACHE_WINDOWS = 400_000
FIT_THREADS = 4  # of the driver
PIECE = 32  # bytes of a window at most, without its blanks
STRETCH, SHARE = 256, 2000  # windows of a stretch; shares above 1 / SHARE are told apart by their logarithm
SEGMENT, DMER = 32, 6  # bytes a trained dictionary is put together from, and those it counts: short words must fill one
HEADER = 256  # about what the entropy tables take at the start of a trained dictionary; the rest is content
ENDS = b".,;:!?\"'()[]*"


def windows(data: bytes) -> list[bytes]:
    """One window for each word, without case and without punctuation at its ends. Words of more than ``PIECE`` bytes,
    as in text without blanks, give overlapping pieces of that size instead."""
    found = [b" " + w + b" " for x in data.translate(LOWER).split() if (w := x.strip(ENDS))]
    if all(len(w) <= PIECE + 2 for w in found):
        return found
    out = []
    for w in found:
        out += [w] if len(w) <= PIECE + 2 else [b" " + w[at : at + PIECE].strip() + b" " for at in range(1, len(w) - 1 - PIECE // 2, PIECE // 2)]
    return out


def _trained(size: int, counts: Counter) -> bytes:
    """Content of a zstandard dictionary trained on the windows, in samples of twenty."""
    every = [w for w, n in sorted(counts.items()) for _ in range(min(n, 200))]
    order = np.random.default_rng(7).permutation(len(every)).tolist()
    samples = [b"".join(every[k] for k in order[at : at + 20]) for at in range(0, len(order), 20)]
    if len(samples) < 50:
        return b"".join(sorted(counts))[-size:]
    try:
        found = zs.train_dictionary(size, samples[:100_000], k=SEGMENT, d=DMER).as_bytes()
    except zs.ZstdError:  # too few or too equal samples
        return b"".join(sorted(counts))[-size:]
    return found[HEADER:]


class Compressor:
    """Bytes that windows take behind a constant lead with a dictionary of special content before a common base.

    Both dictionaries end in the same base, so ordinary text costs the same with either; only what stands in one
    special part makes a difference. Contents are used as they are, without entropy tables.
    """

    def __init__(self, special: bytes, base: bytes, threads: int = 1):
        content, self.threads = special + base, threads
        self.lead = base[-24:]
        parameters = zs.ZstdCompressionParameters.from_level(
            LEVEL, source_size=64, dict_size=len(content), write_content_size=False, write_checksum=False,
            write_dict_id=False, window_log=18)
        dictionary = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(compression_params=parameters)
        self.packer = zs.ZstdCompressor(dict_data=dictionary, compression_params=parameters)

    def lengths(self, found: list[bytes]) -> np.ndarray:
        out = []
        for at in range(0, len(found), 5000):
            packed = self.packer.multi_compress_to_buffer([self.lead + w for w in found[at : at + 5000]], threads=self.threads)
            out += [len(packed[k]) for k in range(len(packed))]
        return np.array(out, np.int64)


def margins(ordinary: Compressor, toxic: Compressor, found: list[bytes]) -> np.ndarray:
    return ordinary.lengths(found) - toxic.lengths(found)


def _features(ahead: np.ndarray) -> np.ndarray:
    """Of one document from the margins of its windows in order, for each step: the share of windows ahead in the whole
    text, in the best of its stretches of about ``STRETCH`` windows, and the share of stretches with any. A text that
    goes on in the same way for longer keeps its features. Only below one stretch does the length count: shares are of a
    whole stretch then, and the last feature says how much of it there is."""
    n = len(ahead)
    if not n:
        return np.zeros(3 * len(STEPS) + 1)
    k = max(1, round(n / STRETCH))
    starts = np.arange(k) * n // k
    size = np.maximum(np.diff(np.append(starts, n)), STRETCH if k == 1 else 1)[:, None]
    hits = np.add.reduceat((ahead[:, None] >= np.array(STEPS)).astype(np.int32), starts, axis=0)
    shares = hits.sum(axis=0) / max(n, STRETCH), (hits / size).max(axis=0)
    return np.concatenate((*(np.log1p(SHARE * s) for s in shares), (hits > 0).mean(axis=0), [np.log1p(min(n, STRETCH))]))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights with the constant last, by iterated least squares."""
    x = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """Two dictionaries over one base, and the calibration of the margins."""

    def __init__(self, base: bytes, toxic: bytes, ordinary: bytes, scale: tuple, weights: np.ndarray, prior: float):
        self.parts, self.scale, self.weights, self.prior = (base, toxic, ordinary), scale, weights, prior
        self.key = hash((base, toxic, ordinary))

    def scores(self, docs: list[bytes]) -> np.ndarray:
        held = sys.modules.setdefault("tidewatch_worker", types.ModuleType("tidewatch_worker")).__dict__
        if held.get("toxicity", (None,))[0] != self.key:  # compressors and margins of windows live on between tasks
            base, toxic, ordinary = self.parts
            held["toxicity"] = (self.key, Compressor(ordinary, base), Compressor(toxic, base), {})
        _, plain, bad, known = held["toxicity"]
        found = [windows(d) for d in docs]
        new = list(set().union(*found).difference(known))
        if len(known) + len(new) > CACHE_WINDOWS:
            known.clear()
            new = list(set().union(*found))
        known.update(zip(new, margins(plain, bad, new).tolist()))
        if self.weights is None:
            return np.full(len(docs), self.prior)
        x = np.array([_features(np.fromiter(map(known.__getitem__, ws), np.int64, len(ws))) for ws in found]).reshape(len(docs), -1)
        x = np.clip((x - self.scale[0]) / self.scale[1], -4, 4)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def fit(texts: list[bytes], labels: list[int]) -> Model:
    """Fit on labelled texts. With one class only, the score is the share of toxic texts throughout.

    The toxic dictionary is trained in rounds: windows of one half of the toxic texts that the other half's
    dictionary compresses clearly better than the ordinary one are what the next is trained on. So it keeps what
    recurs in toxic texts, not what a single text says. After each round the ordinary dictionary is trained on those
    windows of ordinary texts that the toxic one does better. The calibration is fitted on the margins by a
    logistic regression.
    """
    same: dict[bytes, bytes] = {}  # one object for each window, whatever the number of texts that have it
    counts, places, number = [], [], {}
    for t in texts:
        found = windows(t)
        counts.append(Counter(same.setdefault(w, w) for w in found))
        places.append(np.array([number.setdefault(same[w], len(number)) for w in found], np.int32))
    del same, texts
    bad, good = ([c for c, l in zip(counts, labels) if l == k] for k in (1, 0))
    prior = len(bad) / max(1, len(bad) + len(good))
    half = good[0::2], good[1::2]
    base = _trained(BASE_BYTES, sum_counts(half[0])) or b" "
    if not bad or not good:
        return Model(base, b"", b"", (0, 1), None, prior)
    ordinary = _trained(ORDINARY_BYTES, sum_counts(half[1]))
    parts = [sum_counts(bad[0::2]), sum_counts(bad[1::2])]
    samples, every_good = parts, sum_counts(good)
    good_words = list(every_good)
    toxic, size = b"", 4 * TOXIC_BYTES
    for _ in range(ROUNDS):
        plain = Compressor(ordinary, base, FIT_THREADS)
        chosen = []
        for k in (0, 1):
            other, words = Compressor(_trained(size, samples[1 - k]), base, FIT_THREADS), list(parts[k])
            ahead = margins(plain, other, words) >= 3
            chosen.append(Counter({w: parts[k][w] for w, a in zip(words, ahead.tolist()) if a}))
        if not any(chosen):
            break
        samples, size = [c or s for c, s in zip(chosen, samples)], TOXIC_BYTES
        toxic = _trained(size, samples[0] + samples[1])
        ahead = margins(plain, Compressor(toxic, base, FIT_THREADS), good_words) >= 2
        hard = Counter({w: every_good[w] for w, a in zip(good_words, ahead.tolist()) if a})
        ordinary = (_trained(ORDINARY_BYTES // 2, hard) + ordinary[-ORDINARY_BYTES // 2 :]) if hard else ordinary
    known = margins(Compressor(ordinary, base, FIT_THREADS), Compressor(toxic, base, FIT_THREADS), list(number))
    x = np.array([_features(known[p]) for p in places])
    scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    weights = _logistic(np.clip((x - scale[0]) / scale[1], -4, 4), np.array(labels, float))
    return Model(base, toxic, ordinary, scale, weights, prior)


def sum_counts(docs: list[Counter]) -> Counter:
    total: Counter = Counter()
    for d in docs:
        total.update(d)
    return total


def fit_on(docs: DataFrame, labels: DataFrame) -> Model:
    """:func:`fit` on a bounded sample of ``docs(doc_id, text)`` with ``labels(doc_id, toxic)`` 0 or 1.

    At most ``MAX_TOXIC`` and ``MAX_ORDINARY`` labelled documents of at most ``MAX_FIT_BYTES``, those with the smallest
    hashes of their ids; a document that is labelled both ways is toxic.
    """
    known = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    size = F.octet_length("text")
    parts = []
    for toxic, most in ((1, MAX_TOXIC), (0, MAX_ORDINARY)):
        order = (F.xxhash64("doc_id"), "doc_id")
        part = known.filter(F.col("toxic") == toxic).orderBy(*order).limit(2 * most)
        found = docs.select("doc_id", "text").filter(size.between(1, MAX_FIT_BYTES)).join(F.broadcast(part), "doc_id").dropDuplicates(["doc_id"])
        parts += found.orderBy(*order).limit(most).select("text", "toxic").collect()
    texts, toxic = [r["text"].encode() for r in parts], [r["toxic"] for r in parts]
    del parts
    return fit(texts, toxic)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` per row of ``docs(doc_id, text)``, from the whole text and nothing else. Null is an empty text."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(1))
            found = [shipped.value.scores(texts[at : at + 200]) for at in range(0, len(texts), 200)]
            scores = pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def held_out(key: str = "doc_id"):
    """A third of the ids, by check sum; labels are learned from the others only."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs``; without any label the score is 0."""
    model = fit_on(docs, labels.filter(~held_out()))
    scored = score_documents(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
