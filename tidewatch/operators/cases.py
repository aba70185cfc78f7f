"""Many trainings at once: one classifier for each case of a resampling, from one count of terms and shared passes.

A case trains on the rows outside its fold whose step is at most its own (``fold`` -1 leaves nothing out). Texts are split
into terms twice for all cases together, once to count and once to number; the vocabulary of each case comes from the
numbers, and every pass over the numbered rows gives the loss and its slope of all cases that are still open.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator, Sequence
from functools import cached_property
from math import ceil, sqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..functions.text import accent_map
from ..session import settle, shuffle_width, stored
from .features import MAX_FEATURES, MAX_TERMS, TermArrays, count_terms

BLOCK_ROWS = 512
FEW_PARTS = 32  # partial sums that go to the driver as they are; more are added up in tasks first
PART_CHARS = 16_000_000  # characters of text whose terms one task adds up
MARGIN = 0.8  # of the count that is expected of the last term of a vocabulary
MAX_CANDIDATES = 400_000  # terms that are counted case by case
RANGE = 1 << 14  # terms whose counts are added up at once
MOST_TURNS = 200  # of conjugate gradients in one step
PARTS = ("train", "validation")
BLOCK = ("fold", "step", "size", "term", "tf", "label", "length", "scale")  # columns of a block
BLOCK_SCHEMA = ", ".join(f"{c} {'int' if c in BLOCK[:2] else 'binary'}" for c in BLOCK)
LOGS = np.append(0.0, np.log(np.arange(1, 1 << 12)) + 1.0)  # one plus the logarithm of small counts


class Case(NamedTuple):
    fold: int
    step: int = 0

    def condition(self):
        return (F.col("fold") != self.fold) & (F.col("step") <= self.step)


def case_vocabularies(
    docs: DataFrame, doc: str, clean: str, cases: Sequence[Case], min_df: int = 2, max_features: int = MAX_FEATURES
) -> DataFrame:
    """``(case, term, df, cf)``: what :func:`build_vocabulary` gives for the training rows of each case, by its position in
    ``cases``, from one table of counts by term, fold and step. ``docs`` holds ``fold`` and ``step`` (no nulls)."""
    counts = count_terms(docs, clean, ["fold", "step"]).repartition(_parts(docs, clean)[0], "term")
    within = lambda case, c: F.coalesce(F.sum(F.when(case.condition(), F.col(c))), F.lit(0))
    sums = [within(case, c).alias(f"{c}_{i}") for i, case in enumerate(cases) for c in ("df", "cf")]
    sums = settle(counts.groupBy("term").agg(*sums).filter(F.greatest(F.lit(0), *[f"df_{i}" for i in range(len(cases))]) >= min_df))
    picked = None
    for i in range(len(cases)):
        one = sums.select(F.lit(i).alias("case"), "term", F.col(f"df_{i}").alias("df"), F.col(f"cf_{i}").alias("cf"))
        one = one.filter(F.col("df") >= min_df).orderBy(F.desc("cf"), "term").limit(max_features)
        picked = one if picked is None else picked.union(one)
    return picked


def _parts(docs: DataFrame, clean: str) -> tuple[int, int]:
    """Parts by the size of the texts, so that what one task adds up does not grow with the input; and the rows."""
    size, rows = docs.agg(F.coalesce(F.sum(F.length(clean)), F.lit(0)), F.count(F.lit(1))).first()
    return max(shuffle_width(docs.sparkSession), ceil(size / PART_CHARS)), rows


class Vocabulary(NamedTuple):
    """The terms of all cases and their idf by case, 0 where a case does not have the term."""

    terms: list[str]
    idf: np.ndarray

    @classmethod
    def of(cls, picked: DataFrame, sizes: Sequence[int], max_terms: int = MAX_TERMS) -> Vocabulary:
        """``sizes``: training rows of each case."""
        rows = picked.select("case", "term", "df").limit(max_terms + 1).toArrow()
        if rows.num_rows > max_terms:
            raise ValueError(f"the vocabularies have more than {max_terms} terms; cut them or raise max_terms")
        coded = rows.column("term").combine_chunks().dictionary_encode()
        terms, at = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        case, df = rows.column("case").to_numpy(), rows.column("df").to_numpy()
        idf = np.zeros((len(sizes), len(terms)))
        idf[case, at] = np.log((np.asarray(sizes)[case] + 1.0) / (df + 1.0)) + 1.0
        return cls(terms, idf)


def number_terms(docs: DataFrame, clean: str, label: str, terms: Sequence[str], idf: np.ndarray | None = None) -> DataFrame:
    """The rows of ``docs`` as blocks of numbered terms, written. A block holds at most :data:`BLOCK_ROWS` rows of one fold
    and step, with what scales every row to length 1 under the ``idf`` of each case, if it is given, so that no pass works it
    out again; rows without a label are left out."""
    known = TermArrays({term: (1.0, 0.0) for term in terms}, accent_map())
    shared = docs.sparkSession.sparkContext.broadcast((known, np.zeros((0, len(terms))) if idf is None else idf))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, idfs = shared.value
        for batch in batches:
            fold, step = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3))
            order = np.lexsort((step, fold))
            ends = np.flatnonzero(np.diff(fold[order]) | np.diff(step[order])) + 1
            for rows in np.split(order, ends):
                for start in range(0, len(rows), BLOCK_ROWS):
                    part = batch.take(pa.array(rows[start : start + BLOCK_ROWS]))
                    row, term, tf = known.counted(part.column(0).to_pylist())
                    size = np.bincount(row, minlength=part.num_rows)
                    label_ = part.column(1).to_numpy(zero_copy_only=False)
                    yield _block(fold[rows[0]], step[rows[0]], size, term, tf, label_, idfs)

    narrow = docs.filter(F.col(label).isNotNull()).select(clean, *[F.col(c).cast("int") for c in (label, "fold", "step")])
    return settle(narrow.mapInArrow(number, BLOCK_SCHEMA))


def cut_blocks(blocks: DataFrame, kept: np.ndarray, idf: np.ndarray) -> DataFrame:
    """``blocks`` with the terms at ``kept`` only, which are numbered anew in that order, and scaled by ``idf``; written."""
    at = np.full(kept.max(initial=-1) + 1, -1)
    at[kept] = np.arange(len(kept))
    shared = blocks.sparkSession.sparkContext.broadcast((at, idf))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, idfs = shared.value
        for b in blocks_of(batches):
            known = b.term < len(at)
            known[known] = at[b.term[known]] >= 0
            size = np.bincount(np.repeat(np.arange(b.n), b.size)[known], minlength=b.n)
            term, tf = at[b.term[known]], b.tf[known]
            yield _block(b.fold, b.step, size, term, tf, b.label, idfs)

    return settle(blocks.mapInArrow(cut, BLOCK_SCHEMA))


def frequent_terms(
    docs: DataFrame, clean: str, smallest: int, min_df: int = 2, max_features: int = MAX_FEATURES
) -> tuple[list[str], int] | None:
    """The terms that occur ``least`` times or more in all ``docs``, and ``least``, which is what the last term of a vocabulary
    is likely to reach in a set of ``smallest`` rows; none where they are too many."""
    parts, rows = _parts(docs, clean)
    counts = count_terms(docs, clean).repartition(parts, "term").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    counts = stored(counts.filter(F.col("df") >= min_df).select("term", "cf"))
    n, last = counts.orderBy(F.desc("cf")).limit(max_features).agg(F.count(F.lit(1)), F.min("cf")).first()
    least = max(min_df, int(MARGIN * last * smallest / rows)) if n == max_features else min_df
    found = counts.filter(F.col("cf") >= least).select("term").limit(MAX_CANDIDATES + 1).toArrow()
    return None if found.num_rows > MAX_CANDIDATES else (sorted(found.column(0).to_pylist()), least)


def case_counts(blocks: DataFrame, cases: Sequence[Case], n_terms: int) -> tuple[np.ndarray, np.ndarray]:
    """Training rows of each case that hold a term, and how often they do. What goes to the driver are numbers by cases times
    terms, whatever the rows and tasks."""
    blocks = blocks.coalesce(max(1, blocks.sparkSession.sparkContext.defaultParallelism))
    all_cases, starts = list(cases), range(0, n_terms, RANGE)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[int, int], np.ndarray] = {}
        for b in blocks_of(batches):
            held = groups.setdefault((b.fold, b.step), np.zeros((2, n_terms), np.int64))
            held[0] += np.bincount(b.term, minlength=n_terms)
            held[1] += np.bincount(b.term, b.tf, n_terms).astype(np.int64)  # whole numbers far below 2**53
        total = np.zeros((len(all_cases), 2, n_terms), np.int64)
        for (fold, step), held in groups.items():
            for i, case in enumerate(all_cases):
                if fold != case.fold and step <= case.step:
                    total[i] += held
        for start in starts if groups else ():
            cell = total[:, :, start : start + RANGE].tobytes()
            yield pa.record_batch([pa.array([start], pa.int32()), pa.array([cell], pa.binary())], names=["start", "total"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(cell.as_py(), np.int64) for cell in table.column("total"))
        return pa.table({"start": table.column("start").slice(0, 1), "total": pa.array([total.tobytes()], pa.binary())})

    schema, out = "start int, total binary", np.zeros((len(all_cases), 2, n_terms), np.int64)
    for start, cell in zip(*blocks.mapInArrow(count, schema).groupBy("start").applyInArrow(add, schema).toArrow().columns):
        at = out[:, :, start.as_py() : start.as_py() + RANGE]
        at[:] = np.frombuffer(cell.as_py(), np.int64).reshape(at.shape)
    return out[:, 0], out[:, 1]


def blocks_of_cases(
    docs: DataFrame, doc: str, clean: str, label: str, cases: Sequence[Case], sizes: np.ndarray, min_df: int = 2,
    max_features: int = MAX_FEATURES,
) -> tuple[DataFrame, np.ndarray]:
    """The numbered rows of ``docs``, which all have labels, and the idf by case of their terms: the vocabularies of
    :func:`case_vocabularies`, found without counting every term by fold and step.

    Terms are counted in all rows together first. Those frequent enough are numbered, and the counts of each case are added up
    from the numbers. A term that was left out occurs less than ``least`` times in any case, so where the last term picked for
    each case reaches ``least``, nothing is missing; else all terms are counted by fold and step."""
    trained = np.flatnonzero(sizes.min(axis=1) > 0)
    rows = sizes.sum(axis=1)
    frequent = frequent_terms(docs, clean, rows[trained].min(initial=rows.max(initial=0)), min_df, max_features)
    if frequent is not None:
        terms, least = frequent
        blocks = number_terms(docs, clean, label, terms)
        df, cf = case_counts(blocks, cases, len(terms))
        idf, whole = np.zeros(df.shape), True
        for i in trained:
            held = np.flatnonzero(df[i] >= min_df)
            picked = held[np.argsort(-cf[i, held], kind="stable")][:max_features]  # equal counts in the order of the terms
            whole &= least <= min_df or (len(picked) == max_features and cf[i, picked[-1]] >= least)
            idf[i, picked] = np.log((rows[i] + 1.0) / (df[i, picked] + 1.0)) + 1.0
        if whole:
            kept = np.flatnonzero(idf.any(axis=0))
            return cut_blocks(blocks, kept, idf[:, kept]), idf[:, kept]
    docs = stored(docs)
    vocabulary = Vocabulary.of(case_vocabularies(docs, doc, clean, cases, min_df, max_features), rows)
    return number_terms(docs, clean, label, vocabulary.terms, vocabulary.idf), vocabulary.idf


def _block(fold: int, step: int, size: np.ndarray, term: np.ndarray, tf: np.ndarray, label: np.ndarray, idfs: np.ndarray) -> pa.RecordBatch:
    w = weights_of(tf)
    numbers = [lengths(size, w), scales(size, term, w, idfs)]
    cells = [size.astype("<i4").tobytes(), _packed(term), _packed(tf), label.astype("<i4").tobytes(), *[x.astype("<f8").tobytes() for x in numbers]]
    return pa.record_batch([*[pa.array([g], pa.int32()) for g in (fold, step)], *[pa.array([x], pa.binary()) for x in cells]], names=BLOCK)


def _packed(x: np.ndarray) -> bytes:
    """Numbers from 0 in as few bytes each as hold them all."""
    most = x.max(initial=0)
    return x.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}") if n else np.zeros(0, np.uint8)


def weights_of(tf: np.ndarray) -> np.ndarray:
    """One plus the logarithm of counts."""
    return np.take(LOGS, tf) if tf.max(initial=0) < len(LOGS) else np.log(tf.astype(np.float64)) + 1.0


def lengths(size: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.sqrt(_by_row(size, np.square(w)))


def scales(size: np.ndarray, term: np.ndarray, w: np.ndarray, idfs: np.ndarray) -> np.ndarray:
    """What scales each row, taken at length 1, to length 1 under each idf; 0 for a row that has no weight there."""
    under = np.array([lengths(size, w * idf[term]) for idf in idfs]).reshape(len(idfs), len(size))
    return _ratio(lengths(size, w), under)


def _ratio(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, y = np.broadcast_arrays(x, y)
    return np.divide(x, y, out=np.zeros(x.shape), where=y > 0)


def _by_row(size: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sums of ``x`` over rows of so many entries each."""
    filled = np.flatnonzero(size)  # reduceat has no empty sums
    out = np.zeros(len(size), x.dtype)
    if len(filled):
        out[filled] = np.add.reduceat(x, (np.cumsum(size) - size)[filled])
    return out


class Block:
    """A block as arrays: entries (term, count, weight) by row and the entries of each row, the labels of its rows, and by case
    what scales a row of length 1 to length 1 under the idf, and a row as it is (``rate``). Numbers are in the types that numpy
    gathers and adds without converting them."""

    def __init__(self, fold: int, step: int, cells: Sequence[bytes], idfs: np.ndarray | None = None):
        self.fold, self.step = fold, step
        self.size = np.frombuffer(cells[0], "<i4").astype(np.int64)
        entries = int(self.size.sum())
        self.term, self.tf = _unpacked(cells[1], entries).astype(np.int64), _unpacked(cells[2], entries)
        self.w = weights_of(self.tf)
        self.label = np.frombuffer(cells[3], "<i4")
        self.n = len(self.label)
        given = cells[5] or idfs is None
        self.scale = np.frombuffer(cells[5], "<f8").reshape(-1, self.n) if given else scales(self.size, self.term, self.w, idfs)
        self.rate = _ratio(self.scale, np.frombuffer(cells[4], "<f8"))

    @cached_property
    def w_pair(self) -> np.ndarray:
        return self.w.astype(np.complex128)

    def trains(self, case: Case) -> bool:
        return self.fold != case.fold and self.step <= case.step

    def scores(self, i: int, weights: np.ndarray) -> np.ndarray:
        """Scores of case ``i`` without the intercept; ``weights`` are those of the terms times their idf, or complex numbers
        of two such sets, whose scores come at once."""
        entries = np.take(weights, self.term)
        entries *= self.w_pair if np.iscomplexobj(weights) else self.w
        return _by_row(self.size, entries) * self.rate[i]

    def pulled(self, i: int, pull: np.ndarray, size: int) -> np.ndarray:
        """Sum of the rows times ``pull``, before the idf of case ``i``."""
        entries = np.repeat(pull * self.rate[i], self.size)
        entries *= self.w
        return np.bincount(self.term, entries, size)


def blocks_of(batches: Iterator[pa.RecordBatch], idfs: np.ndarray | None = None) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            fold, step, *cells = (column[i].as_py() for column in batch.columns)
            yield Block(fold, step, cells, idfs)


def _added(parts: DataFrame, n_parts: int, shape: tuple) -> np.ndarray:
    """The sum of arrays of one shape, one from each partition."""
    if n_parts > FEW_PARTS:
        lanes = ceil(sqrt(n_parts))

        def add(table: pa.Table) -> pa.Table:
            total = np.zeros(shape)
            for cell in table.column("total"):
                total += np.frombuffer(cell.as_py()).reshape(shape)
            return pa.table({"part": table.column("part").slice(0, 1), "total": pa.array([total.tobytes()], pa.binary())})

        by_lane = parts.withColumn("part", F.col("part") % lanes).groupBy("part")
        parts = by_lane.applyInArrow(add, "part int, total binary")
    total = np.zeros(shape)
    for cell in parts.select("total").toArrow().column(0):
        total += np.frombuffer(cell.as_py()).reshape(shape)
    return total


def minimum(size: int, tol: float, max_iter: int) -> Generator[tuple, tuple | np.ndarray, np.ndarray]:
    """The minimum of one convex function whose value and slope others compute, by Newton steps: each is solved by conjugate
    gradients, as far as the slope is worth, and halved until the value falls. Asks ``(point, None)`` for value and slope at
    ``point``, and ``(point, way)`` for the curvature there times ``way``; stops after ``max_iter`` questions."""
    at, left = np.zeros(size), max_iter - 1
    value, slope = yield at, None
    start = np.abs(slope).max()
    while np.abs(slope).max() > tol * start and left > 0:
        step, rest = np.zeros(size), -slope
        way, square = rest, rest @ rest
        enough = min(0.1, sqrt(np.abs(slope).max() / start)) ** 2 * square
        for _ in range(MOST_TURNS):
            if square <= enough or left <= 0:
                break
            bent = yield at, way
            left -= 1
            along = square / (way @ bent)
            step, rest = step + along * way, rest - along * bent
            way, square = rest + (rest @ rest / square) * way, rest @ rest
        length = 1.0
        while length > 1e-10 and left > 0:
            trial = at + length * step
            new, new_slope = yield trial, None
            left -= 1
            if new <= value + 1e-4 * length * (slope @ step):
                at, value, slope = trial, new, new_slope
                break
            length /= 2  # too far
        else:
            break
    return at


def fit_cases(
    blocks: DataFrame, cases: Sequence[Case], idf: np.ndarray, balance: np.ndarray, C: float = 1.0, tol: float = 1e-3,
    max_iter: int = 2000,
) -> np.ndarray:
    """Weights of each case, the intercept last: least sum of squares of the weights, halved, plus ``C`` times the squared
    hinge loss of its training rows. ``balance`` holds the factors of labels 0 and 1 by case; a case where one is 0 has
    one class only, is not trained and keeps zeros.

    Every pass answers what the searches of the open cases ask: their weights go to the tasks, and one slope a task comes
    back, added up in tasks where there are many: numbers by cases times terms, whatever the rows.
    """
    spark = blocks.sparkSession
    # A task returns one sum, however many blocks it reads; more tasks than cores would only return more sums.
    blocks = blocks.coalesce(max(1, spark.sparkContext.defaultParallelism))
    n_parts = blocks.rdd.getNumPartitions()
    size = idf.shape[1] + 1
    models = np.zeros((len(cases), size))
    fixed = spark.sparkContext.broadcast((list(cases), idf, balance))
    searches = {i: minimum(size, tol, max_iter) for i in range(len(cases)) if balance[i].min() > 0}
    asked = {i: next(search) for i, search in searches.items()}
    while asked:
        moving = spark.sparkContext.broadcast(asked)

        def slopes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            all_cases, idfs, factors = fixed.value
            # Two sets of weights are real and imaginary parts of one, so that the entries of a block are passed over once.
            pairs = {i: point if way is None else point + 1j * way for i, (point, way) in moving.value.items()}
            open_ = {i: (x[:-1] * idfs[i], x[-1]) for i, x in pairs.items()}
            n = idfs.shape[1]
            total = np.zeros((len(open_), n + 2))  # by term, of the intercept, of the loss
            for b in blocks_of(batches, idfs):
                y = 2.0 * b.label - 1.0
                for k, (i, (weights, intercept)) in enumerate(open_.items()):
                    if not b.trains(all_cases[i]):
                        continue
                    scores = b.scores(i, weights) + intercept
                    slack = np.maximum(0.0, 1.0 - y * scores.real)
                    factor = factors[i][b.label]
                    if np.iscomplexobj(scores):
                        pull = 2.0 * factor * (slack > 0) * scores.imag
                    else:
                        pull = -2.0 * factor * slack * y
                        total[k, -1] += factor @ np.square(slack)
                    total[k, :-2] += b.pulled(i, pull, n)
                    total[k, -2] += pull.sum()
            total[:, :-2] *= idfs[list(open_)]
            names = ["part", "total"]
            part = pa.array([TaskContext.get().partitionId()], pa.int32())
            yield pa.record_batch([part, pa.array([total.tobytes()], pa.binary())], names=names)

        found = _added(blocks.mapInArrow(slopes, "part int, total binary"), n_parts, (len(asked), size + 1))
        moving.unpersist()
        questions, asked = asked, {}
        for (i, (point, way)), total in zip(questions.items(), found):
            if way is None:
                answer = 0.5 * (point @ point) + C * total[-1], point + C * total[:-1]
            else:
                answer = way + C * total[:-1]
            try:
                asked[i] = searches[i].send(answer)
            except StopIteration as end:
                models[i] = end.value
    return models


def judge_cases(blocks: DataFrame, cases: Sequence[Case], idf: np.ndarray, models: np.ndarray) -> DataFrame:
    """``(case, part, tp, tn, fp, fn)`` on the training rows and on the fold that was left out, all in one pass."""
    shared = blocks.sparkSession.sparkContext.broadcast((list(cases), idf, models[:, :-1] * idf, models[:, -1]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_cases, idfs, weights, intercepts = shared.value
        cells = np.zeros((len(all_cases), 2, 4), np.int64)
        for b in blocks_of(batches, idfs):
            for i, case in enumerate(all_cases):
                own = b.fold == case.fold
                if own or b.trains(case):
                    right = b.scores(i, weights[i]) + intercepts[i] > 0
                    kind = np.where(right, np.where(b.label == 1, 0, 2), np.where(b.label == 1, 3, 1))
                    cells[i, int(own)] += np.bincount(kind, minlength=4)
        i, part = np.nonzero(cells.sum(axis=2))
        columns = [pa.array(i.astype(np.int32)), pa.array([PARTS[p] for p in part], pa.string())]
        columns += [pa.array(cells[i, part, c]) for c in range(4)]
        yield pa.record_batch(columns, names=["case", "part", "tp", "tn", "fp", "fn"])

    counted = blocks.mapInArrow(count, "case int, part string, tp long, tn long, fp long, fn long")
    return counted.groupBy("case", "part").agg(*[F.sum(c).alias(c) for c in ("tp", "tn", "fp", "fn")])


def case_sizes(docs: DataFrame, label: str, cases: Sequence[Case]) -> np.ndarray:
    """Training rows of each case by label 0 and 1."""
    counts = docs.agg(*[
        F.count_if(case.condition() & (F.col(label) == y)).alias(f"n_{i}_{y}") for i, case in enumerate(cases) for y in (0, 1)
    ]).first()
    return np.array(counts, np.int64).reshape(len(cases), 2)


def balance_of(sizes: np.ndarray) -> np.ndarray:
    """Factors that give both labels the same total; 0 for all where a label is missing."""
    both = sizes.min(axis=1, keepdims=True) > 0
    return np.where(both, sizes.sum(axis=1, keepdims=True) / (2.0 * np.maximum(sizes, 1)), 0.0)


def resample(docs: DataFrame, doc: str, clean: str, label: str, cases: Sequence[Case], **options) -> DataFrame:
    """Train every case and count its hits, see :func:`judge_cases`; ``docs`` holds ``fold`` and ``step``, and its texts are read
    twice at most, so it need not be written. Cases with one class have no rows."""
    sizes = case_sizes(docs, label, cases)
    balance = balance_of(sizes)
    blocks, idf = blocks_of_cases(docs.filter(F.col(label).isNotNull()), doc, clean, label, cases, sizes)
    models = fit_cases(blocks, cases, idf, balance, **options)
    trained = [i for i in range(len(cases)) if balance[i].min() > 0]
    return judge_cases(blocks, cases, idf, models).filter(F.col("case").isin(trained))
