"""Text features, the linear score and the gate on it."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import accent_map, clean_text, let, term_counts, terms

MAX_FEATURES = 10_000
MAX_TERMS = 2_000_000  # what the dictionary of a task may hold, whatever a vocabulary was cut to
GATE = 0.3
TOKENS = re.compile(r"[^ \n]{2,}|\n").findall  # words of two letters and more, and the mark between texts
WORDS = re.compile(r"\w{2,}|\n").findall  # the same for texts that need not be cleaned
ODD = re.compile(r"[^\w\n]").search
MARK = " \n "  # between texts
COUNT_CHARS, COUNT_ROWS = 8_000_000, 100_000  # characters that terms are counted in at once; rows of a batch of counts


def document_terms(df: DataFrame, doc: str, clean: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Long table ``(doc, *keep, term, tf)``; counted inside each row, so no shuffle."""
    counted = df.select(doc, *keep, F.explode(term_counts(terms(clean))).alias("t"))
    return counted.select(doc, *keep, F.col("t.term").alias("term"), F.col("t.tf").alias("tf"))


def build_vocabulary(
    doc_terms: DataFrame, min_df: int = 2, max_features: int = MAX_FEATURES, extra: Sequence[Column] = ()
) -> DataFrame:
    """Terms in at least ``min_df`` documents, cut to the most frequent in the whole corpus.

    One pre-aggregated shuffle on the term, which can compute ``extra`` aggregates as well. The cut is what bounds every later broadcast of
    the vocabulary.
    """
    summed = doc_terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), *extra)
    return _most_frequent(summed, min_df, max_features)


def _most_frequent(summed: DataFrame, min_df: int, max_features: int) -> DataFrame:
    return summed.filter(F.col("df") >= min_df).orderBy(F.desc("cf"), "term").limit(max_features)


def top_vocabulary(
    counts: DataFrame, min_df: int = 2, max_features: int = MAX_FEATURES, extra: Sequence[Column] = ()
) -> DataFrame:
    """What :func:`build_vocabulary` gives, from the partial counts of :func:`count_terms`."""
    summed = counts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"), *extra)
    return _most_frequent(summed, min_df, max_features)


def count_terms(docs: DataFrame, clean: str = "text", by: Sequence[str] = ()) -> DataFrame:
    """``(*by, term, df, cf)``: documents that hold a term and how often, by the integer columns ``by`` (no nulls), in partial
    sums. The terms are those of :func:`document_terms`; here they are numbered and counted for about
    :data:`COUNT_CHARS` characters at once, so far fewer rows leave a task."""
    accents, n_by = accent_map(), len(by)
    names = [*by, "term", "df", "cf"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(1 + k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(n_by)]
            for start, stop, texts in text_parts(batch.column(0), COUNT_CHARS):
                yield from _partial_counts(texts, [k[start:stop] for k in keys], accents, names)

    kinds = ", ".join([*[f"`{c}` long" for c in by], "term string, df long, cf long"])
    return docs.select(clean, *[F.col(c).cast("long") for c in by]).mapInArrow(run, kinds)


def _partial_counts(texts: list, keys: list[np.ndarray], accents: dict[str, str], names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    order = np.lexsort(keys[::-1]) if keys else np.arange(len(texts))  # the documents of a group lie together
    whole = MARK.join([(texts[i] or "").replace("\n", " ") for i in order])
    if not whole.isascii():
        for accented in accents.keys() & set(whole):
            whole = whole.replace(accented, accents[accented])
    spoken, ids = distinct_words(whole)
    if any(map(ODD, spoken)):  # not cleaned
        spoken, ids = numbered_words(WORDS(whole))
    # The mark gets 0, words of two letters and more the numbers from 1; the others are no words.
    long = np.array([len(w) > 1 for w in spoken], bool)
    place = np.where(long, np.cumsum(long), -1)
    place[[k for k, w in enumerate(spoken) if w == "\n"]] = 0
    ids = np.take(place, ids)
    ids = ids[ids >= 0]
    words = pa.array(["\n", *compress(spoken, long)], pa.large_string())
    n = len(words)
    row = np.cumsum(ids == 0)
    group = np.zeros(len(order), np.int64)
    for key in keys:
        group[1:] |= np.diff(key[order]) != 0
    group = np.cumsum(group)
    first = np.append(0, np.flatnonzero(np.diff(group)) + 1)
    for size in (1, 2):
        if size == 1:
            at = np.flatnonzero(ids)
            code = ids[at]
        else:
            at = np.flatnonzero((ids[:-1] != 0) & (ids[1:] != 0))
            code = ids[at] * n + ids[at + 1]
        if not len(at):
            continue
        # Below (characters / 2)^2 times the documents of a part: far from 64 bits.
        cell, tf = np.unique(code * len(order) + row[at], return_counts=True)
        code, own = cell // len(order), group[cell % len(order)]
        begin = np.append(0, np.flatnonzero((np.diff(code) != 0) | (np.diff(own) != 0)) + 1)
        df, cf = np.diff(np.append(begin, len(cell))), np.add.reduceat(tf, begin)
        code, own = code[begin], own[begin]
        term = words.take(pa.array(code)) if size == 1 else pc.binary_join_element_wise(
            words.take(pa.array(code // n)), words.take(pa.array(code % n)), pa.scalar(" ", pa.large_string()))
        by = [pa.array(key[order][first][own]) for key in keys]
        found = pa.record_batch([*by, term, pa.array(df, pa.int64()), pa.array(cf, pa.int64())], names=list(names))
        for start in range(0, found.num_rows, COUNT_ROWS):
            part = found.slice(start, COUNT_ROWS)
            yield part.set_column(len(by), "term", part.column(len(by)).cast(pa.string()))


def distinct_words(whole: str) -> tuple[list[str], np.ndarray]:
    """The distinct strings between blanks, and the number of each in the order of the text."""
    coded = pc.split_pattern(pa.array([whole], pa.large_string()), " ").values.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy()


def numbered_words(tokens: list[str]) -> tuple[list[str], np.ndarray]:
    """As :func:`distinct_words`, of tokens that were found already."""
    numbers: dict[str, int] = {}
    ids = np.fromiter((numbers.setdefault(t, len(numbers)) for t in tokens), np.int64, len(tokens))
    return list(numbers), ids


def idf(vocab: DataFrame, n_docs) -> DataFrame:
    """Smoothed inverse document frequency. ``n_docs`` is a number or a column."""
    n_docs = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
    return vocab.withColumn("idf", F.log((n_docs + 1.0) / (F.col("df") + 1.0)) + 1.0)


def sublinear_tf(c) -> Column:
    return F.log(F.col(c) if isinstance(c, str) else c) + 1.0


def unit_terms(weighted: str | Column) -> Column:
    """An array of ``struct<term,w>`` with its weights scaled to length 1, inside its row."""
    weighted = F.col(weighted) if isinstance(weighted, str) else weighted
    square = lambda total, x: total + x["w"] * x["w"]
    norm = F.sqrt(F.aggregate(weighted, F.lit(0.0), square))
    return let(norm, lambda n: F.transform(weighted, lambda x: F.struct(x["term"].alias("term"), F.when(n > 0, x["w"] / n).otherwise(x["w"]).alias("w"))))


def l2_normalise(weights: DataFrame, doc: str, w: str) -> DataFrame:
    """Scale every document's weights to length 1, given in long form; :func:`unit_terms` does so without a shuffle where
    they still lie in one row.

    A document has at most one row per vocabulary term, so its window is bounded; the window
    needs one shuffle where a sum joined back would need three.
    """
    norm = F.sqrt(F.sum(F.col(w) * F.col(w)).over(Window.partitionBy(doc)))
    return weights.withColumn(w, F.when(norm > 0, F.col(w) / norm).otherwise(F.col(w)))


def term_values(vocab: DataFrame, columns: Sequence[str], max_terms: int = MAX_TERMS) -> dict[str, tuple]:
    """A vocabulary as a dictionary for the tasks. Its size is checked before it reaches the
    driver; the cut in :func:`build_vocabulary`, of any size up to the bound, keeps it below."""
    rows = vocab.select("term", *columns).limit(max_terms + 1).collect()
    if len(rows) > max_terms:
        raise ValueError(f"the vocabulary has more than {max_terms} terms; cut it or raise max_terms")
    return {r[0]: tuple(r)[1:] for r in rows}


def text_parts(texts: Sequence[str | None] | pa.Array, chars: int) -> Iterator[tuple[int, int, list[str | None]]]:
    """``(start, stop, texts)`` of neighbours with about ``chars`` characters; texts of Arrow become Python's part by part."""
    start, part, size = 0, [], 0
    for stop, text in enumerate(texts, 1):
        text = text.as_py() if isinstance(text, pa.Scalar) else text
        part.append(text)
        size += 1 + len(text or "")
        if size >= chars:
            yield start, stop, part
            start, part, size = stop, [], 0
    if part:
        yield start, start + len(part), part


class TermArrays:
    """A vocabulary of words and pairs of words as arrays, to weigh a whole batch of cleaned texts at once.

    A cleaned text consists of words and single blanks. Words get numbers by one dictionary; a pair of words is looked up
    by its two numbers in a sorted array; equal terms of a text are counted by sorting.
    """

    CHARS = 2_000_000  # texts are worked on in parts of about this size

    def __init__(self, known: dict[str, tuple], accents: dict[str, str]):
        """``known``: values by term, idf first."""
        self.accents, self.terms = accents, list(known)
        self.values = np.array(list(known.values()), dtype=np.float64) if known else np.zeros((0, 2))
        self.words: dict[str, int] = {}
        singles, pairs = [], []
        for k, term in enumerate(self.terms):
            ids = [self.words.setdefault(w, len(self.words)) for w in term.split(" ")]
            if len(ids) < 3:
                (singles if len(ids) == 1 else pairs).append((*ids, k))
        self.mark = self.words["\n"] = len(self.words)  # between texts; no word
        self.single = np.full(len(self.words), -1)
        self.single[[w for w, _ in singles]] = [k for _, k in singles]
        codes = np.array([a * len(self.words) + b for a, b, _ in pairs], np.int64)
        order = np.argsort(codes)
        self.codes, self.pair = codes[order], np.array([k for *_, k in pairs], np.int64)[order]

    def weigh(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(row, term, weight)`` of the known terms of ``texts``, by row; the weights of a row have length 1."""
        parts = [(row + start, term, w) for start, _, row, term, w in self.weigh_parts(texts)]
        none = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        return tuple(np.concatenate(x) for x in zip(*(parts or none)))

    def weigh_parts(self, texts: Sequence[str | None] | pa.Array) -> Iterator[tuple]:
        """``(start, stop, row, term, weight)`` of one part of ``texts`` after the other, rows counted from its start: what is
        held does not grow with the batch."""
        for start, stop, part in text_parts(texts, self.CHARS):
            yield start, stop, *self._weigh(part)

    def counted(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(row, term, count)`` of the known terms of ``texts``, by row and term."""
        parts = [(row + start, term, n) for start, _, part in text_parts(texts, self.CHARS) for row, term, n in [self._counted(part)]]
        return tuple(np.concatenate(x) for x in zip(*(parts or [(np.zeros(0, np.int64),) * 3])))

    def _weigh(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, term, count = self._counted(texts)
        raw = (np.log(count) + 1.0) * self.values[term, 0] if len(term) else np.zeros(0)
        norm = np.sqrt(np.bincount(row, raw * raw, len(texts)))
        return row, term, raw / norm[row]

    def _counted(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        whole = MARK.join([t or "" for t in texts])
        if not whole.isascii():
            for accented in self.accents.keys() & set(whole):
                whole = whole.replace(accented, self.accents[accented])
        found = distinct_words(whole) if whole.count("\n") == len(texts) - 1 else numbered_words(TOKENS(whole))
        spoken, ids = found
        ids = np.take(np.fromiter(map(self.words.get, spoken, repeat(-1)), np.int64, len(spoken)), ids)
        ids = ids[np.take(np.array([len(w) > 1 or w == "\n" for w in spoken], bool), found[1])]
        row = np.cumsum(ids == self.mark)
        known = (ids >= 0) & (ids != self.mark)
        one = np.flatnonzero(known)
        one = one[self.single[ids[one]] >= 0]
        two, at = np.flatnonzero(known[:-1] & known[1:]), np.zeros(0, np.int64)
        if len(two) and len(self.codes):
            code = ids[two] * len(self.words) + ids[two + 1]
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            hit = self.codes[at] == code
            two, at = two[hit], at[hit]
        else:
            two = two[:0]
        n = max(1, len(self.terms))
        found = np.concatenate([row[one] * n + self.single[ids[one]], row[two] * n + self.pair[at]])
        found, count = np.unique(found, return_counts=True)
        return found // n, found % n, count


def weighted_terms(clean: str, vocab: DataFrame) -> Column:
    """``array<struct<term,w>>`` of one cleaned text, in no particular order.

    Texts stay in their rows: no join with the vocabulary and no shuffle.
    """
    shared = vocab.sparkSession.sparkContext.broadcast(TermArrays(term_values(vocab, ["idf"]), accent_map()))

    @F.arrow_udf("array<struct<term:string,w:double>>")
    def weigh(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = pa.array(shared.value.terms, pa.string())
        for texts in batches:
            if not len(texts):
                yield pa.array([], pa.list_(pa.struct([("term", pa.string()), ("w", pa.float64())])))
            for start, stop, row, term, w in shared.value.weigh_parts(texts):
                offsets = pa.array(np.searchsorted(row, np.arange(stop - start + 1)), pa.int32())
                found = pa.StructArray.from_arrays([names.take(pa.array(term)), pa.array(w)], ["term", "w"])
                yield pa.ListArray.from_arrays(offsets, found)

    return weigh(F.col(clean))


def tfidf(docs: DataFrame, vocab: DataFrame, doc: str, clean: str = "text") -> DataFrame:
    """Long table ``(doc, term, w)`` of normalised weights under a saved vocabulary.

    Unknown terms are ignored; a document without any known term has no rows here (and scores
    the intercept).
    """
    weighted = docs.select(doc, F.explode(weighted_terms(clean, vocab)).alias("x"))
    return weighted.select(doc, F.col("x.term").alias("term"), F.col("x.w").alias("w"))


def balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Per class: size and the weight that gives both classes the same total."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # Two rows: one per class.
    total = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("classes"))
    return counts.join(F.broadcast(total)).select(
        label, "n", (F.col("total") / (F.col("classes") * F.col("n"))).alias("weight")
    )


def score_column(clean: str, weights: DataFrame, intercept: float, empty_scores: bool = True) -> Column:
    """Decision score of a cleaned text; with ``empty_scores=False`` an empty text has none.

    Declared non-deterministic only so that a filter on the score does not make Spark compute
    it a second time.
    """
    shared = weights.sparkSession.sparkContext.broadcast(TermArrays(term_values(weights, ["idf", "coef"]), accent_map()))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            scores = np.full(len(texts), float(intercept))
            for start, stop, row, term, w in shared.value.weigh_parts(texts):
                if len(row):
                    scores[start:stop] += np.bincount(row, w * shared.value.values[term, 1], stop - start)
            none = None if empty_scores else pc.fill_null(pc.equal(pc.utf8_length(texts), 0), True).to_numpy(zero_copy_only=False)
            yield pa.array(scores, mask=none)

    return score.asNondeterministic()(F.col(clean))


def decision_score(docs: DataFrame, weights: DataFrame, intercept: float, clean: str = "text") -> DataFrame:
    """Add ``score``. ``weights`` holds ``term, idf, coef``."""
    return docs.withColumn("score", score_column(clean, weights, intercept))


def hard_label(score) -> Column:
    return ((F.col(score) if isinstance(score, str) else score) > 0).cast("int")


def noise_gate(df: DataFrame, score: str = "score", threshold: float = GATE) -> DataFrame:
    """Keep posts that score at least ``threshold``."""
    return df.filter(F.col(score) >= threshold)


def gate_posts(
    posts: DataFrame, weights: DataFrame, intercept: float, raw: str = "text", threshold: float = GATE
) -> DataFrame:
    """Clean, score and filter raw posts in one pass over them.

    Posts that cleaning leaves empty get no score and so never pass; a separate filter on the
    cleaned text would make Spark clean every post twice.
    """
    return noise_gate(scored_posts(posts, weights, intercept, raw), "score", threshold)


def scored_posts(posts: DataFrame, weights: DataFrame, intercept: float, raw: str = "text") -> DataFrame:
    """Add ``score`` to raw posts, null where cleaning leaves nothing."""
    cleaned = posts.withColumn("_clean", clean_text(raw))
    return cleaned.withColumn("score", score_column("_clean", weights, intercept, empty_scores=False)).drop("_clean")


def gate_stats(df: DataFrame, score: str = "score", threshold: float = GATE) -> DataFrame:
    """Submitted, passed and filtered. A null score (text empty after cleaning) never passes."""
    passed = F.count_if(F.coalesce(F.col(score) >= threshold, F.lit(False)))
    return df.agg(
        F.count(F.lit(1)).alias("submitted"), passed.alias("passed"), (F.count(F.lit(1)) - passed).alias("filtered")
    )


def top_terms(weights: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` largest and ``k`` smallest coefficients, each with its rank."""
    def side(name: str, order: Column) -> DataFrame:
        best = weights.orderBy(order, "term").limit(k)
        # k rows at most, so a single-task window is fine.
        rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order, "term"))
        return best.select(F.lit(name).alias("side"), rank.alias("rank"), "term", "coef")

    return side("positive", F.desc("coef")).unionByName(side("negative", F.asc("coef")))


def vocabulary_stats(vocab: DataFrame) -> DataFrame:
    two = F.count_if(F.instr("term", " ") > 0)
    n = F.count(F.lit(1))
    return vocab.agg(
        n.alias("vocabulary_size"),
        (n - two).alias("unigram_count"),
        two.alias("bigram_count"),
        F.round(two * 100.0 / F.nullif(n, F.lit(0)), 2).alias("bigram_pct"),
    )
