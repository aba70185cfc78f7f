"""Training the linear classifier and judging it by resampling."""

from __future__ import annotations

import time
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import settle
from .cases import PARTS, Case, balance_of, case_sizes, case_vocabularies, fit_cases, number_terms, resample
from .features import MAX_FEATURES, count_terms, decision_score, gate_posts, hard_label, idf, term_values, top_vocabulary
from .metrics import averages, report
from .prep import assign_folds
from .scale import hash_share

CV_METRICS = ("accuracy", "f1_macro", "f1_weighted", "precision_macro", "recall_macro")


def fit_vocabulary(docs: DataFrame, doc: str, clean: str = "text", min_df: int = 2, max_features: int = MAX_FEATURES):
    """``(term, df, cf, idf)`` of a training set."""
    n_docs = docs.count()
    return settle(idf(top_vocabulary(count_terms(docs, clean), min_df, max_features), n_docs))


def train_linear(
    docs: DataFrame, vocab: DataFrame, clean: str = "text", label: str = "label", C: float = 1.0, max_iter: int = 2000,
    tol: float = 1e-3,
) -> tuple[DataFrame, float]:
    """Weights ``(term, idf, coef)`` and intercept of a linear max-margin classifier with balanced classes (0 and 1).
    ``vocab`` holds at most as many rows as :func:`build_vocabulary` was told. Of one class alone nothing is learned:
    all weights are 0."""
    known = term_values(vocab, ["idf"])
    idf = np.array([[v[0] for v in known.values()]]).reshape(1, -1)
    rows, cases = docs.withColumns({"fold": F.lit(0), "step": F.lit(0)}), [Case(-1)]
    blocks = number_terms(rows, clean, label, list(known), idf)
    model = fit_cases(blocks, cases, idf, balance_of(case_sizes(rows, label, cases)), C, tol, max_iter)[0]
    table = pa.table({"term": list(known), "idf": idf[0], "coef": model[:-1]}, pa.schema([
        ("term", pa.string()), ("idf", pa.float64()), ("coef", pa.float64())]))
    return docs.sparkSession.createDataFrame(table), float(model[-1])


def fit_classifier(docs: DataFrame, doc: str, clean: str = "text", label: str = "label", **options):
    """Vocabulary and weights of a training set in one go."""
    return train_linear(docs, fit_vocabulary(docs, doc, clean), clean, label, **options)


def predict(docs: DataFrame, weights: DataFrame, intercept: float, clean: str = "text") -> DataFrame:
    return decision_score(docs, weights, intercept, clean).withColumn("predicted", hard_label("score"))


def cross_validate(
    docs: DataFrame, doc: str, clean: str = "text", label: str = "label", k: int = 5, seed: int = 42, exact: bool = True,
    **options,
) -> DataFrame:
    """Quality per fold; vocabulary and weights are fitted without the fold each time, for all folds together. Folds that
    leave one class to learn from are missing. ``docs`` is read several times, so a long plan should be written first."""
    folded = assign_folds(docs.select(doc, clean, label), label, doc, k, seed, exact).withColumn("step", F.lit(0))
    cells = resample(folded, doc, clean, label, [Case(fold) for fold in range(k)], **options)
    out = averages(report(cells.filter("part = 'validation'"), ["case"]), ["case"])
    return out.select((F.col("case") + 1).alias("fold"), *[F.round(m, 4).alias(m) for m in CV_METRICS])


def fold_vocabularies(docs: DataFrame, doc: str, clean: str = "text", label: str = "label", k: int = 5, seed: int = 42) -> DataFrame:
    """``(fold, term, df, cf)``: the vocabulary that :func:`cross_validate` fits without each fold."""
    folded = settle(assign_folds(docs.select(doc, clean, label), label, doc, k, seed).withColumn("step", F.lit(0)))
    picked = case_vocabularies(folded, doc, clean, [Case(fold) for fold in range(k)])
    return picked.select((F.col("case") + 1).alias("fold"), "term", "df", "cf")


def learning_curve(
    docs: DataFrame, doc: str, clean: str = "text", label: str = "label",
    fractions: Sequence[float] = tuple(0.1 + i * 0.9 / 7 for i in range(8)), k: int = 3, seed: int = 42, **options,
) -> DataFrame:
    """Macro F1 on the training part and on the held-out fold for growing training sets. The
    sets are nested: a row belongs to every fraction above its own hash. A set with fewer than two
    classes counts as 0 in the means. All sets are fitted together. ``docs`` as in :func:`cross_validate`."""
    bounds = sorted(min(f, 1.0) for f in fractions)
    share = hash_share(F.col(doc), F.lit("prefix"), F.lit(seed))
    step = sum(((share >= b).cast("int") for b in bounds), F.lit(0))  # the first fraction that a row belongs to
    folded = assign_folds(docs.select(doc, clean, label), label, doc, k, seed).withColumn("step", step)
    cases = [Case(fold, step) for step in range(len(bounds)) for fold in range(k)]
    cells = resample(folded, doc, clean, label, cases, **options)
    found = averages(report(cells, ["case", "part"]), ["case", "part"]).select("case", "part", "f1_macro")
    wanted = [(i, round(bounds[case.step], 4), part) for i, case in enumerate(cases) for part in PARTS]
    # One row for each set and part.
    every = docs.sparkSession.createDataFrame(wanted, "case int, fraction double, part string")
    every = every.join(found, ["case", "part"], "left").fillna(0.0, ["f1_macro"])
    return every.groupBy("fraction", "part").agg(
        F.round(F.avg("f1_macro"), 4).alias("mean"), F.round(F.stddev_pop("f1_macro"), 4).alias("std")
    )


def scoring_throughput(docs: DataFrame, weights: DataFrame, intercept: float, raw: str = "text") -> dict[str, float]:
    """Posts per second of clean, score and gate over the whole table, without a sink."""
    n = docs.count()
    start = time.perf_counter()
    gate_posts(docs, weights, intercept, raw).write.format("noop").mode("overwrite").save()
    seconds = time.perf_counter() - start
    return {"posts": n, "seconds": seconds, "posts_per_sec": n / seconds}
