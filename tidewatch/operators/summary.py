"""The metrics document of an evaluation: all its figures in one long table, and the same as nested JSON."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import settle
from .curves import auc, average_precision, best_threshold, class_overlap, threshold_sweep
from .features import hard_label, top_terms, vocabulary_stats
from .metrics import averages, class_report, confusion, dataset_stats, fold_summary

TOP = 10  # terms named for each side
MB = 1024.0 * 1024.0


def entries(part: str, df: DataFrame, places: int = 4, columns: Sequence[str] = ()) -> DataFrame:
    """``(part, key, value, text)`` for each column of a one-row table; strings go to ``text``, the rest to ``value``."""
    kinds = dict(df.dtypes)

    def cell(c: str) -> Column:
        named = kinds[c] == "string"
        value = F.lit(None).cast("double") if named else F.round(F.col(c).cast("double"), places)
        return F.struct(F.lit(c).alias("key"), value.alias("value"), (F.col(c) if named else F.lit(None).cast("string")).alias("text"))

    return df.select(F.lit(part).alias("part"), F.inline(F.array(*[cell(c) for c in columns or df.columns])))


def classification(predicted: DataFrame, y: str = "label", yhat: str = "predicted") -> DataFrame:
    """Accuracy, averages and the F1 of each class in one row, from one pass."""
    classes = settle(class_report(predicted, y, yhat))
    each = classes.agg(*[F.max(F.when(F.col("class") == c, F.col("f1"))).alias(f"{name}_f1") for c, name in ((1, "positive"), (0, "negative"))])
    # Two one-row tables.
    both = averages(classes).join(F.broadcast(each))
    return both.select(
        "accuracy", (F.col("accuracy") * 100).alias("accuracy_pct"), F.col("f1_macro").alias("macro_f1"),
        F.col("f1_weighted").alias("weighted_f1"), F.col("precision_weighted").alias("weighted_precision"),
        F.col("recall_weighted").alias("weighted_recall"), "positive_f1", "negative_f1",
    )


def fold_entries(folds: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean, deviation and the value of each fold, for each metric of ``folds(fold, *metrics)``."""
    none = F.lit(None).cast("string").alias("text")
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.round(m, 4).alias("value")) for m in metrics])
    by_fold = folds.select("fold", F.inline(each)).select(F.concat("metric", F.lit(".fold_"), "fold").alias("key"), "value")
    sums = fold_summary(folds, metrics)
    for c in ("mean", "std"):
        by_fold = by_fold.unionByName(sums.select(F.concat("metric", F.lit(f".{c}")).alias("key"), F.col(c).alias("value")))
    return by_fold.select(F.lit("cross_validation").alias("part"), "key", "value", none)


def metrics_document(
    scored: DataFrame, corpus: DataFrame | None = None, weights: DataFrame | None = None, folds: DataFrame | None = None,
    latency: Mapping[str, float] | None = None, settings: Mapping[str, object] | None = None, y: str = "label",
    score: str = "score", raw: str = "raw_text", deployed: float = 0.3,
) -> DataFrame:
    """``(part, key, value, text)`` of everything an evaluation reports.

    ``scored(label, score)`` are the rows that are judged; it gives the parts ``classification``, ``ranking``,
    ``threshold`` and ``confusion_matrix``. Each further argument adds its parts: ``corpus(raw_text, label)`` the
    ``dataset``; ``weights(term, idf, coef)`` the ``vocabulary``, the ``features`` (the strongest terms of both sides, as
    text, with their coefficients) and the ``model`` size; ``folds(fold, metrics...)`` the ``cross_validation``;
    ``latency`` and ``settings`` are passed on. Figures of quality have four places.

    The scored rows are reduced to label and score and kept for the passes over them; the result has some tens of rows.
    """
    rows = settle(scored.select(F.col(y).alias("label"), F.col(score).alias("score")))
    predicted = rows.withColumn("predicted", hard_label("score"))
    quality = classification(predicted).withColumn("accuracy_pct", F.round("accuracy_pct", 2))
    area = auc(rows).withColumnRenamed("auc", "roc_auc")
    parts = [entries("classification", quality), entries("confusion_matrix", confusion(predicted)), entries("ranking", area),
             entries("ranking", average_precision(rows)), entries("ranking", class_overlap(rows).withColumnRenamed("overlap", "score_overlap"))]
    sweep = settle(threshold_sweep(rows).withColumn("f1", F.round("f1", 12)))
    named = best_threshold(sweep, deployed)
    for which in ("best", "deployed"):
        one = named.filter(F.col("which") == which).drop("which")
        parts.append(entries("threshold", one.select(*[F.col(c).alias(f"{which}_{c}") for c in one.columns])))
    if corpus is not None:
        parts.append(entries("dataset", dataset_stats(corpus, raw, y)))
    if weights is not None:
        size = F.sum(F.octet_length("term") + 16) / MB  # the text and two numbers
        parts += [entries("vocabulary", vocabulary_stats(weights)), entries("model", weights.agg(size.alias("size_mb")), 2)]
        top = top_terms(weights, TOP)
        key = F.concat("side", F.lit("_"), F.lpad(F.col("rank").cast("string"), 2, "0"))
        parts.append(top.select(F.lit("features").alias("part"), key.alias("key"), F.round("coef", 4).alias("value"), F.col("term").alias("text")))
    if folds is not None:
        parts.append(fold_entries(settle(folds), [c for c in folds.columns if c != "fold"]))
    spark = scored.sparkSession
    for part, given in (("latency", latency), ("model_config", settings)):
        if given:
            values = [F.lit(v).cast("double") if isinstance(v, (int, float)) and not isinstance(v, bool) else F.lit(str(v)) for v in given.values()]
            parts.append(entries(part, spark.range(1).select(*[v.alias(k) for k, v in zip(given, values)]), 6))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _quoted(c: str) -> Column:
    listed = F.to_json(F.array(F.col(c)))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def document_json(document: DataFrame) -> DataFrame:
    """One row with ``json``: ``{part: {key: number or text}}``, parts and keys in order. A term among the features is given
    by its name. Numbers that JSON has no sign for (not a number, infinite) and missing ones are null.

    Meant for :func:`metrics_document`, whose rows do not grow with the data.
    """
    number = F.when(F.isnan("value") | (F.abs("value") == float("inf")), None).otherwise(F.col("value").cast("string"))
    literal = F.coalesce(F.when(F.col("text").isNotNull(), _quoted("text")), number, F.lit("null"))
    member = document.select("part", "key", F.concat(_quoted("key"), F.lit(":"), literal).alias("member"))
    joined = lambda c, order: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, c))), lambda x: x[c]), ",")
    objects = member.groupBy("part").agg(joined("member", "key").alias("members"))
    whole = objects.select("part", F.concat(_quoted("part"), F.lit(":{"), "members", F.lit("}")).alias("object"))
    return whole.agg(F.concat(F.lit("{"), joined("object", "part"), F.lit("}")).alias("json"))
