"""Quality figures of a classifier and statistics of its corpus."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import ws_tokens

TARGET_F1 = 0.85


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, and 0 where ``b`` is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return ratio(precision * recall * 2.0, precision + recall)


def _cells(y: str, yhat: str) -> dict[str, Column]:
    hit = lambda t, p: F.count_if((F.col(y) == t) & (F.col(yhat) == p))
    return {"tp": hit(1, 1), "tn": hit(0, 0), "fp": hit(0, 1), "fn": hit(1, 0)}


def confusion(df: DataFrame, y: str = "label", yhat: str = "predicted", by: Sequence[str] = ()) -> DataFrame:
    """The four cells and their rates, one pass; ``by`` gives one row per group."""
    c = {k: F.col(k) for k in ("tp", "tn", "fp", "fn")}
    cells = df.groupBy(*by).agg(*[v.alias(k) for k, v in _cells(y, yhat).items()])
    return cells.withColumns(
        {
            "tpr": F.round(ratio(c["tp"], c["tp"] + c["fn"]), 4),
            "fpr": F.round(ratio(c["fp"], c["fp"] + c["tn"]), 4),
            "tnr": F.round(ratio(c["tn"], c["tn"] + c["fp"]), 4),
            "fnr": F.round(ratio(c["fn"], c["fn"] + c["tp"]), 4),
        }
    )


def accuracy(df: DataFrame, y: str = "label", yhat: str = "predicted") -> DataFrame:
    return df.agg(F.avg((F.col(y) == F.col(yhat)).cast("double")).alias("accuracy"))


def class_report(df: DataFrame, y: str = "label", yhat: str = "predicted", by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of each class."""
    return report(df.groupBy(*by).agg(*[v.alias(k) for k, v in _cells(y, yhat).items()]), by)


def report(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The class report of counted cells ``tp, tn, fp, fn``, one row per group."""
    row = lambda cls, hit, wrong, missed: F.struct(
        F.lit(cls).alias("class"),
        ratio(F.col(hit), F.col(hit) + F.col(wrong)).alias("precision"),
        ratio(F.col(hit), F.col(hit) + F.col(missed)).alias("recall"),
        (F.col(hit) + F.col(missed)).alias("support"),
    )
    both = F.array(row(0, "tn", "fn", "fp"), row(1, "tp", "fp", "fn"))
    rows = cells.select(*by, F.inline(both))
    return rows.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def averaged_metrics(df: DataFrame, y: str = "label", yhat: str = "predicted", by: Sequence[str] = ()) -> DataFrame:
    """Macro and support-weighted averages of the class report, and accuracy."""
    return averages(class_report(df, y, yhat, by), by)


def averages(classes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """As :func:`averaged_metrics`, of a class report."""
    names = ("precision", "recall", "f1")
    macro = [F.avg(n).alias(f"{n}_macro") for n in names]
    weighted = [ratio(F.sum(F.col(n) * F.col("support")), F.sum("support")).alias(f"{n}_weighted") for n in names]
    share = ratio(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("accuracy")
    return classes.groupBy(*by).agg(*macro, *weighted, share)


def meets_target(averages: DataFrame, target: float = TARGET_F1) -> DataFrame:
    return averages.select("f1_weighted", (F.col("f1_weighted") >= target).alias("meets_target"))


def fold_summary(folds: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean and population deviation over the folds, long form."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
    return folds.select(F.inline(pairs)).groupBy("metric").agg(
        F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_pop("value"), 4).alias("std")
    )


def dataset_stats(df: DataFrame, raw: str = "raw_text", label: str = "label") -> DataFrame:
    """Class sizes and lengths in blank-separated tokens, one pass."""
    sized = df.withColumn("_n", F.size(ws_tokens(raw)))
    positive, negative = F.col(label) == 1, F.col(label) == 0
    mean = lambda when: F.coalesce(F.round(F.avg(F.when(when, F.col("_n"))), 2), F.lit(0.0))
    return sized.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(positive).alias("n_positive"),
        F.count_if(negative).alias("n_negative"),
        F.round(F.count_if(positive) / F.nullif(F.count_if(negative), F.lit(0)), 3).alias("class_ratio"),
        F.round(F.avg("_n"), 2).alias("avg_tokens"),
        mean(positive).alias("avg_tokens_positive"),
        mean(negative).alias("avg_tokens_negative"),
        F.max("_n").alias("max_tokens"),
        F.min("_n").alias("min_tokens"),
    )


def metrics_table(**parts: DataFrame) -> DataFrame:
    """Long table ``(metric, key, value)`` of one-row tables, one ``metric`` per argument."""

    def unpivot(name: str, df: DataFrame) -> DataFrame:
        cells = [F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in df.columns]
        return df.select(F.lit(name).alias("metric"), F.inline(F.array(*cells)))

    return reduce(lambda a, b: a.unionByName(b), [unpivot(n, d) for n, d in parts.items()])
