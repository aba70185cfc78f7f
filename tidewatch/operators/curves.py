"""Curves over the decision score. All of them first reduce the rows to counts per score or
per bucket, then accumulate those."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import settle
from .metrics import f1, ratio
from .scale import running_totals


def _tied(df: DataFrame, y: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score: the only pass over the scored rows."""
    counts = F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")
    return settle(df.groupBy(F.col(score).alias("threshold")).agg(*counts))


def _cumulative(tied: DataFrame) -> DataFrame:
    """Per distinct score, highest first: positives and negatives there and so far."""
    return running_totals(tied, [F.desc("threshold")], {"tp": F.col("pos"), "fp": F.col("neg")})


def _class_totals(tied: DataFrame) -> tuple[int, int]:
    row = tied.agg(F.sum("pos"), F.sum("neg")).first()
    return int(row[0] or 0), int(row[1] or 0)


def roc_curve(df: DataFrame, y: str = "label", score: str = "score") -> DataFrame:
    """``(threshold, fpr, tpr)`` for every distinct score and the origin (null threshold)."""
    tied = _tied(df, y, score)
    pos, neg = _class_totals(tied)
    points = _cumulative(tied).select(
        "threshold", ratio(F.col("fp"), F.lit(neg)).alias("fpr"), ratio(F.col("tp"), F.lit(pos)).alias("tpr")
    )
    origin = df.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(origin)


def auc(df: DataFrame, y: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve. Each group of tied scores is one trapezoid, whose corners
    follow from the counts so far and the counts of the group."""
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    whole = F.sum("pos").cast("double") * F.sum("neg")
    return _cumulative(_tied(df, y, score)).agg(ratio(area, whole).alias("auc"))


def pr_curve(df: DataFrame, y: str = "label", score: str = "score") -> DataFrame:
    """``(threshold, precision, recall)`` and the closing point (precision 1, recall 0)."""
    tied = _tied(df, y, score)
    pos, _ = _class_totals(tied)
    points = _cumulative(tied).select(
        "threshold",
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.lit(pos)).alias("recall"),
    )
    close = df.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return points.unionByName(close)


def average_precision(df: DataFrame, y: str = "label", score: str = "score") -> DataFrame:
    """Average precision and the share of positives as the no-skill level."""
    tied = _tied(df, y, score)
    pos, neg = _class_totals(tied)
    step = ratio(F.col("pos"), F.lit(pos)) * ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    return _cumulative(tied).agg(F.sum(step).alias("average_precision")).withColumn(
        "baseline", ratio(F.lit(pos), F.lit(pos + neg))
    )


def _grid(i: Column, lo: Column, hi: Column, steps: int) -> Column:
    """The ``i``-th of ``steps`` equally spaced values from ``lo`` to ``hi``."""
    gap = (hi - lo) / F.lit(float(steps - 1))
    return F.when(i >= steps - 1, hi).otherwise(i * gap + lo)


def _grid_index(x: Column, lo: Column, hi: Column, steps: int) -> Column:
    """Last grid position whose value does not exceed ``x``. The division only guesses; the
    neighbours are compared exactly."""
    gap = (hi - lo) / F.lit(float(steps - 1))
    guess = F.when(gap > 0, F.floor((x - lo) / gap)).otherwise(F.lit(steps - 1))
    guess = F.least(F.greatest(guess, F.lit(0)), F.lit(steps - 1)).cast("int")
    up, down = F.least(guess + 1, F.lit(steps - 1)), F.greatest(guess - 1, F.lit(0))
    return F.when(_grid(up, lo, hi, steps) <= x, up).when(_grid(guess, lo, hi, steps) <= x, guess).otherwise(down)


def threshold_sweep(df: DataFrame, y: str = "label", score: str = "score", steps: int = 200) -> DataFrame:
    """Quality at ``score >= threshold`` for equally spaced thresholds.

    Every distinct score is put into one of ``steps`` buckets; all thresholds are then sums over
    buckets, not passes over the rows.
    """
    tied = _tied(df, y, score)
    lo, hi = (F.lit(v) for v in tied.agg(F.min("threshold").cast("double"), F.max("threshold").cast("double")).first())
    counts = tied.groupBy(_grid_index(F.col("threshold"), lo, hi, steps).alias("step")).agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    every = df.sparkSession.range(steps).select(F.col("id").cast("int").alias("step"))
    filled = every.join(F.broadcast(counts), "step", "left").fillna(0, ["pos", "neg"])
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(F.lit(0))  # at most ``steps`` rows
    summed = filled.select(
        "step",
        _grid(F.col("step"), lo, hi, steps).alias("threshold"),
        F.sum("pos").over(above).alias("tp"),
        F.sum("neg").over(above).alias("fp"),
        F.sum("pos").over(whole).alias("p"),
        F.sum("neg").over(whole).alias("n"),
    )
    none = F.col("tp") + F.col("fp") == 0
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("p"))
    correct = ratio(F.col("tp") + F.col("n") - F.col("fp"), F.col("p") + F.col("n"))
    return summed.select(
        "step",
        "threshold",
        F.when(none, 0.0).otherwise(f1(precision, recall)).alias("f1"),
        F.when(none, 1.0).otherwise(precision).alias("precision"),
        F.when(none, 0.0).otherwise(recall).alias("recall"),
        F.when(none, 0.0).otherwise(correct).alias("accuracy"),
    )


def best_threshold(sweep: DataFrame, deployed: float = 0.3) -> DataFrame:
    """First threshold with the highest F1, and the figures nearest the deployed threshold."""
    fields = ("threshold", "f1", "precision", "recall", "accuracy")
    row = F.struct(*fields)
    best = sweep.agg(F.min_by(row, F.struct(-F.col("f1"), F.col("step"))).alias("r"))
    at = sweep.agg(F.min_by(row, F.struct(F.abs(F.col("threshold") - deployed), F.col("step"))).alias("r"))
    return best.select(F.lit("best").alias("which"), "r.*").unionByName(
        at.select(F.lit("deployed").alias("which"), "r.*")
    )


def _ranges(tied: DataFrame, shared: bool) -> DataFrame:
    """Value range per class (two rows), a single value widened by one half on each side."""
    ends = tied.groupBy("label").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("k").alias("n"))
    if shared:
        both = Window.partitionBy(F.lit(0))
        ends = ends.select("label", F.min("lo").over(both).alias("lo"), F.max("hi").over(both).alias("hi"), "n")
    flat = F.col("lo") == F.col("hi")
    half = F.when(flat, F.lit(0.5)).otherwise(F.lit(0.0))
    return ends.select("label", (F.col("lo") - half).alias("lo"), (F.col("hi") + half).alias("hi"), "n")


def score_histogram(
    df: DataFrame, bins: int = 40, y: str = "label", score: str = "score", shared_edges: bool = False
) -> DataFrame:
    """Density of the score per class; the right edge belongs to the last bin."""
    tied = df.groupBy(F.col(y).alias("label"), F.col(score).cast("double").alias("x")).agg(F.count(score).alias("k"))
    tied = settle(tied)  # the only pass over the scored rows
    ranges = F.broadcast(_ranges(tied, shared_edges))
    placed = tied.join(ranges, "label")
    position = _grid_index(F.col("x"), F.col("lo"), F.col("hi"), bins + 1)
    counts = placed.groupBy("label", F.least(position, F.lit(bins - 1)).alias("bin")).agg(F.sum("k").alias("c"))
    every = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = every.join(F.broadcast(counts), ["label", "bin"], "left").fillna(0, ["c"])
    width = (F.col("hi") - F.col("lo")) / bins
    return full.select(
        "label",
        "bin",
        _grid(F.col("bin"), F.col("lo"), F.col("hi"), bins + 1).alias("left_edge"),
        width.alias("width"),
        F.col("c").alias("n_rows"),
        (F.col("c") / (F.col("n") * width)).alias("density"),
    )


def class_overlap(
    df: DataFrame, bins: int = 100, shared_edges: bool = False, y: str = "label", score: str = "score"
) -> DataFrame:
    """How much the score densities of the classes overlap.

    As published every class has its own range and the sum is divided by the number of bins;
    ``shared_edges=True`` compares like with like and weighs by the bin width.
    """
    histogram = score_histogram(df, bins, y, score, shared_edges)
    by_bin = histogram.groupBy("bin").agg(
        F.min("density").alias("low"), F.count(F.lit(1)).alias("classes"), F.max("width").alias("width")
    )
    weight = F.col("width") if shared_edges else F.lit(1.0 / bins)
    return by_bin.filter("classes = 2").agg(F.coalesce(F.sum(F.col("low") * weight), F.lit(0.0)).alias("overlap"))
