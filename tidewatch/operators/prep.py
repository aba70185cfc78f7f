"""Preparation of the labelled training set."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import EVENT_LABELS, map_label
from ..session import settle
from .scale import hash_share, running_rank

PREFIX = 4  # hex digits of a hash that the histograms tell apart
SHARED_BUCKETS = 1_000_000  # rows of a histogram that are sent to every task


def union_labelled(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), tables)


def drop_exact(df: DataFrame) -> DataFrame:
    """One row per original text and label."""
    return df.dropDuplicates(["raw_text", "label"])


def fingerprint(c: str):
    """Short key for comparing long texts: 16 bytes move instead of the text."""
    return F.unhex(F.md5(c))


def _text_labels(df: DataFrame, *key) -> DataFrame:
    return df.groupBy(*key).agg(F.min("label").alias("lo"), F.max("label").alias("hi"))


def drop_label_conflicts(df: DataFrame) -> DataFrame:
    """Drop every row whose cleaned text occurs with more than one label.

    Fingerprints are grouped, and only those of conflicting texts come back, one row each; the
    join is left without a hint, so Spark broadcasts them only after seeing their size.
    """
    conflicts = _text_labels(df, fingerprint("text").alias("_print")).filter("lo <> hi").select("_print")
    marked = df.withColumn("_print", fingerprint("text"))
    return marked.join(conflicts, "_print", "left_anti").select(*df.columns)


def dedupe_labelled(df: DataFrame) -> DataFrame:
    """Exact dedupe, conflict removal and cleaned dedupe in one aggregation.

    What is left after the three steps is one row per cleaned text that has a single label.
    """
    return _text_labels(df, "text").filter("lo = hi").select("text", F.col("lo").alias("label"))


def dedupe_report(df: DataFrame) -> DataFrame:
    """How many rows each removal step takes, in one row.

    Two nested aggregations over fingerprints: per original text and label, then per cleaned text.
    """
    prints = df.select(fingerprint("text").alias("text"), "label", fingerprint("raw_text").alias("raw_text"))
    exact = prints.groupBy("text", "label", "raw_text").agg(F.count(F.lit(1)).alias("n"))
    by_text = exact.groupBy("text").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("n_exact"),
        (F.min("label") != F.max("label")).alias("conflict"),
    )
    one = F.lit(1).cast("long")
    total = lambda value, condition: F.coalesce(F.sum(F.when(condition, value)), F.lit(0))
    return (
        by_text.agg(
            F.coalesce(F.sum(F.col("n") - F.col("n_exact")), F.lit(0)).alias("exact_duplicates"),
            total(one, F.col("conflict")).alias("conflict_groups"),
            total(F.col("n_exact"), F.col("conflict")).alias("conflict_rows"),
            total(F.col("n_exact") - 1, ~F.col("conflict")).alias("clean_duplicates"),
            total(one, ~F.col("conflict")).alias("final_rows"),
        )
        .withColumn(
            "total_removed", F.col("exact_duplicates") + F.col("conflict_rows") + F.col("clean_duplicates")
        )
        .select(
            "exact_duplicates", "conflict_groups", "conflict_rows", "clean_duplicates", "total_removed", "final_rows"
        )
    )


def label_audit(df: DataFrame, label: str, mapping: dict[str, int] | None = None) -> DataFrame:
    """Every label spelling with its count and what it is mapped to."""
    mapping = EVENT_LABELS if mapping is None else mapping
    known = F.lower("variant").isin(*mapping)
    return (
        df.filter(F.col(label).isNotNull())
        .groupBy(F.trim(F.col(label).cast("string")).alias("variant"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("mapped", F.when(known, map_label("variant", mapping).cast("string")).otherwise("unknown"))
        .orderBy(F.desc("n"), "variant")
    )


def class_balance(df: DataFrame, label: str = "label", warn_above: float = 60.0) -> DataFrame:
    return (
        df.agg(
            F.count(F.lit(1)).alias("n_total"),
            F.count_if(F.col(label) == 0).alias("n_negative"),
            F.count_if(F.col(label) == 1).alias("n_positive"),
        )
        .withColumn("positive_pct", F.col("n_positive") * 100.0 / F.nullif("n_total", F.lit(0)))
        .withColumn("imbalanced", F.coalesce(F.col("positive_pct") > warn_above, F.lit(False)))
    )


def source_counts(df: DataFrame, source: str, file: str) -> DataFrame:
    """Rows and distinct files per source, by one pre-aggregation per file."""
    per_file = df.groupBy(source, file).agg(F.count(F.lit(1)).alias("n"))
    return per_file.groupBy(source).agg(F.sum("n").alias("n_rows"), F.count(F.col(file)).alias("n_files"))


def seeded_order(df: DataFrame, key: str, seed: int = 42, position: str | None = None) -> DataFrame:
    """A reproducible shuffle: global sort on a keyed hash. With ``position`` the rows are numbered from 1 in that order, and
    not sorted as a whole."""
    if position is None:
        return df.orderBy(_hash(key, seed), key)
    return running_rank(df.withColumn("_hash", _hash(key, seed)), ["_hash", key], position).drop("_hash")


def drop_missing(df: DataFrame, cols: Sequence[str] = ("text", "label")) -> DataFrame:
    text, label = cols
    return (
        df.dropna(subset=list(cols))
        .filter(F.length(text) > 0)
        .withColumn(label, F.col(label).cast("int"))
    )


def stratified_split(
    df: DataFrame, label: str, key: str, test: float = 0.2, seed: int = 42, exact: bool = True
) -> DataFrame:
    """Add ``split`` ('train' or 'test'): the first ``ceil(test * n)`` rows of every class in hash order are the test rows.

    Nothing is sorted and the rows stay where they are: a histogram over hash prefixes finds the bucket of each class that
    holds its last test row, and only that bucket is looked at closely. Null labels are a class; rows of one key go the
    same way. With ``exact=False`` a row's own hash decides, and class shares hold in expectation.
    """
    if not exact:
        share = hash_share(F.col(key), F.lit(seed))
        return df.withColumn("split", F.when(share < test, "test").otherwise("train"))
    hashed = _hash_keys(df, label, key, seed)
    buckets = _buckets(hashed, label)
    take = F.ceil(F.col("_all") * F.lit(test))
    # One row per class.
    edge = buckets.filter((F.col("_before") < take) & (take <= F.col("_before") + F.col("_n")))
    edge = settle(edge.select(F.col(label).alias("_class"), "_prefix", (take - F.col("_before")).alias("_take")))
    same = F.col(label).eqNullSafe(F.col("_class"))
    near = hashed.withColumnRenamed("_prefix", "_own").join(F.broadcast(edge), same & (F.col("_own") == F.col("_prefix")))
    counts = near.groupBy("_class", "_take", "_h", key).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_class").orderBy("_h", key))
    cut = counts.withColumn("_upto", upto).filter("_upto >= _take").groupBy("_class").agg(F.min(F.struct("_h", key)).alias("_cut"))
    before = F.struct(_hash(key, seed).alias("_h"), F.col(key)) <= F.col("_cut")
    return (
        df.join(F.broadcast(cut), same, "left")
        .withColumn("split", F.when(before, "test").otherwise("train"))
        .select(*df.columns, "split")
    )


def assign_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42, exact: bool = True) -> DataFrame:
    """Add ``fold`` 0..k-1: the rows of each class in hash order, dealt in turn, so folds differ by one row a class.

    Each row moves once, into a bucket of its class and hash prefix; its place is the one there plus the rows of the buckets
    before, which a histogram gives. ``key`` should be unique: rows of one key meet in one bucket. With ``exact=False``
    a row's own hash decides, without a shuffle.
    """
    if not exact:
        return df.withColumn("fold", F.floor(hash_share(F.col(key), F.lit(seed)) * k).cast("int"))
    buckets = settle(_buckets(_hash_keys(df, label, key, seed), label)).select(
        F.col(label).alias("_class"), F.col("_prefix").alias("_bucket"), "_before"
    )
    buckets = F.broadcast(buckets) if buckets.count() <= SHARED_BUCKETS else buckets
    rows = df.withColumn("_h", _hash(key, seed)).withColumn("_prefix", F.substring("_h", 1, PREFIX))
    rows = rows.join(buckets, F.col(label).eqNullSafe(F.col("_class")) & (F.col("_prefix") == F.col("_bucket")))
    place = F.row_number().over(Window.partitionBy(label, "_prefix").orderBy("_h", key)) - 1 + F.col("_before")
    return rows.select(*df.columns, (place % k).cast("int").alias("fold"))


def _buckets(hashed: DataFrame, label: str) -> DataFrame:
    """Per class and hash prefix: ``_n`` rows, ``_before`` in earlier prefixes, ``_all`` in the class. The windows are over
    counts, at most one for each prefix."""
    counts = hashed.groupBy(label, "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(label)
    earlier = whole.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    sums = {"_before": F.coalesce(F.sum("_n").over(earlier), F.lit(0)), "_all": F.sum("_n").over(whole)}
    return counts.withColumns(sums)


def _hash(key: str, seed: int):
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))


def _hash_keys(df: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """What a selection needs, without the texts; settled because it is read twice."""
    hashed = df.select(label, key, _hash(key, seed).alias("_h"))
    return settle(hashed.withColumn("_prefix", F.substring("_h", 1, PREFIX)))


def eval_scope(df: DataFrame, min_rows: int = 120) -> DataFrame:
    """Whether to evaluate on everything (small corpora) or on the held-out part."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "scope", F.when(F.col("n_rows") <= min_rows, "all").otherwise("held_out")
    )
