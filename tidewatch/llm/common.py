"""Helpers shared by the corpus operators: shared folders, binary files, words, links."""

from __future__ import annotations

import string
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import checkpoint_folder, settle, shuffle_width

# A-Z to a-z and nothing else, on UTF-8 bytes.
LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder that every executor can reach, under the session's checkpoint folder."""
    return f"{checkpoint_folder(spark)}/{label}-{uuid.uuid4().hex}"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_blobs(blobs: DataFrame, path: str) -> None:
    """One file per row of ``blobs(blob binary)``, through Spark's own committer: a lost executor leaves no
    half file, and any file system that Spark can write to will do. Spark ends each file with one zero byte."""
    text = blobs.select(F.col("blob").cast("string").alias("value"))
    text.write.option("maxRecordsPerFile", 1).option("lineSep", "\0").option("compression", "none").text(path)


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length, content)`` of the files in a folder."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def link_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component, for undirected edges ``a - b`` over nodes 0..n-1."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:  # every node points straight at its root
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most n - 1 edges (member, smallest member) with the same components."""
    label = link_labels(n, a, b)
    members = np.flatnonzero(label != np.arange(n))
    return members, label[members]


def batches_of(rows: Iterable, size: int) -> Iterator[list]:
    """``rows`` in lists of ``size``."""
    part: list = []
    for row in rows:
        part.append(row)
        if len(part) >= size:
            yield part
            part = []
    if part:
        yield part


def range_slices(rows: DataFrame, group: str, order_by: list[str], size: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Sort ``rows`` by ``group``, then ``order_by``, over range partitions, so that a large group spreads over many.

    Returns the rows with their partition in ``_slice``, written, as sampled bounds must not change between readings;
    and per group and slice ``_before``, the sum of ``size`` (rows, if none is given) in the group's earlier slices, and
    ``_total``, the group's sum. The second table has at most one row for each group and one for each slice.
    """
    amount = F.lit(1).cast("long") if size is None else F.col(size)
    ranged = rows.repartitionByRange(shuffle_width(rows.sparkSession), group, *order_by)
    ranged = settle(ranged.withColumn("_slice", F.spark_partition_id()))
    per_slice = settle(ranged.groupBy(group, "_slice").agg(F.sum(amount).alias("_sum")))
    whole = Window.partitionBy(group)
    earlier = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = {"_before": F.coalesce(F.sum("_sum").over(earlier), F.lit(0)), "_total": F.sum("_sum").over(whole)}
    return ranged, per_slice.withColumns(sums).drop("_sum")


def join_slices(rows: DataFrame, per_slice: DataFrame, group: str) -> DataFrame:
    """The columns of ``per_slice`` for each row; no key holds more than the rows of one slice."""
    facts = per_slice.withColumnsRenamed({group: "_group", "_slice": "_of"})
    same = (rows["_slice"] == facts["_of"]) & rows[group].eqNullSafe(facts["_group"])
    return rows.join(facts, same).drop("_group", "_of")
