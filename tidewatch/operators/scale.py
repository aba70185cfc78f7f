"""Building blocks that keep skewed keys and global orders distributed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import settle, shuffle_width

# A key with more rows than this is treated apart. A table of N rows has at most
# N / HOT_ROWS such keys, which bounds what hot_key_join broadcasts.
HOT_ROWS = 1_000_000


def hot_key_join(facts: DataFrame, dim: DataFrame, key: Sequence[str], hot: DataFrame | None, how: str = "left"):
    """Join ``facts`` to ``dim`` (unique on ``key``) when a key may hold a large share of ``facts``.

    ``hot`` lists the frequent keys (None if there are none), taken from a count the caller has anyway and cut at
    :data:`HOT_ROWS`, so it is small enough to broadcast. Their fact rows stay where they are;
    all other rows take an ordinary shuffle join.
    """
    key = list(key)
    if hot is None or hot.isEmpty():
        return facts.join(dim, key, how)
    hot = hot.select(*key)
    hot_dim = F.broadcast(hot.join(dim, key, how))
    common = facts.join(hot_dim, key, "inner")
    rest = facts.join(F.broadcast(hot), key, "left_anti").join(dim, key, how)
    return common.unionByName(rest)


def running_totals(
    df: DataFrame,
    order_by: Sequence,
    totals: dict[str, Column],
    within: Sequence[str] = (),
    slices: int | None = None,
) -> DataFrame:
    """Add inclusive running sums along ``order_by`` (inside each ``within`` group).

    The rows are range-partitioned by group and order, so one large group is spread over many
    slices. A slice total per group (at most one row per slice and group) gives the offsets;
    the running sum inside a slice is local. ``order_by`` must be unique inside a group.
    The range-partitioned rows are settled because sampled boundaries must not change between
    the two reads.
    """
    within, order_by = list(within), list(order_by)
    spread = df.repartitionByRange(slices or shuffle_width(df.sparkSession), *within, *order_by)
    spread = spread.withColumn("_slice", F.spark_partition_id())
    spread = settle(spread.withColumns({f"_{name}": value for name, value in totals.items()}))

    by_slice = spread.groupBy(*within, "_slice").agg(*[F.sum(f"_{n}").alias(f"_{n}_slice") for n in totals])
    # One row per slice (and group): the window below never sees the data itself.
    earlier = Window.partitionBy(*(within or [F.lit(0)])).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_slice.select(
        *[F.col(w).alias(f"_{w}_key") for w in within],
        F.col("_slice").alias("_slice_key"),
        *[F.coalesce(F.sum(f"_{n}_slice").over(earlier), F.lit(0)).alias(f"_{n}_before") for n in totals],
    )
    same = spread["_slice"] == offsets["_slice_key"]
    for w in within:
        same = same & spread[w].eqNullSafe(offsets[f"_{w}_key"])
    local = Window.partitionBy(*within, "_slice").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    summed = spread.join(offsets, same).withColumns(
        {n: F.sum(f"_{n}").over(local) + F.col(f"_{n}_before") for n in totals}
    )
    return summed.select(*[c for c in df.columns if c not in totals], *totals)


def running_rank(df: DataFrame, order_by: Sequence, name: str = "rank", within: Sequence[str] = (), slices=None):
    """1-based position along ``order_by``, distributed as in :func:`running_totals`."""
    return running_totals(df, order_by, {name: F.lit(1).cast("long")}, within, slices)


def hash_share(*parts: Column) -> Column:
    """A stable number in [0, 1) from the md5 of the joined parts."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
