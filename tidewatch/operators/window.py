"""The rolling window of recent posts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

WINDOW_MINUTES = 30


def moment(df: DataFrame, as_of, ts: str = "ts") -> Column:
    """``as_of`` (datetime or ISO text) as a literal of the type of ``df[ts]``.

    A literal of the column's own type is what lets the cutoff reach the Parquet reader.
    """
    text = as_of.isoformat(sep=" ") if isinstance(as_of, dt.datetime) else str(as_of)
    return F.lit(text).cast(df.schema[ts].dataType)


def latest_moment(df: DataFrame, ts: str = "ts") -> str:
    """Newest timestamp as text (one row reaches the driver)."""
    return df.agg(F.max(ts).cast("string")).first()[0]


def cutoff(df: DataFrame, as_of, minutes: float = WINDOW_MINUTES, ts: str = "ts") -> Column:
    return moment(df, as_of, ts) - F.expr(f"INTERVAL {int(minutes * 60)} SECONDS")


def append_window(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Add a batch to the window; resubmitted posts count again."""
    return state.unionByName(batch)


def active_window(df: DataFrame, as_of, minutes: float = WINDOW_MINUTES, ts: str = "ts") -> DataFrame:
    """Posts not older than ``minutes`` at ``as_of``, the bound included."""
    return df.filter(F.col(ts) >= cutoff(df, as_of, minutes, ts))


def split_late(df: DataFrame, as_of, minutes: float = WINDOW_MINUTES, ts: str = "ts") -> DataFrame:
    """Mark posts that arrive older than the window and so retire at once."""
    return df.withColumn("late", F.col(ts) < cutoff(df, as_of, minutes, ts))


def window_counts(df: DataFrame, as_of, minutes: float = WINDOW_MINUTES, ts: str = "ts") -> DataFrame:
    active = F.count_if(F.col(ts) >= cutoff(df, as_of, minutes, ts))
    return df.agg(active.alias("active"), (F.count(F.lit(1)) - active).alias("retired"))
