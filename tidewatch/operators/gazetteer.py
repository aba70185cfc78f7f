"""Building the gazetteer from aliases and a table of coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def canonical_aliases(aliases: DataFrame) -> DataFrame:
    """One query per lower-cased key; of repeated keys the last one counts."""
    return aliases.groupBy(F.lower("key").alias("key")).agg(F.max_by("query", "seq").alias("query"))


def build_gazetteer(aliases: DataFrame, coords: DataFrame) -> DataFrame:
    """``(key, lat, lng, full_name)`` of the aliases whose query has coordinates."""
    return canonical_aliases(aliases).join(coords, "query").select(
        "key", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "full_name"
    )


def resume_gazetteer(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """What is still to be resolved."""
    return wanted.join(existing.select("key"), "key", "left_anti").select(*wanted.columns)


def extend_gazetteer(existing: DataFrame, aliases: DataFrame, coords: DataFrame) -> DataFrame:
    """The existing entries and those found for the missing keys."""
    return existing.unionByName(build_gazetteer(resume_gazetteer(existing, aliases), coords))


def alias_status(wanted: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Per key: skipped (known before), resolved (new) or failed."""
    old = before.select("key").distinct().withColumn("_old", F.lit(True))
    new = after.select("key").distinct().withColumn("_new", F.lit(True))
    status = F.when(F.col("_old"), "skipped").when(F.col("_new"), "resolved").otherwise("failed")
    return wanted.join(old, "key", "left").join(new, "key", "left").select("key", "query", status.alias("status"))


def gazetteer_report(wanted: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    counted = alias_status(wanted, before, after)
    n = lambda name: F.count_if(F.col("status") == name).alias(name)
    return counted.agg(n("resolved"), n("skipped"), n("failed"), F.count(F.lit(1)).alias("wanted"))


def failed_aliases(wanted: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    return alias_status(wanted, before, after).filter(F.col("status") == "failed").select("key", "query")
