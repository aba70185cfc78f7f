"""Schemas of the tables that cross a file or stream boundary."""

from pyspark.sql import types as T

POST = T.StructType(
    [
        T.StructField("post_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("ts", T.TimestampType()),
    ]
)

LABELLED_CSV = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("keyword", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("target", T.IntegerType()),
    ]
)

PLACE = T.StructType(
    [
        T.StructField("lat", T.DoubleType()),
        T.StructField("lng", T.DoubleType()),
        T.StructField("full_name", T.StringType()),
    ]
)

ENTITY = T.StructType(
    [
        T.StructField("entity_group", T.StringType()),
        T.StructField("word", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)

# One row per incident in a published feed. The member posts are a table of their own
# (MEMBER), so that an incident of any size stays one narrow row.
INCIDENT = T.StructType(
    [
        T.StructField("incident_key", T.StringType()),
        T.StructField("cluster_id", T.StringType()),
        T.StructField("representative_text", T.StringType()),
        T.StructField("post_count", T.LongType()),
        T.StructField("first_seen", T.TimestampType()),
        T.StructField("last_seen", T.TimestampType()),
        T.StructField("urgency_score", T.DoubleType()),
        T.StructField("urgency_label", T.StringType()),
        T.StructField("locations", T.ArrayType(T.StringType())),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lng", T.DoubleType()),
        T.StructField("resolved_location", T.StringType()),
    ]
)

MEMBER = T.StructType(
    [
        T.StructField("incident_key", T.StringType()),
        T.StructField("position", T.LongType()),
        T.StructField("text", T.StringType()),
    ]
)


def require_columns(df, columns):
    """Raise a clear error when any of ``columns`` is missing; otherwise return ``df``."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {missing}; the table has {df.columns}")
    return df
