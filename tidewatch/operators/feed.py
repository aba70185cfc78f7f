"""The published incident feed, its views and the digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import incident_line, ws_tokens
from ..session import settle
from .scale import running_rank

FEED_COLUMNS = (
    "incident_key", "cluster_id", "representative_text", "post_count", "first_seen", "last_seen",
    "urgency_score", "urgency_label", "locations", "lat", "lng", "resolved_location",
)

# "INCIDENT", number, label, "at", place, count and "reports)": no digest line is shorter.
MIN_LINE_WORDS = 7


def tier(label):
    return F.when(label == "CRITICAL", 0).when(label == "HIGH", 1).otherwise(2)


def tier_order(df: DataFrame, position: str | None = None) -> DataFrame:
    """Urgent tier first, larger incidents first inside a tier; equal ones as ranked before. With ``position`` the rows are
    numbered from 1 in that order, and not sorted as a whole."""
    return df.orderBy(*_tier_keys()) if position is None else running_rank(df, _tier_keys(), position)


def _tier_keys():
    return [tier(F.col("urgency_label")), F.desc("post_count"), F.desc("urgency_score"), "lone", "incident"]


def incident_feed(snapshots: DataFrame, batch: str = "batch_id") -> DataFrame:
    """All fields of the newest snapshot. Snapshots are partitioned by batch, so reading the
    newest prunes to its files."""
    newest = snapshots.agg(F.max(batch)).first()[0]
    return snapshots.filter(F.col(batch) == F.lit(newest)).select(*[c for c in FEED_COLUMNS if c in snapshots.columns])


def map_points(df: DataFrame, base: float = 8, scale: float = 1.5) -> DataFrame:
    """Incidents with both coordinates and the size of their marker."""
    return df.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull()).withColumn(
        "radius", F.lit(float(base)) + F.col("post_count") * F.lit(float(scale))
    )


def map_summary(df: DataFrame) -> DataFrame:
    placed = F.count_if(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    n = F.count(F.lit(1))
    return df.agg(
        placed.alias("plotted"),
        n.alias("total"),
        F.concat(placed.cast("string"), F.lit(" / "), n.cast("string"), F.lit(" plotted")).alias("caption"),
    )


def incident_sources(members: DataFrame) -> DataFrame:
    """Every post of every incident with its 1-based position in order of arrival.

    The long form of the source list: an incident of any size stays spread over tasks. Only
    the ids are ranked; the texts move once, for the join on the unique id.
    """
    ranked = running_rank(members.select("incident", "seq"), ["seq"], "position", within=["incident"])
    texts = members.select("seq", "text")
    return ranked.join(texts, "seq").select("incident", "position", "seq", "text")


def source_chunks(sources: DataFrame, size: int = 1000) -> DataFrame:
    """The source list as arrays of at most ``size`` texts in order, ``chunk`` 0, 1, ..."""
    grouped = sources.withColumn("chunk", F.floor((F.col("position") - 1) / size)).groupBy("incident", "chunk")
    ordered = F.sort_array(F.collect_list(F.struct("position", "text")))
    return grouped.agg(F.transform(ordered, lambda x: x["text"]).alias("texts"))


def extra_reports(incidents: DataFrame) -> DataFrame:
    """Incidents that can be expanded, with the number of further reports."""
    return incidents.filter(F.col("post_count") > 1).withColumn("more", F.col("post_count") - 1)


def resolve(snapshot: DataFrame, resolutions: DataFrame, sticky: bool = False) -> DataFrame:
    """Drop resolved incidents.

    As published, the name of the incident in this snapshot decides. ``sticky=True`` uses the
    stable key and keeps an incident away until a post newer than the resolution joins it.
    """
    if not sticky:
        return snapshot.join(resolutions.select("cluster_id"), "cluster_id", "left_anti").select(*snapshot.columns)
    done = resolutions.groupBy("incident_key").agg(F.max("resolved_at").alias("resolved_at"))
    same = (snapshot["incident_key"] == done["incident_key"]) & (snapshot["last_seen"] <= done["resolved_at"])
    return snapshot.join(done, same, "left_anti")


def resolution_report(snapshot: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Whether each requested incident existed, and the message about it."""
    known = snapshot.select("cluster_id").distinct().withColumn("removed", F.lit(True))
    asked = resolutions.select("cluster_id").distinct().join(known, "cluster_id", "left")
    removed = F.coalesce("removed", F.lit(False))
    note = F.when(removed, "resolved").otherwise("not found")
    return asked.select(
        "cluster_id", removed.alias("removed"), F.concat_ws(" ", F.lit("Cluster"), "cluster_id", note).alias("message")
    )


def clear_incidents(snapshot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An empty snapshot of the same shape, and how many incidents it replaces."""
    return snapshot.filter(F.lit(False)), snapshot.agg(F.count(F.lit(1)).alias("removed"))


def digest(incidents: DataFrame, max_words: int = 1200) -> DataFrame:
    """Digest lines ``(line_no, line)`` under a word budget, then a line with what is left out.

    A line has at least ``MIN_LINE_WORDS`` words, so only the first ``max_words / 7`` incidents
    can be in the digest. Those are found by a distributed top-k; the running word count over
    these few rows finds where the budget is first exceeded.
    """
    most = max_words // MIN_LINE_WORDS + 1
    used = ["urgency_label", "post_count", "urgency_score", "lone", "incident", "resolved_location", "representative_text"]
    incidents = settle(incidents.select(*used))  # read for the lines and for the count
    first = settle(tier_order(incidents).limit(most))
    order = Window.partitionBy(F.lit(0)).orderBy(*_tier_keys())
    numbered = first.withColumn("line_no", F.row_number().over(order))
    lines = numbered.withColumn(
        "line",
        incident_line("line_no", "urgency_label", "resolved_location", "representative_text", "post_count"),
    ).withColumn("words", F.size(ws_tokens("line")))
    budget = Window.partitionBy(F.lit(0)).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    kept = lines.withColumn("used", F.sum("words").over(budget)).filter(F.col("used") <= max_words)
    total = incidents.agg(F.count(F.lit(1)).alias("n"))
    shown = kept.agg(F.count(F.lit(1)).alias("kept"))
    # Two one-row tables.
    rest = total.join(F.broadcast(shown)).filter(F.col("n") > F.col("kept"))
    note = rest.select(
        (F.col("kept") + 1).cast("int").alias("line_no"),
        F.concat(F.lit("["), (F.col("n") - F.col("kept")).cast("string"), F.lit(" additional incidents not shown]")).alias(
            "line"
        ),
    )
    return kept.select("line_no", "line").unionByName(note)


def digest_ticks(df: DataFrame, every: str = "15 minutes", ts: str = "ts") -> DataFrame:
    """Intervals of the digest that have something to report."""
    tick = F.window(F.col(ts).cast("timestamp"), every)
    return df.groupBy(tick.alias("w")).agg(F.count(F.lit(1)).alias("n_posts")).select(
        F.col("w.start").alias("tick_start"), F.col("w.end").alias("tick_end"), "n_posts"
    )


def service_status(active: DataFrame, window: DataFrame, gaz: DataFrame | None, model: DataFrame | None) -> DataFrame:
    """Sizes of the live tables and whether everything that is needed is present."""

    def size(df: DataFrame | None, name: str) -> DataFrame:
        spark = active.sparkSession
        if df is None:
            return spark.range(1).select(F.lit(name).alias("item"), F.lit(0).cast("long").alias("n"))
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("item"), "n")

    sizes = size(active, "active_incidents")
    for df, name in ((window, "window_size"), (gaz, "gazetteer_size"), (model, "model_terms")):
        sizes = sizes.unionByName(size(df, name))
    value = lambda name: F.max(F.when(F.col("item") == name, F.col("n")))
    present = gaz is not None and model is not None
    return sizes.agg(
        value("active_incidents").alias("active_incidents"),
        value("window_size").alias("window_size"),
        value("gazetteer_size").alias("gazetteer_size"),
        F.when(F.lit(present) & (value("gazetteer_size") > 0) & (value("model_terms") > 0), "healthy")
        .otherwise("degraded")
        .alias("overall"),
    )
