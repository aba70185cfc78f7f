"""Structured Streaming: the same batch functions over a window kept as a table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.hooks import embed
from ..functions.text import URGENT_WORDS
from ..operators.features import GATE, gate_stats, noise_gate, scored_posts
from ..operators.feed import FEED_COLUMNS, digest, incident_sources
from ..operators.incidents import find_incidents
from ..operators.places import extract_places, geocode
from ..operators.sliding import fresh_links, instant
from ..operators.window import WINDOW_MINUTES, active_window, cutoff, latest_moment, split_late
from ..schemas import POST
from ..session import settle
from ..sources.feed import append_report, committed, forget_resolutions, once_per_batch, publish_feed, read_live, remove_where


@dataclass(frozen=True)
class RefreshSettings:
    """Parameters of the online job; the defaults are the published ones."""

    eps: float = 0.4
    min_samples: int = 2
    minutes: float = WINDOW_MINUTES
    threshold: float = GATE
    words: Sequence[str] = URGENT_WORDS
    normalise: bool = False
    cutoff: float = 0.6
    encoder: Callable | None = None
    dim: int = 256
    extra: dict = field(default_factory=dict)


def stream_posts(spark: SparkSession, path: str, format: str = "parquet", schema=POST, files_per_batch: int = 1):
    """Post files as a stream; every batch takes the next files in order of arrival."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(format).load(path)


def write_window(batch: DataFrame, path: str, batch_id: int) -> None:
    """Append a batch to the window table, partitioned by the minute of its times. A repeated batch
    rewrites exactly its own partitions."""
    stamped = batch.withColumns(
        {"minute": F.floor(F.unix_timestamp("ts") / 60), "batch": F.lit(batch_id).cast("long")}
    )
    (
        stamped.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("minute", "batch")
        .parquet(path)
    )


def window_state(
    spark: SparkSession, path: str, schema, as_of=None, minutes: float = WINDOW_MINUTES, batch: bool = False
) -> DataFrame:
    """Active posts of the window table, if wanted with their ``batch``; whole minutes before the cutoff are not even
    listed for reading."""
    table = spark.read.schema(f"{schema}, minute long, batch long").parquet(path)
    as_of = as_of or latest_moment(table)
    oldest = F.floor(F.unix_timestamp(F.lit(str(as_of)).cast("timestamp")) / 60) - int(minutes) - 1
    active = active_window(table.filter(F.col("minute") >= oldest), as_of, minutes).drop("minute", "stamped")
    return active if batch else active.drop("batch")


LINK = "a long, b long, until long, minute long, batch long"


def write_links(window: DataFrame, path: str, batch_id: int, eps: float) -> None:
    """Append the links that a batch brings to an active window (with ``batch``), partitioned by the minute they end in. A
    repeated batch rewrites its own partitions; a partition that it no longer fills held the same links."""
    links = fresh_links(window.withColumn("fresh", F.col("batch") == batch_id), eps)
    stamped = links.withColumns({"minute": F.floor(F.col("until") / 60_000_000), "batch": F.lit(batch_id).cast("long")})
    stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("minute", "batch").parquet(path)


def active_links(spark: SparkSession, path: str, window: DataFrame, as_of, minutes: float = WINDOW_MINUTES) -> DataFrame:
    """Links whose posts both are in the window."""
    start = spark.range(1).select(cutoff(window, as_of, minutes).alias("ts")).select(instant()).first()[0]
    table = spark.read.schema(LINK).parquet(path)
    return table.filter((F.col("minute") >= start // 60_000_000) & (F.col("until") >= start)).select("a", "b")


def evict_window(spark: SparkSession, path: str, as_of, minutes: float = WINDOW_MINUTES) -> int:
    """Delete the partitions that lie wholly before the window; returns how many."""
    end = spark.range(1).select(F.unix_timestamp(F.lit(str(as_of)).cast("timestamp"))).first()[0]
    oldest = end // 60 - int(minutes) - 1

    def gone(name: str) -> bool:
        minute = name.removeprefix("minute=")
        return minute.lstrip("-").isdigit() and int(minute) < oldest  # posts without a time are in no minute

    return remove_where(spark, path, gone)


def refresh_incidents(
    window: DataFrame, as_of, gaz: DataFrame, settings: RefreshSettings, links: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Incidents with places, and their members, of an active window (batch and stream)."""
    incidents, members = find_incidents(
        window, as_of, settings.eps, settings.min_samples, settings.minutes, settings.words, settings.normalise, links=links
    )
    placed = extract_places(incidents, "incident", "representative_text", gaz)
    return geocode(placed, "incident", "locations", gaz, settings.cutoff), members


def advance_empty_batch(window: DataFrame, as_of, gaz: DataFrame, settings: RefreshSettings):
    """A batch without a kept post still moves the window on and refreshes the feed."""
    return refresh_incidents(active_window(window, as_of, settings.minutes), as_of, gaz, settings)


def incident_stream(
    stream: DataFrame, weights: DataFrame, intercept: float, gaz: DataFrame, out: str, checkpoint: str,
    settings: RefreshSettings = RefreshSettings(), clock: Callable[[DataFrame], str] | None = None, **trigger,
) -> StreamingQuery:
    """Gate, append, retire, cluster, place and publish for every micro-batch.

    ``clock`` gives the moment the window ends at; by default the newest time that a post brought
    itself. Posts without a time, or with one after their arrival, are stamped with the start of their
    batch, which a replay repeats; such times never move the clock, so they retire nothing. Nothing
    is kept in the process: the window, its links, the feed and the counts are tables, each keyed by batch. A batch
    compares its own posts with the window; groups follow from the links, and retired ones are dropped with their minute.
    The clock has to move forward: a post that has retired stays so.
    """
    odd = F.col("ts").isNull() | (F.col("ts") > F.current_timestamp())
    stream = stream.withColumn("stamped", odd).withColumn("ts", F.when(odd, F.current_timestamp()).otherwise(F.col("ts")))
    state = f"{out}/window"
    vectors = "embedding" in stream.columns

    def kept_posts(scored: DataFrame) -> DataFrame:
        kept = noise_gate(scored, "score", settings.threshold).drop("score")
        return kept if vectors else embed(kept, "text", settings.encoder, settings.dim)

    schema = ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in kept_posts(scored_posts(stream, weights, intercept)).schema.fields
    )

    def body(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession

        def write() -> None:
            scored = settle(scored_posts(batch, weights, intercept))
            kept = kept_posts(scored)
            write_window(kept, state, batch_id)
            table = spark.read.schema(f"{schema}, minute long, batch long").parquet(state)
            now = clock(table) if clock else latest_moment(table.filter("not stamped")) or latest_moment(table)
            stats = gate_stats(scored, "score", settings.threshold)
            late = 0 if now is None else split_late(kept.select("ts"), now, settings.minutes).filter("late").count()
            stats = stats.withColumn("late", F.lit(late).cast("long"))
            if now is not None:
                window = window_state(spark, state, schema, now, settings.minutes, batch=True)
                links = None
                if settings.min_samples <= 2:  # more neighbours have to be counted, so those windows are clustered anew
                    write_links(window, f"{out}/links", batch_id, settings.eps)
                    links = active_links(spark, f"{out}/links", window, now, settings.minutes)
                incidents, members = refresh_incidents(window.drop("batch"), now, gaz, settings, links)
                publish_feed(incident_sources(members), out, batch_id, "sources")
                publish_feed(incidents.select(*FEED_COLUMNS, "incident", "lone"), out, batch_id)
                evict_window(spark, state, now, settings.minutes)
                if links is not None:
                    evict_window(spark, f"{out}/links", now, settings.minutes)
                start = spark.range(1).select(cutoff(window, now, settings.minutes).cast("string")).first()[0]
                forget_resolutions(spark, out, start)
            publish_feed(stats, out, batch_id, "gate")

        once_per_batch(spark, out, batch_id, write, "gate")

    writer = stream.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def digest_stream(
    spark: SparkSession, feed: str, out: str, checkpoint: str, max_words: int = 1200, sticky: bool = False, **trigger
) -> StreamingQuery:
    """At every tick of the trigger, by default every 15 minutes, write the digest of the live feed, resolutions taken off,
    whether or not a batch has come since. Ticks without incidents write nothing."""
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()

    def body(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        incidents = read_live(session, feed, sticky)
        if incidents is None or incidents.isEmpty():
            return
        made = session.range(1).select(F.current_timestamp().cast("string")).first()[0]
        append_report(digest(incidents, max_words), out, made, batch_id)

    writer = ticks.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "15 minutes"})).start()


def label_window_counts(
    stream: DataFrame, ts: str = "ts", label: str = "urgency_label", window: str = "30 minutes", late: str = "30 minutes"
) -> DataFrame:
    """Rows per label and window; the watermark bounds the state. Also runs on a batch."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return (
        timed.groupBy(F.window(ts, window).alias("w"), F.col(label))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), label, "n")
    )


__all__ = [
    "RefreshSettings", "advance_empty_batch", "committed", "digest_stream", "evict_window", "incident_stream",
    "label_window_counts", "refresh_incidents", "stream_posts", "window_state", "write_window",
]
