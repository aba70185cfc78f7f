"""Published snapshots of the incident feed, the log of resolutions and the report log.

A snapshot is written first and committed by a one-row table afterwards; both are keyed by the
batch, so a repeated batch overwrites itself. Readers follow the newest commit. Snapshots and commits some batches behind
the newest are removed, so what a reader or a batch looks at does not grow with the age of the stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.feed import resolution_report
from ..session import settle

COMMIT = "batch_id long, rows long"
KEPT_SNAPSHOTS = 10  # a reader has so many batches' time to finish
RESOLUTION = "incident_key string, cluster_id string, last_seen timestamp, resolved_at timestamp, batch long"


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def remove_where(spark: SparkSession, path: str, gone: Callable[[str], bool]) -> int:
    """Delete the entries of a folder whose name ``gone`` accepts, on any file system Spark can write to; returns how many."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return 0
    found = [entry.getPath() for entry in files.listStatus(root) if gone(entry.getPath().getName())]
    for entry in found:
        files.delete(entry, True)
    return len(found)


def _older(prefix: str, batch_id: int) -> Callable[[str], bool]:
    def gone(name: str) -> bool:
        number = name.removeprefix(prefix)
        return name.startswith(prefix) and number.isdigit() and int(number) < batch_id

    return gone


def publish_feed(df: DataFrame, path: str, batch_id: int, table: str = "incidents", keep: int = KEPT_SNAPSHOTS) -> None:
    """Replace the whole snapshot by ``df``; the ``keep`` newest ones stay."""
    target = f"{path}/{table}/batch={batch_id}"
    df.write.mode("overwrite").parquet(target)
    rows = df.sparkSession.read.schema(df.schema).parquet(target).count()
    commit = df.sparkSession.range(1).select(
        F.lit(batch_id).cast("long").alias("batch_id"), F.lit(rows).cast("long").alias("rows")
    )
    commit.write.mode("overwrite").parquet(f"{path}/commits/{table}-{batch_id}")
    oldest = batch_id - keep + 1
    remove_where(df.sparkSession, f"{path}/{table}", _older("batch=", oldest))
    remove_where(df.sparkSession, f"{path}/commits", _older(f"{table}-", oldest))


def committed(spark: SparkSession, path: str, table: str = "incidents") -> DataFrame:
    """The commits of the snapshots that are kept."""
    commits = spark.read.schema(COMMIT).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    try:
        return commits.parquet(f"{path}/commits/{table}-*")
    except AnalysisException:
        return spark.createDataFrame([], COMMIT)


def read_feed(spark: SparkSession, path: str, table: str = "incidents") -> DataFrame | None:
    """The newest committed snapshot, None before the first one."""
    newest = newest_batch(spark, path, table)
    return None if newest is None else spark.read.parquet(f"{path}/{table}/batch={newest}")


def newest_batch(spark: SparkSession, path: str, table: str = "incidents") -> int | None:
    return committed(spark, path, table).agg(F.max("batch_id")).first()[0]


def _resolutions(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(RESOLUTION).parquet(f"{path}/resolutions")
    except AnalysisException:
        return spark.createDataFrame([], RESOLUTION)


def read_live(spark: SparkSession, path: str, sticky: bool = False) -> DataFrame | None:
    """The newest snapshot without the incidents resolved in it, None before the first one.

    As published, a resolution holds for the snapshot it was made on, and the next batch shows what its window holds.
    ``sticky=True`` keeps an incident away, by its stable key, until a post newer than those it had joins it.
    """
    newest = newest_batch(spark, path)
    if newest is None:
        return None
    snapshot = spark.read.parquet(f"{path}/incidents/batch={newest}")
    log = _resolutions(spark, path).filter(F.col("batch") <= newest)
    done = log.groupBy("incident_key").agg(F.max("batch").alias("_batch"), F.max("last_seen").alias("_seen"))
    done = done.withColumnRenamed("incident_key", "_key")
    away = F.col("_batch") == newest
    if sticky:
        away = away | (F.col("last_seen").cast("timestamp") <= F.col("_seen"))
    return snapshot.join(done, (F.col("incident_key") == F.col("_key")) & away, "left_anti")


def _log_resolved(spark: SparkSession, path: str, gone: DataFrame, batch: int, request: str) -> None:
    """Append to the log under the snapshot's batch. A repeated request finds its incidents gone and adds nothing; the first
    one stays."""
    rows = gone.select(
        "incident_key", "cluster_id", F.col("last_seen").cast("timestamp").alias("last_seen"),
        F.current_timestamp().alias("resolved_at"),
    )
    rows.write.mode("append").parquet(f"{path}/resolutions/batch={batch}/request={request}")


def resolve_incidents(spark: SparkSession, path: str, cluster_ids: DataFrame, request: str, sticky: bool = False) -> DataFrame:
    """Take the incidents named in ``cluster_ids(cluster_id)`` out of the live feed. Returns, per name, whether there was
    one, and the message about it. ``request`` is a name of the caller's choice; the same request twice counts once."""
    live = read_live(spark, path, sticky)
    if live is None:
        return resolution_report(spark.createDataFrame([], "cluster_id string"), cluster_ids)
    live = settle(live.select("incident_key", "cluster_id", "last_seen"))
    gone = live.join(cluster_ids.select("cluster_id").distinct(), "cluster_id", "left_semi")
    _log_resolved(spark, path, gone, newest_batch(spark, path), request)
    return resolution_report(live, cluster_ids)


def clear_feed(spark: SparkSession, path: str, request: str, sticky: bool = False) -> int:
    """Take all incidents out of the live feed; returns how many there were."""
    live = read_live(spark, path, sticky)
    if live is None:
        return 0
    live = settle(live.select("incident_key", "cluster_id", "last_seen"))
    _log_resolved(spark, path, live, newest_batch(spark, path), request)
    return live.count()


def forget_resolutions(spark: SparkSession, path: str, before) -> int:
    """Remove the entries of those batches in which no incident had a post from ``before`` on: all its posts have retired."""
    log = _resolutions(spark, path).groupBy("batch").agg(F.max("last_seen").alias("last"))
    old = {r["batch"] for r in log.filter(F.col("last") < F.lit(str(before)).cast("timestamp")).collect()}
    newest = newest_batch(spark, path)
    return remove_where(spark, f"{path}/resolutions", lambda name: name in {f"batch={b}" for b in old if b != newest})


def once_per_batch(spark: SparkSession, path: str, batch_id: int, write: Callable[[], None], table: str) -> bool:
    """Run ``write`` unless this batch or a later one is already committed; says whether it ran."""
    newest = newest_batch(spark, path, table)
    if newest is not None and newest >= batch_id:
        return False
    write()
    return True


def append_report(lines: DataFrame, path: str, report_ts: str, batch_id: int) -> None:
    """Append a digest (``line_no, line``) under the time it was made."""
    stamped = lines.withColumn("report_ts", F.lit(report_ts).cast("timestamp"))
    stamped.write.mode("overwrite").parquet(f"{path}/report={batch_id}")


def latest_report(reports: DataFrame, ts: str = "report_ts") -> DataFrame:
    """The newest report, or an empty one when there is none yet."""
    return reports.agg(
        F.coalesce(F.max_by("report", ts), F.lit("")).alias("report"), F.max(ts).alias("generated")
    )


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """One row per report. A report is bounded by its word budget, so its lines are one group."""
    log = _read(spark, path)
    if log is None:
        return spark.createDataFrame([], "report string, report_ts timestamp")
    ordered = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    return log.groupBy("report", "report_ts").agg(
        F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text")
    ).select(F.col("text").alias("report"), "report_ts")
