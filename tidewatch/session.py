"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "tidewatch", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    A folder of our own is set only where the session names none and runs in local mode:
    on a cluster a machine-local folder would be lost with its executor.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if context.master != "local" and not context.master.startswith("local["):  # not "local-cluster[...]"
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="tidewatch-checkpoint-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and read it from there afterwards.

    Used where a result is read several times (iterations) or must not change between two
    reads (sampled range boundaries); it also bounds what a lost executor can undo.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As :func:`settle`, in compressed columns: for tables with whole texts, which take a quarter of the disk that way and are
    read by column. What was shuffled for it is removed at once."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/stored-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def unsized(settled: DataFrame) -> DataFrame:
    """A settled table without the size that Spark estimated for it. The estimate of a join is the product of its sides, a
    checkpoint keeps it, and so its digits multiply in every round of a loop until the driver does nothing else."""
    spark = settled.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(settled._jdf.javaRDD(), settled._jdf.schema()), spark)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use every core for a scan of few large row groups; a scan with enough splits is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
