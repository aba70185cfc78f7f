"""Documents to training sequences: toxicity, near duplicates, benchmark passages, packing. Part of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.llm import decontaminate, packing, simhash, toxicity
from tidewatch.llm.common import read_table, shared_path
from tidewatch.llm.tokens import public_path
from tidewatch.session import settle


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number for each row in ``_row``, written, so that every reading has the same; ids may repeat or be null."""
    path = shared_path(docs.sparkSession, "rows")
    docs.withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def by_row(rows: DataFrame) -> DataFrame:
    """The texts for an operator, with the row number in the place of the id."""
    return rows.select(F.col("_row").alias("doc_id"), "text")


def keep_rows(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows whose number is the ``doc_id`` of a row of ``kept``."""
    return rows.join(kept.select(F.col("doc_id").alias("_row")), "_row", "left_semi").drop("_row")


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Without the documents that the toxicity operator rejects; each row is judged by its own text."""
    rows = numbered(docs)
    model = toxicity.fit_on(rows, read_table(spark, folder, "labels").filter(~toxicity.held_out()))
    found = settle(toxicity.score_documents(by_row(rows), model))
    return keep_rows(rows, found.filter("score < 0.7"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The row with the smallest id, then number, of each group of near duplicates; null counts as the largest id."""
    rows = numbered(docs)
    groups = settle(simhash.simhash_groups(by_row(rows)).select(F.col("doc_id").alias("_row"), "component_id"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    first = rows.select("_row", "doc_id").join(groups, "_row").groupBy("component_id").agg(F.min(order).alias("first"))
    return keep_rows(rows, settle(first.select(F.col("first._row").alias("doc_id"))))


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Without the documents that hold a benchmark window; each row is judged by its own text."""
    rows = numbered(docs)
    found = settle(decontaminate.contamination(by_row(rows), read_table(spark, folder, "benchmark")))
    return keep_rows(rows, found.filter("not contaminated"))


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The pieces of the documents with their sequences."""
    return packing.pack_documents(docs, public_path("word_bpe_49k.json"), 0)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", one_of_each_group),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

# The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written as Parquet to the shared folder and read again by the next stage."""
    docs = read_table(spark, sf_dir, "documents")
    path = shared_path(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{k}-{name}")
        docs = spark.read.parquet(f"{path}/{k}-{name}")
    return docs
