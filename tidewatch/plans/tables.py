"""The sample tables seen as the tables of the engine."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import clean_text
from ..operators.features import count_terms, decision_score, document_terms, hard_label, idf, top_vocabulary
from ..operators.incidents import add_singletons, cluster_window, number_clusters, summarise_clusters
from ..operators.window import active_window, latest_moment
from ..session import settle, spread
from .sql import ALIKE, DIM, EPS, INTERCEPT, MINUTES, WORDS


@dataclass
class Tables:
    spark: SparkSession
    folder: str

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        """The long texts, spread over the cores before the text functions run."""
        return spread(self.read("documents"), "doc_id")

    @cached_property
    def posts(self) -> DataFrame:
        """One post per event: the documents in turn as texts, and a vector for every :data:`ALIKE` events in a row, so that
        reports of one thing come close together in time."""
        e, d, v = self.read("events").select("event_id", "ts"), self.documents, self.read("embeddings")
        n_docs, n_vectors = (F.lit(self.read(t).count()) for t in ("documents", "embeddings"))
        at = F.floor(F.col("event_id") / ALIKE)
        keyed = e.withColumns({"_doc": F.try_mod("event_id", n_docs), "_vec": F.try_mod(at, n_vectors)})
        joined = keyed.join(d, keyed["_doc"] == d["doc_id"], "left").join(v, keyed["_vec"] == v["vec_id"], "left")
        none = F.array_repeat(F.lit(0.0).cast("float"), DIM)
        return joined.select(
            F.col("event_id").cast("string").alias("post_id"), F.col("event_id").alias("seq"), F.coalesce("text", F.lit("")).alias("text"),
            "ts", F.coalesce("embedding", none).alias("embedding"), "label",
        )

    @cached_property
    def labelled(self) -> DataFrame:
        d, q = self.documents, self.read("labels").select("doc_id", "quality")
        rows = d.join(q, "doc_id", "left").select(
            "doc_id", "source", F.col("text").alias("raw_text"), F.coalesce("quality", F.lit(0)).alias("label")
        )
        return rows.withColumn("text", clean_text("raw_text"))

    @cached_property
    def training(self) -> DataFrame:
        """The labelled rows whose text is not empty. Spark would move a filter on the cleaned text below the cleaning and clean
        every text twice; it does not move one past an explode."""
        cleaned = self.labelled.withColumnRenamed("text", "_clean").withColumn("text", F.explode(F.array("_clean")))
        return cleaned.filter(F.length("text") > 0).drop("_clean")

    @cached_property
    def corpus(self) -> DataFrame:
        """The training rows, cleaned once for the queries that pass over them several times."""
        return settle(self.training.select("doc_id", "label", "text"))

    @cached_property
    def doc_terms(self) -> DataFrame:
        return document_terms(self.corpus, "doc_id")

    @cached_property
    def vocabulary(self) -> DataFrame:
        return idf(top_vocabulary(count_terms(self.corpus)), self.corpus.count())

    @cached_property
    def weights(self) -> DataFrame:
        """Weights any engine can compute: how much more often a term occurs in positive texts."""
        n1, n0 = self.corpus.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
        held = lambda value: F.sum(F.when(F.col("label") == value, F.col("df")).otherwise(F.lit(0)))
        share = lambda value, n: held(value) / F.lit(float(n))
        contrast = (F.lit(10.0) * (share(1, n1) - share(0, n0))).alias("coef")
        counts = count_terms(self.corpus, by=["label"])
        return settle(idf(top_vocabulary(counts, extra=[contrast]), n1 + n0).select("term", "idf", "coef"))

    @cached_property
    def scored(self) -> DataFrame:
        rows = decision_score(self.corpus, self.weights, INTERCEPT)
        return rows.select("doc_id", "label", F.round("score", 6).alias("score"))

    @cached_property
    def scored_texts(self) -> DataFrame:
        """``scored`` with the texts as they came: cleaned again, which is less than to write them beside the cleaned ones."""
        rows = decision_score(self.training, self.weights, INTERCEPT)
        return rows.select("doc_id", "label", "raw_text", F.round("score", 6).alias("score"))

    @cached_property
    def predicted(self) -> DataFrame:
        return self.scored.withColumn("predicted", hard_label("score"))

    @cached_property
    def as_of(self) -> str:
        return latest_moment(self.posts)

    @cached_property
    def active(self) -> DataFrame:
        return active_window(self.posts, self.as_of, MINUTES)

    @cached_property
    def members(self) -> DataFrame:
        return settle(add_singletons(cluster_window(self.active, eps=EPS)))

    @cached_property
    def incidents(self) -> DataFrame:
        return number_clusters(summarise_clusters(self.members, self.as_of, WORDS, MINUTES))

    @cached_property
    def given_incidents(self) -> DataFrame:
        """Incidents when the label of the vectors is taken as the cluster."""
        members = self.active.withColumns({"incident": F.col("label").cast("long"), "lone": F.lit(False)})
        return summarise_clusters(members, self.as_of, WORDS, MINUTES)

    @cached_property
    def gazetteer(self) -> DataFrame:
        n = F.col("n_nationkey")
        return self.read("nation").select(
            F.lower("n_name").alias("key"),
            (F.lit(8) + F.lit(0.25) * n).alias("lat"),
            (F.lit(77) + F.lit(0.25) * n).alias("lng"),
            F.concat("n_name", F.lit(", region "), F.col("n_regionkey").cast("string")).alias("full_name"),
        )

    @cached_property
    def place_refs(self) -> DataFrame:
        """Place names per customer: misspelt or unknown first, then an exact one twice."""
        nation = F.col("c_nationkey").cast("string")
        other = F.concat(F.lit("Natoin_"), (F.col("c_custkey") % 40).cast("string"))
        return self.read("customer").select(
            F.col("c_custkey").alias("incident"),
            F.array(
                F.when(F.col("c_custkey") % 3 == 0, "Nowhere at all").otherwise(other),
                F.concat(F.lit(" Nation_"), nation, F.lit(" ")),
                F.concat(F.lit("NATION_"), nation),
            ).alias("locations"),
        )
