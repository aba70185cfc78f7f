"""Batch forms of the streaming rules, and the model hooks."""

from pyspark.sql import functions as F

from ..functions.hooks import embed as embed_texts, tag_entities as tag_texts
from ..functions.text import iso_time
from ..operators.incidents import cluster_counts
from ..streaming.jobs import RefreshSettings, advance_empty_batch as advance, label_window_counts as count_labels
from ..streaming.jobs import refresh_incidents as refresh
from . import sql as S
from .registry import query

SETTINGS = RefreshSettings(eps=S.EPS, minutes=S.MINUTES, words=S.WORDS)


@query(
    f"""SELECT {S.iso("time_bucket(INTERVAL '30 minutes', ts)")} AS window_start, event_type, count(*) AS n FROM events
GROUP BY ALL"""
)
def label_window_counts(t):
    counts = count_labels(t.read("events").select("ts", "event_type"), label="event_type")
    return counts.withColumn("window_start", iso_time("window_start"))


@query(f"WITH RECURSIVE {S.INCIDENTS} SELECT incident, cluster_id, post_count, round(urgency_score, 6) AS urgency_score FROM incidents")
def refresh_incidents(t):
    """The whole refresh of a window, places included."""
    incidents, _ = refresh(t.active, t.as_of, t.gazetteer, SETTINGS)
    return incidents.select("incident", "cluster_id", "post_count", F.round("urgency_score", 6).alias("urgency_score"))


@query(
    f"""WITH RECURSIVE {S.POSTS}, clock AS (SELECT max(ts) + INTERVAL 60 MINUTE AS as_of FROM posts),
active AS (SELECT posts.* FROM posts, clock WHERE ts >= as_of - INTERVAL {S.MINUTES} MINUTE), {S.clusters('active')},
m AS (SELECT coalesce(cluster, seq) AS incident, cluster IS NULL AS lone FROM clustered),
i AS (SELECT incident, any_value(lone) AS lone FROM m GROUP BY incident)
SELECT count(*) FILTER (NOT lone) AS multi_post, count(*) FILTER (lone) AS singletons, count(*) AS total FROM i"""
)
def advance_empty_batch(t):
    """An hour without a kept post."""
    later = t.posts.agg((F.max("ts") + F.expr("INTERVAL 60 MINUTES")).cast("string")).first()[0]
    return cluster_counts(advance(t.posts, later, t.gazetteer, SETTINGS)[0])


@query()
def embed(t):
    vectors = embed_texts(t.documents.select("doc_id", "text"), "text")
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda acc, e: acc + e * e))
    return vectors.select("doc_id", F.size("embedding").alias("dim"), F.round(length, 4).alias("length"))


def capital_words():
    """A stand-in for a tagging model: words that begin with a capital are places."""

    def tag(text):
        return [{"entity_group": "LOC", "word": w, "score": 1.0} for w in text.split() if w[:1].isupper()]

    return tag


@query()
def tag_entities(t):
    tagged = tag_texts(t.documents.select("doc_id", "text"), "text", capital_words)
    return tagged.select("doc_id", F.size("entities").alias("n"), F.get("entities", F.lit(0))["word"].alias("first"))
