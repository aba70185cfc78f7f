"""From posts of the window to ranked incidents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import urgency as U
from ..functions.text import URGENT_WORDS, cluster_name, has_keyword, incident_key, singleton_name
from ..session import settle
from .components import components
from .scale import HOT_ROWS, running_rank
from .similarity import BLOCK_ROWS, back_to_posts, blocked, border_links, group_links, unit_vector, with_degree
from .sliding import linked_clusters
from .window import WINDOW_MINUTES, moment

LONE_DENSITY = 0.5


def cluster_window(
    df: DataFrame,
    id: str = "seq",
    vec: str = "embedding",
    eps: float = 0.4,
    min_samples: int = 2,
    min_window: int = 3,
    block_rows: int = BLOCK_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Density clustering of the posts on cosine distance.

    Adds ``cluster`` (smallest core id of the cluster, null for noise) and ``is_core``. A
    window of fewer than ``min_window`` posts is all noise.
    """
    blocks = blocked(df, id, vec, eps, block_rows)
    if blocks.posts < min_window:
        return df.withColumns({"cluster": F.lit(None).cast("long"), "is_core": F.lit(False)})

    if min_samples <= 2:
        # Any neighbour makes both ends core, so linking everything and then looking at the
        # size of what it is linked to is the same and saves the counting pass.
        local, links = group_links(blocks, blocks.rows)
        named = _named(local, links, hot_rows)
        sizes = named.groupBy("component").agg(F.sum("copies").alias("size"), F.count(F.lit(1)).alias("vectors"))
        lone_zero = F.forall("vec", lambda e: e == 0) & F.lit(eps < 1)
        is_core = ((F.col("size") >= min_samples) & ~lone_zero) | F.lit(min_samples <= 1)
        # A component that matters for the size is already named, so sizes joins on its name.
        per_vector = named.join(sizes, "component").select(
            "vec",
            F.when(is_core & ~lone_zero, F.col("component")).alias("cluster"),
            is_core.alias("is_core"),
            (is_core & lone_zero).alias("_own"),
        )
    else:
        base = settle(
            with_degree(blocks).withColumn("core", F.col("degree") >= min_samples)
            .select("vec", "rep", "copies", "cell", "block", "shard", "core")
        )
        named = _named(*group_links(blocks, base.filter("core")), hot_rows)
        owned = named.select("rep", "component")
        edges = border_links(blocks, base)
        borders = attach_borders(edges, owned)
        cores = named.select("vec", F.col("component").alias("cluster"), F.lit(True).alias("is_core"))
        others = base.filter("not core").join(borders, "rep", "left")
        per_vector = cores.unionByName(others.select("vec", "cluster", F.lit(False).alias("is_core")))
        per_vector = per_vector.withColumn("_own", F.lit(False))
    placed = back_to_posts(df, vec, blocks.rows if blocks.most >= hot_rows else None, per_vector, hot_rows)
    # Zero vectors are near nothing: where a single post may be a cluster, each is its own.
    return placed.withColumn("cluster", F.when(F.col("_own"), F.col(id)).otherwise(F.col("cluster"))).drop("_own")


def attach_borders(edges: DataFrame, owned: DataFrame) -> DataFrame:
    """``(rep, cluster)`` of non-core points: the first cluster among their core neighbours."""
    return (
        edges.join(owned.withColumnsRenamed({"rep": "core_rep"}), "core_rep")
        .groupBy("rep")
        .agg(F.min("component").alias("cluster"))
    )


def _named(local: DataFrame, links: DataFrame, hot_rows: int) -> DataFrame:
    """Distinct core vectors with the component their shard group belongs to. A shard group
    is at most one shard large, so the join on it has no hot key."""
    groups = components(local.select(F.col("local").alias("id")).distinct(), links, hot_rows)
    return local.join(groups.withColumnRenamed("id", "local"), "local").select("vec", "rep", "copies", "component")


def add_singletons(clustered: DataFrame, id: str = "seq") -> DataFrame:
    """Noise is never dropped: each such post is an incident of its own.

    ``incident`` is the id of the incident's first core post (or of the lone post).
    """
    return clustered.withColumns(
        {"incident": F.coalesce(F.col("cluster"), F.col(id)), "lone": F.col("cluster").isNull()}
    )


def representative(text, seq):
    """Longest text, the earliest on ties (an aggregate)."""
    return F.min_by(F.col(text), F.struct(-F.length(text), F.col(seq)))


def _unit_sums(vec: str):
    """Sum and squares of the unit vectors, combined before the shuffle (an aggregate)."""
    return Summarizer.metrics("sum", "normL2").summary(array_to_vector(unit_vector(vec))).alias("_units")


def _mean_cosine(n: Column, singleton: float) -> Column:
    """Mean cosine over all pairs. The sum over pairs follows from the length of the summed
    unit vectors, so the work is linear in the posts."""
    square = lambda v: F.aggregate(vector_to_array(v), F.lit(0.0), lambda acc, e: acc + e * e)
    pairs = square(F.col("_units.sum")) - square(F.col("_units.normL2"))
    return F.when(n == 1, F.lit(singleton)).otherwise(pairs / (n * (n - 1)))


def cluster_density(df: DataFrame, cluster: str, vec: str, singleton: float = LONE_DENSITY) -> DataFrame:
    """Mean pairwise cosine per cluster; a lone post gets ``singleton``."""
    sums = df.groupBy(cluster).agg(_unit_sums(vec), F.count(F.lit(1)).alias("_n"))
    return sums.select(cluster, _mean_cosine(F.col("_n"), singleton).alias("density"))


def summarise_clusters(
    members: DataFrame,
    as_of,
    words: Sequence[str] = URGENT_WORDS,
    minutes: float = WINDOW_MINUTES,
    normalise: bool = False,
    vec: str = "embedding",
) -> DataFrame:
    """One row per incident: size, first and last post, representative, urgency; one shuffle.

    The texts of the members are a table of their own (``incident_sources``); no aggregate
    here grows with the size of an incident.
    """
    flagged = members.withColumn("_flag", has_keyword("text", words, normalise))
    facts = flagged.groupBy("incident").agg(
        F.first("lone").alias("lone"),
        F.min_by("post_id", "seq").alias("first_post"),
        representative("text", "seq").alias("representative_text"),
        F.count(F.lit(1)).alias("post_count"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        U.keyword_weight("_flag").alias("keyword_weight"),
        _unit_sums(vec),
    )
    scored = facts.withColumns(
        {
            "density": _mean_cosine(F.col("post_count"), LONE_DENSITY),
            "recency_weight": U.recency_weight("last_seen", moment(members, as_of), minutes),
        }
    ).drop("_units")
    scored = scored.withColumn("urgency_score", U.urgency_score("keyword_weight", "density", "recency_weight"))
    return scored.withColumns(
        {"urgency_label": U.urgency_label("urgency_score"), "incident_key": incident_key("first_post")}
    )


def number_clusters(incidents: DataFrame) -> DataFrame:
    """Add ``cluster_id``: clusters are numbered from 0 by their first member, lone posts are
    named after their id. The numbering is a distributed rank."""
    ranked = running_rank(incidents.filter(~F.col("lone")).select("incident"), ["incident"], "_no")
    return (
        incidents.join(ranked, "incident", "left")
        .withColumn(
            "cluster_id",
            F.when(F.col("lone"), singleton_name("first_post")).otherwise(cluster_name(F.col("_no") - 1)),
        )
        .drop("_no")
    )


def cluster_counts(incidents: DataFrame) -> DataFrame:
    lone = F.count_if(F.col("lone"))
    n = F.count(F.lit(1))
    return incidents.agg((n - lone).alias("multi_post"), lone.alias("singletons"), n.alias("total"))


def rank_incidents(incidents: DataFrame, position: str | None = None) -> DataFrame:
    """Most urgent first; equal scores in order of numbering, lone posts after clusters. With ``position`` the rows are
    numbered from 1 in that order, and not sorted as a whole."""
    order = [F.desc("urgency_score"), "lone", "incident"]
    return incidents.orderBy(*order) if position is None else running_rank(incidents, order, position)


def urgency_counts(incidents: DataFrame) -> DataFrame:
    label = F.col("urgency_label")
    return incidents.agg(
        *[F.count_if(label == name).alias(name.lower()) for name in ("CRITICAL", "HIGH", "MODERATE")]
    )


def find_incidents(posts: DataFrame, as_of, eps: float = 0.4, min_samples: int = 2, minutes: float = WINDOW_MINUTES,
                   words: Sequence[str] = URGENT_WORDS, normalise: bool = False,
                   distinct_text: bool = False, links: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Incidents and their members for the posts of an active window.

    ``distinct_text`` counts a resubmitted text once (its earliest post). ``links`` between the posts, kept by
    :func:`~tidewatch.operators.sliding.fresh_links`, save comparing them again; they tell groups of two and more."""
    if distinct_text:
        firsts = posts.groupBy("text").agg(F.min("seq").alias("seq")).select("seq")
        posts = posts.join(firsts, "seq", "left_semi")
    if links is not None and min_samples <= 2 and not distinct_text:
        clustered = linked_clusters(posts, links, min_samples=min_samples)
    else:
        clustered = cluster_window(posts, eps=eps, min_samples=min_samples)
    members = settle(add_singletons(clustered))
    return number_clusters(summarise_clusters(members, as_of, words, minutes, normalise)), members
