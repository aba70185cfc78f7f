"""The rolling window, clustering and urgency."""

from pyspark.sql import functions as F

from ..functions import urgency as U
from ..functions.text import has_keyword, iso_time
from ..operators import incidents as I, similarity as N, sliding as L, window as W
from ..operators.components import components as connect
from . import sql as S
from .registry import query

R = lambda c: F.round(c, 6).alias(c)


@query(
    "SELECT event_id, ts, event_type FROM events UNION ALL SELECT event_id + 1000000000, ts + INTERVAL 1 DAY, "
    "event_type FROM events WHERE event_type = 'click'"
)
def append_window(t):
    state = t.read("events").select("event_id", "ts", "event_type")
    batch = state.filter("event_type = 'click'").select(
        (F.col("event_id") + 1000000000).alias("event_id"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"), "event_type"
    )
    return W.append_window(state, batch)


@query(
    "SELECT event_id, ts, event_type FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 360 MINUTE"
)
def active_window(t):
    events = t.read("events").select("event_id", "ts", "event_type")
    return W.active_window(events, W.latest_moment(events), 360)


@query(
    """WITH c AS (SELECT max(ts) - INTERVAL 360 MINUTE AS cut FROM events)
SELECT count(*) FILTER (ts >= cut) AS active, count(*) FILTER (ts < cut) AS retired FROM events, c"""
)
def window_counts(t):
    events = t.read("events").select("ts")
    return W.window_counts(events, W.latest_moment(events), 360)


@query("SELECT event_id, ts < (SELECT max(ts) FROM events) - INTERVAL 360 MINUTE AS late FROM events")
def split_late(t):
    events = t.read("events").select("event_id", "ts")
    return W.split_late(events, W.latest_moment(events), 360).select("event_id", "late")


VECTORS = "vectors AS (SELECT vec_id AS seq, embedding::DOUBLE[] AS embedding FROM embeddings)"


@query(
    f"""WITH {VECTORS}, {S.unit('vectors', 'x')}
SELECT seq, d, round(v, 6) AS v FROM (SELECT seq, unnest(u) AS v, generate_subscripts(u, 1) - 1 AS d FROM x)"""
)
def unit_vector(t):
    rows = t.read("embeddings").select(F.col("vec_id").alias("seq"), F.posexplode(N.unit_vector("embedding")).alias("d", "v"))
    return rows.withColumn("v", F.round("v", 6))


def vectors(t):
    return t.read("embeddings").select(F.col("vec_id").alias("seq"), "embedding")


@query(f"WITH RECURSIVE {VECTORS}, {S.clusters('vectors')} SELECT seq, neighbours FROM degree")
def neighbour_counts(t):
    return N.neighbour_counts(vectors(t), "seq", "embedding", S.EPS)


@query(f"WITH RECURSIVE {VECTORS}, {S.clusters('vectors')} SELECT seq, neighbours, neighbours >= 2 AS core FROM degree")
def core_points(t):
    return N.core_points(N.neighbour_counts(vectors(t), "seq", "embedding", S.EPS), min_samples=3)


@query(
    """WITH RECURSIVE edges AS (
  SELECT doc_id AS a, doc_id + 1 AS b FROM documents WHERE n_chars % 5 <> 0 AND doc_id + 1 IN (SELECT doc_id FROM documents)),
twice AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges),
reach(i, j) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.i, e.b FROM reach r JOIN twice e ON e.a = r.j)
SELECT i AS id, min(j) AS component FROM reach GROUP BY i"""
)
def components(t):
    """Runs of neighbouring documents: long chains, the hard case for propagation."""
    docs = t.documents.select(F.col("doc_id").alias("id"), "n_chars")
    edges = docs.filter("n_chars % 5 <> 0").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    edges = edges.join(docs.select(F.col("id").alias("b")), "b", "left_semi")
    return connect(docs.select("id"), edges)


@query(
    f"WITH RECURSIVE {VECTORS}, {S.clusters('vectors')} SELECT seq, cluster, is_core FROM clustered"
)
def cluster_window(t):
    return I.cluster_window(vectors(t), eps=S.EPS).select("seq", "cluster", "is_core")


@query(
    f"WITH RECURSIVE {VECTORS}, {S.clusters('vectors', 0.65, 4)} SELECT seq, cluster, is_core FROM clustered"
)
def attach_borders(t):
    """Three or more neighbours make a core: the case with border posts."""
    return I.cluster_window(vectors(t), eps=0.65, min_samples=4).select("seq", "cluster", "is_core")


@query(f"WITH RECURSIVE {S.ACTIVE}, {S.clusters('active')} SELECT seq, cluster, is_core FROM clustered")
def sliding_window(t):
    """The window as three batches left it, the last one with late posts; groups follow from the links of each batch."""
    posts = t.posts.select("seq", "embedding", "ts").withColumn("batch", F.when(F.col("seq") % 7 == 0, 2).otherwise(F.pmod("seq", F.lit(2))))
    links = None
    for batch in range(3):
        so_far = posts.filter(F.col("batch") <= batch)
        window = W.active_window(so_far, t.as_of, S.MINUTES).withColumn("fresh", F.col("batch") == batch)
        new = L.fresh_links(window, S.EPS)
        links = new if links is None else links.unionByName(new)
    active = W.active_window(posts, t.as_of, S.MINUTES)
    return L.linked_clusters(active, links).select("seq", "cluster", "is_core")


@query(f"WITH RECURSIVE {S.INCIDENTS} SELECT seq, incident, lone FROM members")
def add_singletons(t):
    return t.members.select("seq", "incident", "lone")


@query(
    f"""WITH RECURSIVE {S.POSTS}, clock AS (SELECT max(ts) AS as_of FROM posts),
active AS (SELECT posts.* FROM posts, clock WHERE ts >= as_of - INTERVAL 30 MINUTE), {S.clusters('active')}
SELECT seq, CASE WHEN (SELECT count(*) FROM active) >= 3 THEN cluster END AS cluster FROM clustered"""
)
def small_window(t):
    """The published half hour, which may hold too few posts to cluster."""
    return I.cluster_window(W.active_window(t.posts, t.as_of), eps=S.EPS).select("seq", "cluster")


@query(f"WITH RECURSIVE {S.INCIDENTS} SELECT incident, cluster_id, incident_key FROM incidents")
def number_clusters(t):
    return t.incidents.select("incident", "cluster_id", "incident_key")


@query(
    f"""WITH RECURSIVE {S.INCIDENTS} SELECT incident, representative_text, post_count, {S.iso('first_seen')} AS first_seen,
  {S.iso('last_seen')} AS last_seen, round(keyword_weight, 6) AS keyword_weight, round(density, 6) AS density,
  round(recency_weight, 6) AS recency_weight, round(urgency_score, 6) AS urgency_score, urgency_label FROM incidents"""
)
def summarise_clusters(t):
    return t.incidents.select(
        "incident", "representative_text", "post_count", iso_time("first_seen").alias("first_seen"),
        iso_time("last_seen").alias("last_seen"), R("keyword_weight"), R("density"), R("recency_weight"),
        R("urgency_score"), "urgency_label",
    )


G = f"WITH {S.GIVEN}"


@query(f"{G} SELECT incident, representative_text FROM facts")
def representative(t):
    posts = t.active.groupBy(F.col("label").cast("long").alias("incident"))
    return posts.agg(I.representative("text", "seq").alias("representative_text"))


@query(f"{G} SELECT incident, round(density, 6) AS density FROM weighed")
def cluster_density(t):
    members = t.active.withColumn("incident", F.col("label").cast("long"))
    return I.cluster_density(members, "incident", "embedding").withColumn("density", F.round("density", 6))


@query(
    f"WITH RECURSIVE {S.INCIDENTS} SELECT count(*) FILTER (NOT lone) AS multi_post, count(*) FILTER (lone) AS singletons, "
    "count(*) AS total FROM incidents"
)
def cluster_counts(t):
    return I.cluster_counts(t.incidents)


@query(f"{G} SELECT incident, round(keyword_weight, 6) AS keyword_weight FROM facts")
def keyword_weight(t):
    flagged = t.active.withColumn("flag", has_keyword("text", S.WORDS))
    return flagged.groupBy(F.col("label").cast("long").alias("incident")).agg(
        F.round(U.keyword_weight("flag"), 6).alias("keyword_weight")
    )


@query(
    """WITH c AS (SELECT max(ts) AS as_of FROM events)
SELECT event_id, round(greatest(0.0, 1.0 - date_diff('microsecond', ts, as_of) / 1e6 / 1800.0), 6) AS recency
FROM events, c"""
)
def recency_weight(t):
    events = t.read("events").select("event_id", "ts")
    now = W.moment(events, W.latest_moment(events))
    return events.select("event_id", F.round(U.recency_weight("ts", now), 6).alias("recency"))


SCORE = "least(greatest(0.4 * (value - floor(value)) + 0.4 * (user_id % 11 / 10.0) + 0.2 * (event_id % 7 / 4.0), 0.0), 1.0)"


@query(f"SELECT event_id, round({SCORE}, 6) AS score FROM events")
def urgency_score(t):
    return scores(t).select("event_id", F.round("score", 6).alias("score"))


def scores(t):
    keyword = F.col("value") - F.floor("value")
    return t.read("events").withColumn(
        "score", U.urgency_score(keyword, (F.col("user_id") % 11) / 10.0, (F.col("event_id") % 7) / 4.0)
    )


@query(
    f"""SELECT event_id, CASE WHEN s >= 0.7 THEN 'CRITICAL' WHEN s >= 0.4 THEN 'HIGH' ELSE 'MODERATE' END AS label
FROM (SELECT event_id, round({SCORE}, 3) AS s FROM events)"""
)
def urgency_label(t):
    rounded = scores(t).withColumn("score", F.round("score", 3))
    return rounded.select("event_id", U.urgency_label("score").alias("label"))


@query(
    f"WITH RECURSIVE {S.INCIDENTS} SELECT incident, round(urgency_score, 6) AS urgency_score, row_number() OVER "
    "(ORDER BY urgency_score DESC, lone, incident) AS position FROM incidents"
)
def rank_incidents(t):
    ranked = I.rank_incidents(t.incidents.select("incident", "urgency_score", "lone"), "position")
    return ranked.select("incident", R("urgency_score"), "position")


@query(
    f"{G} SELECT count(*) FILTER (urgency_label = 'CRITICAL') AS critical, count(*) FILTER (urgency_label = 'HIGH') AS high, "
    "count(*) FILTER (urgency_label = 'MODERATE') AS moderate FROM incidents"
)
def urgency_counts(t):
    return I.urgency_counts(t.given_incidents)
