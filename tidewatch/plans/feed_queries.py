"""The incident feed, its views and the digest."""

from pyspark.sql import functions as F

from ..functions.text import iso_time
from ..operators import feed as D
from ..sources.feed import latest_report as newest_report
from . import sql as S
from .registry import query

R = lambda c: F.round(c, 6).alias(c)
I = f"WITH RECURSIVE {S.INCIDENTS}"  # noqa: E741


@query(
    f"""WITH {S.GIVEN} SELECT incident, representative_text, post_count, {S.iso('first_seen')} AS first_seen,
  {S.iso('last_seen')} AS last_seen, round(urgency_score, 6) AS urgency_score, urgency_label, incident_key,
  row_number() OVER (ORDER BY {S.TIERS}) AS position FROM incidents"""
)
def ranked_incidents(t):
    """The flagship: incidents active in the window, most urgent tier first."""
    ranked = D.tier_order(t.given_incidents, "position")
    return ranked.select(
        "incident", "representative_text", "post_count", iso_time("first_seen").alias("first_seen"),
        iso_time("last_seen").alias("last_seen"), R("urgency_score"), "urgency_label", "incident_key", "position",
    )


def snapshots(t):
    """Two published snapshots: all incidents, then those with an even number."""
    every = t.incidents.withColumns({"lat": F.col("incident") / 10.0, "lng": F.lit(None).cast("double")})
    first = every.withColumn("batch_id", F.lit(1))
    return first.unionByName(every.filter("incident % 2 = 0").withColumn("batch_id", F.lit(2)))


@query(
    f"""{I} SELECT incident_key, cluster_id, representative_text, post_count, {S.iso('first_seen')} AS first_seen,
  {S.iso('last_seen')} AS last_seen, round(urgency_score, 6) AS urgency_score, urgency_label, incident / 10.0 AS lat,
  NULL::DOUBLE AS lng FROM incidents WHERE incident % 2 = 0"""
)
def incident_feed(t):
    feed = D.incident_feed(snapshots(t))
    return feed.withColumns(
        {"first_seen": iso_time("first_seen"), "last_seen": iso_time("last_seen"), "urgency_score": F.round("urgency_score", 6)}
    )


@query(
    f"""{I} SELECT incident, urgency_label, post_count, row_number() OVER (ORDER BY {S.TIERS}) AS position FROM incidents"""
)
def tier_order(t):
    ordered = D.tier_order(t.incidents.select("incident", "urgency_label", "post_count", "urgency_score", "lone"), "position")
    return ordered.select("incident", "urgency_label", "post_count", "position")


PLACED = """placed AS (SELECT *, CASE WHEN incident % 3 > 0 THEN 8 + incident % 5 END AS lat,
  CASE WHEN incident % 4 > 0 THEN 77 + incident % 5 END AS lng FROM incidents)"""


def placed(t):
    n = F.col("incident")
    return t.incidents.withColumns({"lat": F.when(n % 3 > 0, 8 + n % 5), "lng": F.when(n % 4 > 0, 77 + n % 5)})


@query(
    f"{I}, {PLACED} SELECT incident, lat, lng, 8 + 1.5::DOUBLE * post_count AS radius FROM placed "
    "WHERE lat IS NOT NULL AND lng IS NOT NULL"
)
def map_points(t):
    return D.map_points(placed(t)).select("incident", "lat", "lng", "radius")


@query(
    f"{I}, {PLACED}, c AS (SELECT count(*) FILTER (lat IS NOT NULL AND lng IS NOT NULL) AS plotted, count(*) AS total "
    "FROM placed) SELECT plotted, total, plotted || ' / ' || total || ' plotted' AS caption FROM c"
)
def map_summary(t):
    return D.map_summary(placed(t))


@query(
    f"WITH {S.GIVEN} SELECT incident, row_number() OVER (PARTITION BY incident ORDER BY seq) AS position, seq, text FROM members"
)
def incident_sources(t):
    return D.incident_sources(t.active.withColumn("incident", F.col("label").cast("long")))


@query(
    f"""WITH {S.GIVEN}, s AS (
  SELECT incident, row_number() OVER (PARTITION BY incident ORDER BY seq) AS position, text FROM members)
SELECT incident, (position - 1) // 3 AS chunk, count(*) AS n, string_agg(text, chr(10) ORDER BY position) AS texts
FROM s GROUP BY ALL"""
)
def source_chunks(t):
    sources = D.incident_sources(t.active.withColumn("incident", F.col("label").cast("long")))
    chunks = D.source_chunks(sources, 3)
    return chunks.select("incident", "chunk", F.size("texts").alias("n"), F.array_join("texts", "\n").alias("texts"))


@query(f"{I} SELECT incident, post_count - 1 AS more FROM incidents WHERE post_count > 1")
def extra_reports(t):
    return D.extra_reports(t.incidents).select("incident", "more")


DONE = "done AS (SELECT cluster_id FROM incidents WHERE incident % 3 = 0 UNION ALL SELECT 'c_unknown')"


def done(t):
    hit = t.incidents.filter("incident % 3 = 0").select("cluster_id")
    return hit.union(t.spark.range(1).select(F.lit("c_unknown")))


@query(f"{I}, {DONE} SELECT incident, cluster_id FROM incidents WHERE cluster_id NOT IN (SELECT cluster_id FROM done)")
def resolve(t):
    return D.resolve(t.incidents, done(t)).select("incident", "cluster_id")


@query(
    f"""{I}, s AS (SELECT incident, incident_key, last_seen FROM incidents),
d AS (SELECT incident_key, max(first_seen) AS resolved_at FROM incidents WHERE incident % 3 = 0 GROUP BY incident_key)
SELECT incident FROM s WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.incident_key = s.incident_key AND last_seen <= resolved_at)"""
)
def resolve_sticky(t):
    log = t.incidents.filter("incident % 3 = 0").select("incident_key", F.col("first_seen").alias("resolved_at"))
    return D.resolve(t.incidents, log, sticky=True).select("incident")


@query(
    f"""{I}, {DONE}, r AS (SELECT d.cluster_id, i.cluster_id IS NOT NULL AS removed FROM done d
  LEFT JOIN incidents i ON i.cluster_id = d.cluster_id)
SELECT cluster_id, removed, 'Cluster ' || cluster_id || CASE WHEN removed THEN ' resolved' ELSE ' not found' END AS message
FROM r"""
)
def resolution_report(t):
    return D.resolution_report(t.incidents, done(t))


@query(f"{I} SELECT count(*) AS removed, 0::BIGINT AS remaining FROM incidents")
def clear_incidents(t):
    empty, removed = D.clear_incidents(t.incidents)
    return removed.join(F.broadcast(empty.agg(F.count(F.lit(1)).alias("remaining"))))


@query(
    f"""{I}, numbered AS (SELECT *, row_number() OVER (ORDER BY {S.TIERS}) AS line_no FROM incidents),
lines AS (SELECT line_no, 'INCIDENT ' || line_no || ' [' || urgency_label || '] at Unknown location: ' ||
  representative_text || ' (' || post_count || ' reports)' AS line FROM numbered),
budget AS (SELECT *, sum(len({S.ws_tokens('line')})) OVER (ORDER BY line_no) AS used FROM lines),
kept AS (SELECT line_no, line FROM budget WHERE used <= 1200)
SELECT line_no, line FROM kept UNION ALL
SELECT k + 1, '[' || (n - k) || ' additional incidents not shown]' FROM (
  SELECT (SELECT count(*) FROM kept) AS k, (SELECT count(*) FROM incidents) AS n) WHERE n > k"""
)
def digest(t):
    return D.digest(t.incidents.withColumn("resolved_location", F.lit(None).cast("string")))


@query(
    f"""SELECT {S.iso("time_bucket(INTERVAL '15 minutes', ts)")} AS tick_start, count(*) AS n_posts FROM events GROUP BY 1"""
)
def digest_ticks(t):
    return D.digest_ticks(t.read("events")).select(iso_time("tick_start").alias("tick_start"), "n_posts")


@query(
    """WITH reports AS (SELECT event_type || ' ' || event_id AS report, ts AS report_ts FROM events)
SELECT arg_max(report, report_ts) AS report, strftime(max(report_ts), '%Y-%m-%dT%H:%M:%S.%f') AS generated FROM reports"""
)
def latest_report(t):
    text = F.concat("event_type", F.lit(" "), F.col("event_id").cast("string"))
    reports = t.read("events").select(text.alias("report"), F.col("ts").alias("report_ts"))
    return newest_report(reports).withColumn("generated", iso_time("generated"))


@query(
    f"""{I}, {S.GAZETTEER} SELECT (SELECT count(*) FROM incidents) AS active_incidents, (SELECT count(*) FROM active) AS
  window_size, (SELECT count(*) FROM gazetteer) AS gazetteer_size, 'healthy' AS overall"""
)
def service_status(t):
    return D.service_status(t.incidents, t.active, t.gazetteer, t.weights)
