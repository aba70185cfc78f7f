import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from tidewatch.operators.feed import FEED_COLUMNS
from tidewatch.operators.window import active_window
from tidewatch.sources import feed as S
from tidewatch.streaming import jobs as J

SETTINGS = J.RefreshSettings(eps=0.4, threshold=0.0, minutes=30)
START = dt.datetime(2024, 5, 1, 10)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("stream")
    texts = ["flood water at adyar bridge", "water flood at adyar bridge now", "fire near omr school", "sale music party"]
    rows = []
    for i in range(24):
        rows.append((f"p{i}", i, texts[i % 4], START + dt.timedelta(minutes=4 * i)))
    rows.append(("late", 99, texts[0], START - dt.timedelta(hours=3)))
    posts = spark.createDataFrame(rows, "post_id string, seq long, text string, ts timestamp")
    source = str(root / "posts")
    for part, (lo, hi) in enumerate([(0, 10), (10, 20), (20, 100)]):
        posts.filter((F.col("seq") >= lo) & (F.col("seq") < hi)).coalesce(1).write.mode("append").parquet(source)
    weights = spark.createDataFrame(
        [("flood", 1.0, 1.0), ("water", 1.0, 1.0), ("fire", 1.0, 1.0), ("sale", 1.0, -5.0), ("music", 1.0, -5.0)],
        "term string, idf double, coef double",
    )
    gaz = spark.createDataFrame(
        [("adyar bridge", 1.0, 2.0, "Adyar Bridge"), ("omr", 3.0, 4.0, "OMR")],
        "key string, lat double, lng double, full_name string",
    )
    return root, posts, source, weights, gaz


def run(spark, tables, name, **options):
    root, _, source, weights, gaz = tables
    out, checkpoint = str(root / name / "out"), str(root / name / "checkpoint")
    query = J.incident_stream(
        J.stream_posts(spark, source), weights, 0.0, gaz, out, checkpoint, SETTINGS, **options
    )
    query.awaitTermination()
    assert query.exception() is None
    return out, checkpoint


def test_stream_ends_where_the_batch_does(spark, tables):
    root, posts, _, weights, gaz = tables
    out, _ = run(spark, tables, "a")
    got = S.read_feed(spark, out).select(*FEED_COLUMNS)

    from tidewatch.functions.hooks import embed
    from tidewatch.operators.features import gate_posts
    from tidewatch.operators.window import latest_moment

    kept = embed(gate_posts(posts, weights, 0.0, "text", 0.0).drop("score"), "text")
    now = latest_moment(kept)
    batch, _ = J.refresh_incidents(active_window(kept, now, 30), now, gaz, SETTINGS)
    key = lambda df: sorted(map(str, df.select(*FEED_COLUMNS).collect()))
    assert got.count() > 1 and key(got) == key(batch)
    gate = [S.committed(spark, out, "gate").count(), S.read_feed(spark, out, "gate").first().submitted]
    assert gate[0] == 3 and S.read_feed(spark, out, "gate").first().late == 1

    # Every batch's snapshot, with posts retired in between, is what clustering its window anew gives.
    for batch, seen in enumerate((10, 20, 100)):
        so_far = kept.filter(F.col("seq") < seen)
        now = latest_moment(so_far)
        whole, _ = J.refresh_incidents(active_window(so_far, now, 30), now, gaz, SETTINGS)
        assert key(spark.read.parquet(f"{out}/incidents/batch={batch}")) == key(whole)
    links = spark.read.parquet(f"{out}/links")
    assert links.agg(F.min("minute")).first()[0] >= spark.read.parquet(f"{out}/window").agg(F.min("minute")).first()[0]
    sources = S.read_feed(spark, out, "sources")
    assert sources.count() == got.agg(F.sum("post_count")).first()[0]

    made = str(root / "reports")
    query = J.digest_stream(spark, out, made, str(root / "digest"), availableNow=True)
    query.awaitTermination()
    report = S.latest_report(S.read_reports(spark, made)).first().report
    assert report.startswith("INCIDENT 1 [") and "Adyar Bridge" in report


def test_resolutions_and_ticks(spark, tables, tmp_path):
    """Resolve, clear, and batches in between; the digest follows at every tick, with or without a new batch."""
    snapshot = spark.createDataFrame(
        [("k1", "c_000", "Fire at the school", 3, "CRITICAL", 1, False), ("k2", "c_001", "Water at the bridge", 2, "HIGH", 2, False)],
        "incident_key string, cluster_id string, representative_text string, post_count int, urgency_label string, incident long, lone boolean",
    ).withColumns({
        "first_seen": F.lit(START), "last_seen": F.lit(START), "urgency_score": F.lit(0.5), "locations": F.array().cast("array<string>"),
        "lat": F.lit(None).cast("double"), "lng": F.lit(None).cast("double"), "resolved_location": F.lit(None).cast("string"),
    })
    feed, names = str(tmp_path / "feed"), lambda *c: spark.createDataFrame([(x,) for x in c], "cluster_id string")
    keys = lambda **k: sorted(r.incident_key for r in S.read_live(spark, feed, **k).collect())
    assert S.read_live(spark, feed) is None and S.clear_feed(spark, feed, "r0") == 0
    assert [r.removed for r in S.resolve_incidents(spark, feed, names("c_000"), "r0").collect()] == [False]

    S.publish_feed(snapshot, feed, 0)
    told = {r.cluster_id: r.message for r in S.resolve_incidents(spark, feed, names("c_000", "c_009"), "r1").collect()}
    assert told == {"c_000": "Cluster c_000 resolved", "c_009": "Cluster c_009 not found"}
    for again in ("r1", "r2"):
        assert [r.removed for r in S.resolve_incidents(spark, feed, names("c_000"), again).collect()] == [False]
    assert keys() == keys(sticky=True) == ["k2"]

    # A later batch: as published it shows its window; a sticky resolution waits for a newer post.
    S.publish_feed(snapshot, feed, 1)
    assert keys() == ["k1", "k2"] and keys(sticky=True) == ["k2"]
    newer = F.when(F.col("incident_key") == "k1", F.lit(START + dt.timedelta(minutes=1))).otherwise(F.col("last_seen"))
    S.publish_feed(snapshot.withColumn("last_seen", newer), feed, 2)
    assert keys(sticky=True) == ["k1", "k2"]

    def ticks(name, wanted):
        query = J.digest_stream(spark, feed, str(tmp_path / "reports"), str(tmp_path / name), processingTime="1 second")
        until = time.time() + 90
        while time.time() < until and query.isActive and S.read_reports(spark, str(tmp_path / "reports")).count() < wanted:
            time.sleep(0.5)
        query.stop()
        assert query.exception() is None
        return [r.report for r in S.read_reports(spark, str(tmp_path / "reports")).orderBy("report_ts").collect()]

    S.resolve_incidents(spark, feed, names("c_001"), "r3")
    reports = ticks("ticks", 2)
    assert len(reports) >= 2 and all("Fire" in r and "Water" not in r for r in reports)  # no batch came in between
    assert S.clear_feed(spark, feed, "r4") == 1 and keys() == []
    query = J.digest_stream(spark, feed, str(tmp_path / "none"), str(tmp_path / "c2"), availableNow=True)
    query.awaitTermination()
    assert S.read_reports(spark, str(tmp_path / "none")).count() == 0
    assert S.forget_resolutions(spark, feed, START - dt.timedelta(hours=1)) == 0
    assert S.forget_resolutions(spark, feed, START + dt.timedelta(hours=1)) == 1  # batch 0; the newest snapshot's stay
    assert keys() == []


def test_a_reader_sees_few_files_however_old_the_stream(spark, tmp_path):
    path, rows = str(tmp_path), spark.range(1).withColumn("name", F.lit("a"))
    for batch in range(25):
        S.publish_feed(rows, path, batch, keep=4)
    assert [r.batch_id for r in S.committed(spark, path).orderBy("batch_id").collect()] == [21, 22, 23, 24]
    assert sorted(p.name for p in (tmp_path / "incidents").iterdir()) == [f"batch={b}" for b in range(21, 25)]
    assert S.read_feed(spark, path).count() == 1
    ran = []
    for batch in (0, 24, 25):  # removed commits count as done
        S.once_per_batch(spark, path, batch, lambda: ran.append(1), "incidents")
    assert len(ran) == 1


def test_a_repeated_batch_changes_nothing(spark, tables):
    root, posts, source, weights, gaz = tables
    out, _ = run(spark, tables, "b")
    before = sorted(map(str, S.read_feed(spark, out).collect()))
    # Losing the checkpoint replays every batch from the start.
    query = J.incident_stream(
        J.stream_posts(spark, source), weights, 0.0, gaz, out, str(root / "b" / "fresh"), SETTINGS
    )
    query.awaitTermination()
    assert sorted(map(str, S.read_feed(spark, out).collect())) == before
    window = spark.read.parquet(f"{out}/window")
    assert window.count() == window.select("seq").distinct().count()
    # Whole minutes before the window are gone.
    oldest = window.agg(F.min("ts")).first()[0]
    assert oldest >= START + dt.timedelta(minutes=4 * 23 - 45)


def test_null_and_future_times_lose_nothing(spark, tables, tmp_path):
    _, posts, _, weights, gaz = tables
    odd = [("none", 200, "fire near omr school", None), ("far", 201, "fire near omr school", dt.datetime(2099, 1, 1))]
    early = posts.filter("seq < 24 and seq >= 18")
    early.unionByName(spark.createDataFrame(odd, posts.schema)).coalesce(1).write.parquet(str(tmp_path / "posts"))
    early.filter("seq = 23").withColumn("seq", F.lit(300).cast("long")).coalesce(1).write.mode("append").parquet(str(tmp_path / "posts"))
    out = str(tmp_path / "out")
    query = J.incident_stream(J.stream_posts(spark, str(tmp_path / "posts")), weights, 0.0, gaz, out, str(tmp_path / "c"), SETTINGS)
    query.awaitTermination()
    assert query.exception() is None
    window = spark.read.parquet(f"{out}/window")
    kept = {r.seq for r in window.collect()}
    assert {200, 201} <= kept and {i for i in range(18, 24) if i % 4 != 3} <= kept
    assert window.filter("ts is null or year(ts) = 2099").count() == 0
    sources = S.read_feed(spark, out, "sources")
    assert sources.count() == len(kept)


def test_label_counts_as_a_stream(spark, tables):
    root, posts, source, _, _ = tables
    stream = J.stream_posts(spark, source, files_per_batch=1)
    counts = J.label_window_counts(stream, label="text")
    query = counts.writeStream.format("memory").queryName("label_counts").outputMode("complete").trigger(availableNow=True)
    query.start().awaitTermination()
    got = spark.table("label_counts")
    want = J.label_window_counts(posts, label="text")
    key = lambda df: sorted(map(str, df.collect()))
    assert set(key(got)) <= set(key(want)) and got.count() >= want.count() - 2
