import difflib
import random

import pytest

from tidewatch.operators import fuzzy, gazetteer as B, places as P

PLACES = ["velachery", "velachery bridge", "tambaram bus stand", "adyar", "anna nagar", "t nagar", "omr", "gh"]


def gaz(spark, names=PLACES):
    rows = [(n, 10.0 + i, 80.0 + i, n.title() + ", City") for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "key string, lat double, lng double, full_name string")


def test_ratio_lookup_matches_the_standard_library(spark):
    rng = random.Random(5)
    letters = "abcdeghnrtvy "
    keys = PLACES + ["".join(rng.choice(letters) for _ in range(rng.randint(2, 14))) for _ in range(80)]
    names = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 16))).strip() for _ in range(150)]
    names += ["velachery brige", "tambaram bus", "adyarr", "x" * 250 + "adyar"]
    keys, names = sorted(set(k.strip() for k in keys) - {""}), sorted(set(names) - {""})
    want = {}
    for n in names:
        hit = difflib.get_close_matches(n, keys, n=1, cutoff=0.6)
        if hit:
            want[n] = hit[0]
    got = P.best_ratios(names, keys, 0.6)
    assert {n: k for n, k, _ in got} == want
    df = spark.createDataFrame([(n,) for n in names], "loc string")
    found = P.lookup_fuzzy(df, "loc", gaz(spark, keys)).collect()
    assert {r["loc"]: r.match for r in found} == want


@pytest.mark.parametrize("metric, cutoff", [("ratio", 0.3), ("ratio", 0.6), ("ratio", 0.9), ("levenshtein", 0.35), ("levenshtein", 0.6), ("levenshtein", 0.8)])
def test_fuzzy_joins_equal_all_pairs(spark, metric, cutoff, monkeypatch):
    monkeypatch.setattr(fuzzy, "STRINGS_PER_BLOCK", 40)
    rng = random.Random(int(cutoff * 100))
    word = lambda least: "".join(rng.choice("aaeinrst é\U0001f600") for _ in range(rng.randint(least, 12)))
    keys = sorted({word(1) for _ in range(60)} | {"q", "aaaaaaaaaaaa", "a"})
    near = ["".join(c for c in k if rng.random() > 0.2) + rng.choice(["", "x", "na"]) for k in keys]
    names = sorted(({n.strip() for n in near} | {word(0).strip() for _ in range(60)} | {"zzzz", "aaaaaa"}) - {""})
    pairs = spark.createDataFrame([(n, k) for n in names for k in keys], "n string, k string")
    if metric == "levenshtein":
        scored = [(r.n, r.s, r.k) for r in pairs.selectExpr("n", "k", "1.0D - levenshtein(n, k) / greatest(length(n), length(k)) AS s").collect()]
    else:
        scored = [(n, difflib.SequenceMatcher(None, k, n).ratio(), k) for n in names for k in keys]
    want = {}
    for n, s, k in scored:
        if s >= cutoff:
            want[n] = max(want.get(n, (0.0, "")), (s, k))
    df = spark.createDataFrame([(n,) for n in names], "loc string")
    got = {r.loc: (r.similarity, r.match) for r in P.lookup_fuzzy(df, "loc", gaz(spark, keys), cutoff, metric).collect()}
    assert {n: k for n, (_, k) in got.items()} == {n: k for n, (_, k) in want.items()}
    assert all(abs(got[n][0] - want[n][0]) < 1e-12 for n in want) and len(want) > 10


def test_fuzzy_filters_leave_most_pairs_out(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(8, 14)))
    names = spark.createDataFrame([(w,) for w in {word() for _ in range(400)}], "name string")
    keys = spark.createDataFrame([(w,) for w in {word() for _ in range(400)}], "key string")
    every = names.count() * keys.count()
    assert fuzzy.ratio_candidates(names, keys, 0.8).count() < 0.01 * every
    assert fuzzy.ratio_candidates(names, keys, 0.6).count() < 0.1 * every


def test_first_resolving_name_wins_even_if_fuzzy(spark):
    rows = [
        (1, ["Nowhere land", "velachery brige", "adyar"]),
        (2, [" ADYAR "]),
        (3, ["zzz", ""]),
        (4, []),
        (5, None),
    ]
    df = spark.createDataFrame(rows, "id long, locations array<string>")
    for hot_rows in (1, 10**6):
        got = {r.id: r.resolved_location for r in P.geocode(df, "id", "locations", gaz(spark), hot_rows=hot_rows).collect()}
        assert got == {1: "Velachery Bridge, City", 2: "Adyar, City", 3: None, 4: None, 5: None}


def test_full_name_falls_back_to_the_input(spark):
    g = spark.createDataFrame([("adyar", 1.0, 2.0, None)], "key string, lat double, lng double, full_name string")
    df = spark.createDataFrame([(1, "Adyar"), (2, " ")], "id long, loc string")
    got = {r.id: r.full_name for r in P.lookup_exact(df, "loc", g).collect()}
    assert got == {1: "Adyar", 2: None}


def test_longest_phrase_wins_and_is_used_up(spark):
    df = spark.createDataFrame(
        [(1, "Trapped near Velachery Bridge, then ADYAR; velachery again, adyar"), (2, "nothing here"), (3, "")],
        "id long, text string",
    )
    got = {r.id: r.locations for r in P.extract_places(df, "id", "text", gaz(spark)).collect()}
    assert got == {1: ["velachery bridge", "adyar", "velachery"], 2: [], 3: []}


def test_gazetteer_build_resume_and_report(spark):
    aliases = spark.createDataFrame(
        [("Adyar", "old query", 1), ("adyar", "Adyar, City", 2), ("omr", "OMR, City", 3), ("gh", "Hospital", 4)],
        "key string, query string, seq long",
    )
    coords = spark.createDataFrame(
        [("Adyar, City", 13.00012345678, 80.2, "Adyar"), ("OMR, City", 12.9, 80.1, "OMR"), ("old query", 0.0, 0.0, "x")],
        "query string, lat double, lng double, full_name string",
    )
    built = B.build_gazetteer(aliases, coords)
    assert {r.key: r.lat for r in built.collect()} == {"adyar": 13.000123, "omr": 12.9}
    before = built.filter("key = 'omr'")
    wanted = B.canonical_aliases(aliases)
    assert {r.key for r in B.resume_gazetteer(before, wanted).collect()} == {"adyar", "gh"}
    report = B.gazetteer_report(wanted, before, built).first()
    assert (report.resolved, report.skipped, report.failed) == (1, 1, 1)
    assert [r.key for r in B.failed_aliases(wanted, before, built).collect()] == ["gh"]
    assert B.extend_gazetteer(before, aliases.withColumnRenamed("key", "k").selectExpr("lower(k) key", "query", "seq"), coords).count() == 2
