import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import curves as C, features as Q, feed as D, metrics as M, prep as P, training as T


def frame(spark, rows):
    return spark.createDataFrame(rows, "label int, score double")


def test_auc_by_pairs_and_its_mirror(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(2), round(rng.gauss(0, 1), 1)) for _ in range(300)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    df = frame(spark, rows)
    assert C.auc(df).first()[0] == pytest.approx(want)
    assert C.auc(df.withColumn("score", -F.col("score"))).first()[0] == pytest.approx(1 - want)


def test_all_scores_tied(spark):
    df = frame(spark, [(1, 0.5), (0, 0.5), (0, 0.5)])
    assert C.auc(df).first()[0] == pytest.approx(0.5)
    assert C.average_precision(df).first()[0] == pytest.approx(1 / 3)
    sweep = C.threshold_sweep(df).collect()
    assert len(sweep) == 200 and all(r.recall == 1.0 for r in sweep)
    assert C.score_histogram(df).agg(F.sum("n_rows")).first()[0] == 3


def test_sweep_counts_rows_at_or_above_each_threshold(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(2), rng.gauss(0, 1)) for _ in range(200)]
    lo, hi = min(s for _, s in rows), max(s for _, s in rows)
    for r in C.threshold_sweep(frame(spark, rows), steps=50).collect():
        t = hi if r.step == 49 else r.step * ((hi - lo) / 49.0) + lo
        picked = [y for y, s in rows if s >= t]
        assert r.threshold == t
        assert r.recall == pytest.approx(sum(picked) / sum(y for y, _ in rows))
        assert r.precision == pytest.approx(sum(picked) / len(picked))


def test_rates_are_zero_without_a_denominator(spark):
    df = spark.createDataFrame([(1, 1), (1, 1)], "label int, predicted int")
    row = M.confusion(df).first()
    assert (row.tp, row.fpr, row.tnr) == (2, 0.0, 0.0)
    assert {r["class"]: r.f1 for r in M.class_report(df).collect()} == {0: 0.0, 1: 1.0}


def test_gate_keeps_a_score_exactly_at_the_threshold(spark):
    df = spark.createDataFrame([(0.3,), (0.29999,), (None,), (2.0,)], "score double")
    assert Q.noise_gate(df).count() == 2
    assert tuple(Q.gate_stats(df).first()) == (4, 2, 2)


def test_unknown_text_scores_the_intercept(spark):
    weights = spark.createDataFrame([("flood", 1.5, 2.0), ("flood now", 2.0, -1.0)], "term string, idf double, coef double")
    docs = spark.createDataFrame([("zebra",), ("flood",), ("flood now",), ("",)], "text string")
    got = {r.text: r.score for r in Q.decision_score(docs, weights, -0.25).collect()}
    assert got["zebra"] == got[""] == -0.25 and got["flood"] == pytest.approx(1.75)
    assert got["flood now"] == pytest.approx((1.5 * 2 - 2.0 * 1) / 2.5 - 0.25)
    with pytest.raises(ValueError, match="more than 1 terms"):
        Q.term_values(weights, ["idf"], max_terms=1)


def test_dedupe_steps_and_report_agree(spark):
    rows = [("A", "a", 1), ("A", "a", 1), ("a!", "a", 1), ("b", "b", 0), ("B", "b", 1), ("c", "c", 0)]
    df = spark.createDataFrame(rows, "raw_text string, text string, label int")
    assert sorted(map(tuple, P.dedupe_labelled(df).collect())) == [("a", 1), ("c", 0)]
    stepwise = P.drop_label_conflicts(P.drop_exact(df)).dropDuplicates(["text", "label"])
    assert stepwise.count() == 2
    assert tuple(P.dedupe_report(df).first()) == (1, 1, 2, 1, 4, 2)


def test_exact_split_and_folds_are_balanced(spark):
    df = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "k long, label int")
    split = P.stratified_split(df, "label", "k").groupBy("label", "split").count().collect()
    assert {(r.label, r.split): r["count"] for r in split} == {
        (0, "test"): 30, (0, "train"): 120, (1, "test"): 10, (1, "train"): 40,
    }
    folds = P.assign_folds(df, "label", "k").groupBy("label", "fold").count().collect()
    assert {r["count"] for r in folds if r.label == 1} == {10}


def test_exact_selection_by_ranks(spark):
    import hashlib

    rng = random.Random(5)
    rows = [(i, rng.choice([0, 0, 0, 1, None]), "x" * (i % 7)) for i in range(700)]
    df = spark.createDataFrame(rows, "k long, label int, text string").repartition(7)
    order = lambda r: (hashlib.md5(f"{r[0]}|42".encode()).hexdigest(), r[0])
    split, fold = {}, {}
    for y in (0, 1, None):
        ranked = sorted((r for r in rows if r[1] == y), key=order)
        take = -(-len(ranked) * 2 // 10)
        split |= {r[0]: "test" if i < take else "train" for i, r in enumerate(ranked)}
        fold |= {r[0]: i % 3 for i, r in enumerate(ranked)}
    assert {r.k: r.split for r in P.stratified_split(df, "label", "k").collect()} == split
    assert {r.k: r.fold for r in P.assign_folds(df, "label", "k", k=3).collect()} == fold
    none = df.limit(0)
    assert P.stratified_split(none, "label", "k").count() == P.assign_folds(none, "label", "k").count() == 0
    alike = spark.createDataFrame([(7, 1)] * 10, "k long, label int")
    assert {r.split for r in P.stratified_split(alike, "label", "k").collect()} == {"test"}


def corpus(spark, n=160):
    rng = random.Random(11)
    urgent, calm = "flood rescue trapped water bridge".split(), "music sale match movie party".split()
    rows = []
    for i in range(n):
        y = int(i % 3 != 0)
        words = [rng.choice(urgent if y else calm) for _ in range(5)] + [rng.choice("today city people".split())]
        rows.append((str(i), " ".join(words), y))
    return spark.createDataFrame(rows, "doc string, text string, label int")


def test_training_separates_a_separable_corpus(spark, tmp_path):
    from tidewatch.sources.files import load_model, save_model

    docs = corpus(spark)
    weights, intercept = T.fit_classifier(docs, "doc", max_iter=50)
    quality = M.averaged_metrics(T.predict(docs, weights, intercept)).first()
    assert quality.accuracy == 1.0
    best = Q.top_terms(weights, 3).filter("side = 'negative'").collect()
    assert all(set(r.term.split()) <= set("music sale match movie party today city people".split()) for r in best)

    save_model(weights, intercept, str(tmp_path))
    loaded, bias = load_model(spark, str(tmp_path))
    assert bias == intercept and loaded.count() == weights.count()
    with pytest.raises(FileNotFoundError):
        load_model(spark, str(tmp_path), version=2)
    weights.limit(3).select("term", "idf").write.mode("overwrite").parquet(f"{tmp_path}/vocabulary/version=1")
    with pytest.raises(ValueError, match="belong together"):
        load_model(spark, str(tmp_path))


def test_cross_validation_and_learning_curve(spark):
    docs = corpus(spark, 90)
    folds = T.cross_validate(docs, "doc", k=2)
    assert folds.count() == 2 and folds.agg(F.min("accuracy")).first()[0] > 0.9
    curve = T.learning_curve(docs, "doc", fractions=(0.5, 1.0), k=2).collect()
    assert {(r.fraction, r.part) for r in curve} == {(f, p) for f in (0.5, 1.0) for p in ("train", "validation")}


def test_learning_curve_counts_sets_of_one_class_as_zero(spark):
    docs = spark.createDataFrame([(str(i), f"flood water {i}", 1) for i in range(12)], "doc string, text string, label int")
    curve = T.learning_curve(docs, "doc", fractions=(0.5, 1.0), k=2).collect()
    assert {(r.fraction, r.part, r.mean) for r in curve} == {(f, p, 0.0) for f in (0.5, 1.0) for p in ("train", "validation")}


def test_folds_from_one_count_equal_folds_one_by_one(spark):
    docs = corpus(spark, 120)
    folded = P.assign_folds(docs, "label", "doc", 3).withColumn("step", F.lit(0)).cache()
    together = T.fold_vocabularies(docs, "doc", k=3)
    quality = {r.fold: r for r in T.cross_validate(docs, "doc", k=3, tol=1e-6).collect()}
    for fold in range(3):
        train, held_out = folded.filter(F.col("fold") != fold), folded.filter(F.col("fold") == fold)
        vocab = T.fit_vocabulary(train, "doc")
        alone = {tuple(r) for r in vocab.select("term", "df", "cf").collect()}
        assert {tuple(r) for r in together.filter(F.col("fold") == fold + 1).select("term", "df", "cf").collect()} == alone
        scored = T.predict(held_out, *T.train_linear(train, vocab, tol=1e-6))
        row = M.averaged_metrics(scored).first()
        assert quality[fold + 1].f1_macro == pytest.approx(row.f1_macro, abs=1e-4)


def noisy(spark, n=150):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(40)]
    rows = [(str(i), " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))), int(rng.random() < 0.4)) for i in range(n)]
    return spark.createDataFrame([*rows, ("none", "zzz", 1)], "doc string, text string, label int")


def test_vocabularies_of_cases_without_counts_by_fold_and_step(spark, monkeypatch):
    import numpy as np

    from tidewatch.operators import cases as K

    docs = P.assign_folds(noisy(spark), "label", "doc", 3).withColumn("step", (F.col("doc") > "5").cast("int")).cache()
    cases = [K.Case(fold, step) for step in (0, 1) for fold in range(3)]
    sizes = K.case_sizes(docs, "label", cases)
    counted = K.count_terms
    grouped = []
    monkeypatch.setattr(K, "count_terms", lambda d, c, by=(): grouped.append(by) or counted(d, c, by))
    for most, margin, passes in ((30, 0.8, [()]), (10_000, 0.8, [()]), (30, 500.0, [(), ["fold", "step"]])):
        wanted = [{} for _ in cases]
        for r in K.case_vocabularies(docs, "doc", "text", cases, 2, most).collect():
            wanted[r.case][r.term] = np.log((sizes[r.case].sum() + 1.0) / (r.df + 1.0)) + 1.0
        union = {t for w in wanted for t in w}
        grouped.clear()
        monkeypatch.setattr(K, "MARGIN", margin)  # too large a margin leaves terms out, which is noticed
        blocks, idf = K.blocks_of_cases(docs, "doc", "text", "label", cases, sizes, 2, most)
        assert grouped == passes
        assert idf.shape == (len(cases), len(union))
        assert [sorted(x[x > 0]) for x in idf] == [pytest.approx(sorted(w.values())) for w in wanted]
        bound = len(union)
        found = list(K.blocks_of(blocks.toArrow().to_batches()))
        assert sum(b.n for b in found) == docs.count() and all(b.term.max(initial=0) < bound for b in found)


def test_a_block_takes_few_bytes_and_scores_two_sets_of_weights_at_once(spark):
    import numpy as np

    from tidewatch.operators import cases as K

    docs = noisy(spark).withColumns({"fold": F.lit(0), "step": F.lit(0)}).coalesce(1)
    terms = [f"word{i}" for i in range(40)]
    idf = np.linspace(1, 2, 40).reshape(1, -1)
    table = K.number_terms(docs, "text", "label", terms, idf).toArrow()
    rng = np.random.default_rng(1)
    one, two = rng.normal(size=(2, 40))
    entries = 0
    for b in K.blocks_of(table.to_batches()):
        entries += len(b.term)
        dense = np.zeros((b.n, 40))
        np.add.at(dense, (np.repeat(np.arange(b.n), b.size), b.term), 1 + np.log(b.tf.astype(float)))
        dense *= idf
        length = np.linalg.norm(dense, axis=1, keepdims=True)
        dense = dense / np.where(length > 0, length, 1)
        assert (length == 0).any()  # a row without entries
        assert b.scores(0, one * idf[0]) == pytest.approx(dense @ one)
        both = b.scores(0, (one + 1j * two) * idf[0])
        assert both.real == pytest.approx(dense @ one) and both.imag == pytest.approx(dense @ two)
        pull = rng.normal(size=b.n)
        assert b.pulled(0, pull, 40) * idf[0] == pytest.approx(pull @ dense)
    assert K.weights_of(np.array([3, 5000], np.uint16)) == pytest.approx(1 + np.log([3.0, 5000.0]), rel=1e-15)
    by_entry = sum(len(x.as_py()) for c in table.column_names[2:-3] for x in table.column(c))
    assert by_entry <= 2 * entries + 4 * 151  # 16 bytes an entry before


def test_training_rows_are_cleaned_once(spark, tmp_path):
    from tidewatch.plans.tables import Tables

    docs = [(1, "One @two #three", "s"), (2, "...", "s"), (3, None, "s"), (4, "mail me@home http://x.y now", "s"), (5, "@", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = Tables(spark, str(tmp_path)).training
    assert sorted(tuple(r) for r in rows.select("doc_id", "label", "text").collect()) == [(1, 1, "one three"), (4, 0, "mail me now")]
    assert rows._jdf.queryExecution().executedPlan().toString().count("regexp_replace(replace(") == 1


def test_words_are_counted_alike_in_cleaned_and_raw_texts(spark):
    texts = ["", None, "a", "a b", "go a home", "go  home", "Ünï code", "help!me now", " lead trail ", "ab", "ab cd ef ab cd"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    for some in (docs, docs.filter("doc in (2, 4, 9, 10)")):
        wanted = Q.build_vocabulary(Q.document_terms(some.na.fill(""), "doc"), 1).collect()
        got = Q.top_vocabulary(Q.count_terms(some.coalesce(1)), 1).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, wanted)) and got


def test_the_trained_weights_are_the_minimum(spark):
    import numpy as np

    from tidewatch.operators import cases as K

    docs = corpus(spark, 60).unionByName(spark.createDataFrame([("x", "flood music", 0), ("y", "", 1), ("z", "zebra", None)], "doc string, text string, label int"))
    rows = docs.withColumns({"fold": F.lit(0), "step": F.lit(0)})
    vocab = T.fit_vocabulary(docs, "doc")
    weights, intercept = T.train_linear(docs, vocab, tol=1e-7)
    got = {r.term: (r.idf, r.coef) for r in weights.collect()}
    n = dict(docs.groupBy("label").count().collect())
    labelled = [(r.text, r.label) for r in docs.collect() if r.label is not None]
    x = {t: dict(r) for t, r in ((r.text, [(p.term, p.w) for p in r.x]) for r in docs.select("text", Q.weighted_terms("text", vocab).alias("x")).collect())}
    terms = sorted(got)

    def loss(w, b):
        total = 0.5 * (w @ w + b * b)
        for text, y in labelled:
            f = sum(x[text].get(t, 0.0) * w[i] for i, t in enumerate(terms)) + b
            total += (n[0] + n[1]) / (2 * n[y]) * max(0.0, 1 - (2 * y - 1) * f) ** 2
        return total

    w = np.array([got[t][1] for t in terms])
    best = loss(w, intercept)
    rng = np.random.default_rng(3)
    assert all(loss(w + 1e-3 * rng.normal(size=len(w)), intercept + 1e-3 * rng.normal()) > best for _ in range(20))
    known = dict(vocab.select("term", "idf").collect())
    blocks = K.number_terms(rows.repartition(40), "text", "label", list(known))
    many = K.fit_cases(blocks, [K.Case(-1)], np.array([list(known.values())]), K.balance_of(np.array([[n[0], n[1]]])), tol=1e-7)[0]
    assert many[:-1] == pytest.approx([got[t][1] for t in known], abs=1e-5) and many[-1] == pytest.approx(intercept, abs=1e-5)


def test_vocabularies_may_be_larger_than_the_default(spark):
    vocab = spark.range(10_001).select(F.concat(F.lit("w"), "id").alias("term"), F.lit(1.0).alias("idf"), F.lit(2.0).alias("coef"))
    docs = spark.createDataFrame([("w10000 other",)], "text string")
    assert Q.decision_score(docs, vocab, 0.5).first().score == pytest.approx(2.5)


def test_taggers_see_whole_texts(spark):
    from tidewatch.functions.hooks import cut_text, tag_entities

    text = "word " * 300 + "End. " + "x" * 700 + " Last"
    assert "".join(cut_text(text, 100)) == text and max(map(len, cut_text(text, 100))) <= 100
    tagger = lambda: lambda t: [{"entity_group": "LOC", "word": w, "score": 1.0} for w in t.split() if w.istitle()]
    df = spark.createDataFrame([(text,), (None,)], "text string")
    for bound in (None, 64):
        got = {r.text: [e.word for e in r.entities] for r in tag_entities(df, "text", tagger, max_chars=bound).collect()}
        assert got == {text: ["End.", "Last"], None: []}


def test_gazetteer_keys_are_unique_and_bad_files_fail(spark, tmp_path):
    from tidewatch.sources.files import read_gazetteer

    place = lambda n: f'{{"lat": {n}.0, "lng": 2.0, "full_name": "{n}"}}'
    (tmp_path / "good.json").write_text(f'{{"Adyar": {place(1)}, "omr": {place(5)}, "adyar": {place(3)}}}')
    (tmp_path / "bad.json").write_text('{"Adyar": ')
    (tmp_path / "none.json").write_text("{}")
    assert {r.key: r.lat for r in read_gazetteer(spark, str(tmp_path / "good.json")).collect()} == {"adyar": 3.0, "omr": 5.0}
    for name in ("bad", "none"):
        with pytest.raises(Exception):
            read_gazetteer(spark, str(tmp_path / f"{name}.json")).collect()


def incident(i, label, count, text, place=None):
    return (i, label, count, 0.5, False, text, place)


INCIDENTS = (
    "incident long, urgency_label string, post_count long, urgency_score double, lone boolean, "
    "representative_text string, resolved_location string"
)


def test_digest_stops_exactly_at_the_budget(spark):
    rows = [incident(1, "HIGH", 2, "a b c", "Adyar"), incident(2, "CRITICAL", 1, "d"), incident(3, "MODERATE", 9, "e f")]
    df = spark.createDataFrame(rows, INCIDENTS)
    full = [r.line for r in D.digest(df).orderBy("line_no").collect()]
    assert full == [
        "INCIDENT 1 [CRITICAL] at Unknown location: d (1 reports)",
        "INCIDENT 2 [HIGH] at Adyar: a b c (2 reports)",
        "INCIDENT 3 [MODERATE] at Unknown location: e f (9 reports)",
    ]
    words = [len(line.split()) for line in full]
    exact = [r.line for r in D.digest(df, words[0] + words[1]).orderBy("line_no").collect()]
    assert exact == full[:2] + ["[1 additional incidents not shown]"]
    short = [r.line for r in D.digest(df, words[0] + words[1] - 1).orderBy("line_no").collect()]
    assert short == full[:1] + ["[2 additional incidents not shown]"]
    none = [r.line for r in D.digest(df, 3).collect()]
    assert none == ["[3 additional incidents not shown]"]
    assert D.digest(df.limit(0)).count() == 0


def test_the_metrics_document_holds_every_part_and_reads_back_as_json(spark):
    import json

    from tidewatch.operators import summary as D

    rows = [(i % 2, (i % 7) / 7 - 0.4 + 0.3 * (i % 2), f"flood {i} water") for i in range(60)]
    scored = spark.createDataFrame(rows, "label int, score double, raw_text string")
    weights = spark.createDataFrame([("flood", 1.0, 2.0), ('a "quoted" term', 1.0, -1.0), ("é", 1.5, 0.25)], "term string, idf double, coef double")
    folds = spark.createDataFrame([(1, 0.5, 0.25), (2, 1.0, 0.75)], "fold int, accuracy double, f1_macro double")
    document = D.metrics_document(scored, scored, weights, folds, {"per_post_ms": 0.0131, "n_trials": 60}, {"C": 1.0, "class_weight": "balanced"})
    found = json.loads(D.document_json(document).first().json)
    assert set(found) == {"classification", "confusion_matrix", "ranking", "threshold", "dataset", "vocabulary", "model", "features",
                          "cross_validation", "latency", "model_config"}
    assert found["cross_validation"] == {"accuracy.fold_1": 0.5, "accuracy.fold_2": 1.0, "accuracy.mean": 0.75, "accuracy.std": 0.25,
                                         "f1_macro.fold_1": 0.25, "f1_macro.fold_2": 0.75, "f1_macro.mean": 0.5, "f1_macro.std": 0.25}
    assert found["features"]["positive_01"] == "flood" and found["features"]["negative_01"] == 'a "quoted" term'
    assert found["latency"] == {"per_post_ms": 0.0131, "n_trials": 60} and found["model_config"] == {"C": 1.0, "class_weight": "balanced"}
    cells = found["confusion_matrix"]
    assert cells["tp"] + cells["fn"] == 30 and cells["tp"] == sum(y == 1 and s > 0 for y, s, _ in rows)
    assert found["classification"]["accuracy"] == round((cells["tp"] + cells["tn"]) / 60, 4)
    assert found["dataset"]["n_total"] == 60 and found["dataset"]["avg_tokens"] == 3
    none = json.loads(D.document_json(D.metrics_document(scored.limit(0))).first().json)
    assert none["confusion_matrix"]["tp"] == 0 and none["ranking"]["roc_auc"] is None or none["ranking"]["roc_auc"] == 0


def test_weights_of_one_row_get_length_one(spark):
    df = spark.sql("SELECT array(named_struct('term', 'a', 'w', 3D), named_struct('term', 'b', 'w', 4D)) AS x "
                   "UNION ALL SELECT array() UNION ALL SELECT array(named_struct('term', 'z', 'w', 0D)) UNION ALL SELECT NULL")  # fmt: skip
    got = [r[0] and [tuple(e) for e in r[0]] for r in df.select(Q.unit_terms("x")).collect()]
    assert got == [[("a", 0.6), ("b", 0.8)], [], [("z", 0.0)], None]
    long = df.select(F.lit(1).alias("doc"), F.inline("x"))
    assert {tuple(r) for r in Q.l2_normalise(long.filter("term < 'c'"), "doc", "w").collect()} == {(1, "a", 0.6), (1, "b", 0.8)}


def test_operators_number_their_own_order(spark):
    from tidewatch.operators import incidents as I

    rows = [(1, 0.5, "HIGH", 2, False), (2, 0.9, "CRITICAL", 3, False), (3, 0.5, "HIGH", 1, True), (4, 0.5, "HIGH", 9, False)]
    df = spark.createDataFrame(rows, "incident long, urgency_score double, urgency_label string, post_count long, lone boolean")
    for operator, want in ((I.rank_incidents, [2, 1, 4, 3]), (D.tier_order, [2, 4, 1, 3])):
        assert [r.incident for r in operator(df).collect()] == want
        numbered = operator(df, "position")
        assert numbered.columns == [*df.columns, "position"]
        assert [r.incident for r in sorted(numbered.collect(), key=lambda r: r.position)] == want
    docs = spark.range(50).withColumnRenamed("id", "doc")
    order = [r.doc for r in P.seeded_order(docs, "doc").collect()]
    assert [r.doc for r in sorted(P.seeded_order(docs, "doc", position="at").collect(), key=lambda r: r.at)] == order


def test_a_search_asks_few_questions_where_terms_differ_much():
    import numpy as np
    from tidewatch.operators import cases as K

    rng = np.random.default_rng(5)
    x = rng.poisson(60.0 / np.arange(1, 301), (6000, 300)) * np.linspace(1.0, 4.0, 300)  # rows of words, labels by chance
    x = 3 * x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    y = rng.choice([-1.0, 1.0], 6000)
    search, asked, answer = K.minimum(300, 1e-3, 2000), 0, None
    try:
        while True:
            at, way = search.send(answer)
            slack, asked = np.maximum(0.0, 1.0 - y * (x @ at)), asked + 1
            if way is None:
                answer = 0.5 * at @ at + slack @ slack, at - 2.0 * x.T @ (y * slack)
            else:
                answer = way + 2.0 * x.T @ ((slack > 0) * (x @ way))
    except StopIteration as end:
        best = end.value
    slack = np.maximum(0.0, 1.0 - y * (x @ best))
    assert np.abs(best - 2.0 * x.T @ (y * slack)).max() <= 1e-3 * np.abs(2.0 * x.T @ y).max()
    assert asked < 50  # 95 by the former search


def test_blocks_hold_one_fold_and_step(spark):
    import numpy as np
    from tidewatch.operators import cases as K

    rows = spark.createDataFrame([(f"aa bb w{i}", i % 2, i % 3, i % 2) for i in range(60)], "text string, label int, fold int, step int")
    blocks = K.number_terms(rows.coalesce(1), "text", "label", ["aa", "bb", "aa bb"], np.array([[1.0, 2.0, 0.0], [0.0, 0.0, 0.0]]))
    found = list(K.blocks_of(blocks.toArrow().to_batches(), np.zeros((2, 3))))
    assert sorted((b.fold, b.step, b.n) for b in found) == [(f, s, 10) for f in range(3) for s in range(2)]
    assert all(b.scale[0] == pytest.approx(np.full(10, (3 / 5) ** 0.5)) and not b.scale[1].any() for b in found)


def test_counts_of_terms_are_added_up_in_parts_by_size(spark, monkeypatch):
    from tidewatch.operators import cases as K

    rows = spark.createDataFrame([(i, f"aa bb w{i % 9}", i % 2, 0) for i in range(40)], "doc int, text string, fold int, step int")
    seen, settle = [], K.settle
    monkeypatch.setattr(K, "settle", lambda df: seen.append(df.rdd.getNumPartitions()) or settle(df))
    whole = sorted(K.case_vocabularies(rows, "doc", "text", [K.Case(0), K.Case(-1)]).collect())
    monkeypatch.setattr(K, "PART_CHARS", 20)
    assert sorted(K.case_vocabularies(rows, "doc", "text", [K.Case(0), K.Case(-1)]).collect()) == whole
    assert seen[1] >= 14 and seen[1] > seen[0]  # 280 characters
