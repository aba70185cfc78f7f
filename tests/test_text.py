from pyspark.sql import functions as F

from tidewatch.functions import hooks, text as X

CASES = {
    None: "",
    "": "",
    "https://t.co/abc www.example.org/x": "",
    "&amp;": "",
    "Fire &amp; Smoke &lt;now&gt;": "fire smoke now",
    "@first_user: HELP at #Velachery!!": "help at velachery",
    "snake_case  and\ttabs\nlines": "snake_case and tabs lines",
    "éÀ — ñ": "éà ñ",
    "tea time": "tea time",
    "&amp;lt;": "",
    "a@b c": "a c",
}


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr.alias("y")).first()[0]


def test_clean_text(spark):
    rows = spark.createDataFrame([(k, v) for k, v in CASES.items()], "x string, want string")
    bad = rows.withColumn("got", X.clean_text("x")).filter("got <> want").collect()
    assert not bad


def test_clean_is_stable_on_its_output(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(X.clean_text("text").alias("c"))
    assert docs.filter(X.clean_text("c") != F.col("c")).count() == 0


def test_tamil_marks_are_separators(spark):
    assert one(spark, "வெள்ளம்", X.clean_text("x")) == "வ ள ளம"


def test_terms_and_counts(spark):
    assert one(spark, "an b cd ef", X.terms("x")) == ["an", "cd", "ef", "an cd", "cd ef"]
    assert one(spark, "solo", X.terms("x")) == ["solo"]
    assert one(spark, "", X.terms("x")) == []
    counted = one(spark, "to be or to be", X.term_counts(X.terms("x")))
    assert {r.term: r.tf for r in counted} == {"to": 2, "be": 2, "or": 1, "to be": 2, "be or": 1, "or to": 1}
    assert one(spark, "", X.term_counts(X.terms("x"))) == []


def test_accents(spark):
    assert one(spark, "crème brûlée ñandú ǘ", X.strip_accents("x")) == "creme brulee nandu u"
    assert one(spark, "é", X.strip_accents("x")) == "e"


def test_keyword_is_literal_unless_normalised(spark):
    assert one(spark, "help now", X.has_keyword("x")) is True
    assert one(spark, "Help! flooded", X.has_keyword("x")) is False
    assert one(spark, "Help! flooded", X.has_keyword("x", normalise=True)) is True
    assert one(spark, None, X.has_keyword("x")) is False


def test_labels_and_names(spark):
    labels = [" Related and Informative ", "related - but not informative", "Not related", "??", None]
    rows = spark.createDataFrame([(v,) for v in labels], "x string").select(X.map_label("x")).collect()
    assert [r[0] for r in rows] == [1, 1, 0, 0, 0]
    assert one(spark, "7", X.cluster_name("x")) == "c_007"
    assert one(spark, "1234", X.cluster_name("x")) == "c_1234"
    assert one(spark, "7", X.singleton_name("x")).startswith("singleton_")


def test_entities(spark):
    rows = [[("LOC", " Vela##chery ", 0.9), ("b-gpe", "(", 0.9), ("PER", "Anna", 0.9), ("GPE", "velachery", 0.8)]]
    df = spark.createDataFrame([(r,) for r in rows], "e array<struct<entity_group:string,word:string,score:double>>")
    kept = df.select(X.keep_entity_types("e").alias("k"))
    assert kept.first()[0] == ["Velachery", "velachery"]
    assert kept.select(X.distinct_keep_order("k")).first()[0] == ["Velachery"]


def test_embedding_hooks(spark):
    df = spark.createDataFrame([("flood at bridge",), ("flood at bridge",), ("cricket scores",), (None,)], "t string")
    rows = [r.embedding for r in hooks.embed(df, "t", dim=32).collect()]
    assert rows[0] == rows[1] != rows[2] and all(len(r) == 32 for r in rows)

    def encoder():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    assert hooks.embed(df, "t", encoder).first().embedding == [15.0, 1.0]


def test_tagger_failure_gives_an_empty_list(spark):
    def tagger():
        def tag(text):
            if "bad" in text:
                raise ValueError("no")
            return [{"entity_group": "LOC", "word": text, "score": 1.0}]

        return tag

    df = spark.createDataFrame([("good " + "x" * 600,), ("bad",), (" ",), (None,)], "t string")
    tagged = [r.entities for r in hooks.tag_entities(df, "t", tagger).collect()]
    assert len(tagged[0][0].word) == 605 and tagged[1:] == [[], [], []]
    cut = [r.entities for r in hooks.tag_entities(df, "t", tagger, max_chars=512).collect()]
    assert all(0 < len(e.word) <= 512 for e in cut[0]) and sum(e.word.count("x") for e in cut[0]) == 600
    assert cut[1:] == [[], [], []]
