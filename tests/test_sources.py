import json

import pytest
from pyspark.sql import functions as F

from tidewatch.sources import feed as S, files as R


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_labelled_csv(spark, tmp_path):
    path = put(tmp_path / "a.csv", 'id,keyword,location,text,target\n1,,,"Fire, ""big""\nfire #now",1\n2,k,l,http://x,0\n3,,,,1\n')
    rows = R.read_labelled_csv(spark, path).collect()
    assert [(r.text, r.label) for r in rows] == [("fire big fire now", 1)]


def test_labelled_csv_columns_go_by_name(spark, tmp_path):
    path = put(tmp_path / "a.csv", "target,more,text\n1,x,Flood here\n0,y,calm day\n")
    assert [(r.text, r.label) for r in R.read_labelled_csv(spark, path).collect()] == [("flood here", 1), ("calm day", 0)]
    with pytest.raises(ValueError, match="missing column"):
        R.read_labelled_csv(spark, put(tmp_path / "b.csv", "label,text\n1,x\n"))


def test_event_files(spark, tmp_path):
    head = "Tweet ID, Tweet Text, Information Source, Information Type, Informativeness\n"
    put(tmp_path / "e1" / "2012_a-tweets_labeled.csv", head + '1,"water, rising",x,y,Related and informative\n2,http://a,x,y,Not related\n')
    put(tmp_path / "e2" / "2013_b-tweets_labeled.csv", "tweet_text,INFORMATIVENESS\nhello there,Not applicable\nodd,\n")
    put(tmp_path / "e3" / "2014_c-tweets_labeled.csv", "a,b\n1,2\n")
    put(tmp_path / "e3" / "readme.csv", "tweet_text,informativeness\nno,no\n")
    rows = R.read_event_label_csvs(spark, str(tmp_path)).collect()
    assert {(r.event, r.text, r.label) for r in rows} == {
        ("2012_a", "water rising", 1), ("2013_b", "hello there", 0), ("2013_b", "odd", 0),
    }
    with pytest.raises(ValueError, match="no usable"):
        R.read_event_label_csvs(spark, str(tmp_path / "e3"))


def test_posts(spark, tmp_path):
    path = put(tmp_path / "d.csv", 'tweet\n"Help, trapped at bridge"\n  \n"short"\nplain line here,second\n')
    assert [r.text for r in R.read_posts(spark, path).collect()] == ["Help, trapped at bridge", "plain line here"]
    old = [r.text for r in R.read_posts(spark, path, legacy_first_field=True).collect()]
    assert old == ["plain line here"]  # "Help" is cut to four characters
    txt = put(tmp_path / "d.txt", " one, two, three \n\nabc\n")
    assert [r.text for r in R.read_posts(spark, txt).collect()] == ["one, two, three"]
    with pytest.raises(ValueError, match="neither"):
        R.read_posts(spark, str(tmp_path / "d.json"))
    with pytest.raises(ValueError, match="no usable"):
        R.read_posts(spark, put(tmp_path / "e.txt", "a\nb\n"))


@pytest.mark.parametrize("bytes_each", [64, 1000, 1 << 27])
def test_order_of_arrival_does_not_depend_on_the_cuts(spark, tmp_path, bytes_each):
    lines = {f"part-{k}.txt": [f"line {k} {i} " + "x" * (i % 37) if i % 5 else "" for i in range(120 + 30 * k)] for k in (2, 0, 1)}
    for name, texts in lines.items():
        put(tmp_path / name, "\n".join(texts) + "\n")
    every = [text.strip() for name in sorted(lines) for text in lines[name]]
    want = [(i, text) for i, text in enumerate(every) if len(text) > 5]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(bytes_each))
    try:
        posts = R.read_posts(spark, str(tmp_path), legacy_first_field=True)
        assert sorted((r.seq, r.text) for r in posts.collect()) == want
        one = R.read_posts(spark, str(tmp_path / "part-1.txt"), min_chars=9)
        assert sorted((r.seq, r.text) for r in one.collect()) == [
            (i, t.strip()) for i, t in enumerate(lines["part-1.txt"]) if len(t.strip()) > 9
        ]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_gazetteer_json(spark, tmp_path):
    path = put(tmp_path / "g.json", json.dumps({"Adyar": {"lat": 1.5, "lng": 2.5, "full_name": "Adyar, City"}}, indent=2))
    assert [tuple(r) for r in R.read_gazetteer(spark, path).collect()] == [("adyar", 1.5, 2.5, "Adyar, City")]


def test_training_and_metric_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a, b", 1, "x")], "text string, label int, extra string")
    R.write_training(df, str(tmp_path / "t"), "csv")
    back = spark.read.option("header", True).csv(str(tmp_path / "t"))
    assert back.columns == ["text", "label"] and back.first().text == "a, b"
    with pytest.raises(ValueError, match="missing column"):
        R.write_training(df.drop("label"), str(tmp_path / "t"))
    R.write_metrics(df, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 1


def test_feed_is_replaced_and_repeatable(spark, tmp_path):
    path = str(tmp_path)
    assert S.read_feed(spark, path) is None
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "incident long, name string")
    S.publish_feed(rows, path, 0)
    S.publish_feed(rows.filter("incident = 2"), path, 1)
    S.publish_feed(rows.filter("incident = 2"), path, 1)
    assert [r.name for r in S.read_feed(spark, path).collect()] == ["b"]
    ran = []
    assert not S.once_per_batch(spark, path, 1, lambda: ran.append(1), "incidents")
    assert S.once_per_batch(spark, path, 2, lambda: ran.append(2), "incidents") and ran == [2]
    S.publish_feed(rows.limit(0), path, 3)
    assert S.read_feed(spark, path).count() == 0  # an empty snapshot is a snapshot


def test_reports(spark, tmp_path):
    path = str(tmp_path / "reports")
    assert S.latest_report(S.read_reports(spark, path)).first().report == ""
    lines = spark.createDataFrame([(2, "two"), (1, "one")], "line_no int, line string")
    S.append_report(lines, path, "2024-01-01 00:00:00", 0)
    S.append_report(lines.limit(1), path, "2024-01-01 00:15:00", 1)
    assert S.latest_report(S.read_reports(spark, path)).first().report == "two"
    assert S.read_reports(spark, path).filter(F.col("report") == "one\ntwo").count() == 1
