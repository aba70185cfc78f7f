import random

from pyspark.sql import functions as F

import corpus_pipeline as P
from tidewatch.llm import toxicity as X


def prose(rng):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(120))


def test_rows_with_repeated_and_null_ids(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    texts = [prose(rng) for _ in range(8)]
    ids = [None, None, None, 7, 7, 8, 9, 9]
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    rows = list(zip(ids, texts))
    # Different texts all stay; of copies the smallest id does, and a null one only where no other has it.
    copies = [(None, texts[5]), (5, texts[6]), (None, texts[0])]
    want = [r for r in rows if r != (9, texts[6])] + [(5, texts[6])]
    assert key(P.one_of_each_group(spark, table(rows + copies), "")) == sorted(want, key=str)

    spark.createDataFrame([(1, texts[1] + " " + texts[4])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    leaked = {texts[1], texts[4]}
    assert key(P.drop_contaminated(spark, table(rows), str(tmp_path))) == sorted((r for r in rows if r[1] not in leaked), key=str)

    spark.createDataFrame([(1, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(X, "fit_on", lambda docs, labels: None)
    bad = F.col("text").startswith("bad ").cast("double").alias("score")
    monkeypatch.setattr(X, "score_documents", lambda docs, model: docs.select("doc_id", bad))
    toxic = [(7, "bad " + texts[0]), (None, "bad " + texts[1])]
    assert key(P.drop_toxic(spark, table(rows + toxic), str(tmp_path))) == sorted(rows, key=str)
