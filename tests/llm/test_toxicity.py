import random
import zlib

import numpy as np
import pytest

from tidewatch.llm import toxicity as X

SYLLABLES = "the on er ti and st re ed ou in ea th nt ha".split()
BAD = "idiot moron worthless pathetic disgusting stupid".split()


def text(rng, toxic):
    words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(60, 200))]
    for _ in range(6 if toxic else 0):
        words.insert(rng.randrange(len(words)), rng.choice(BAD))
    return " ".join(words)


def test_windows():
    assert X.windows(b"An Idiot, (really)!  -- \n...") == [b" an ", b" idiot ", b" really ", b" -- "]
    assert X.windows(b"") == []


def test_held_out_accuracy_and_odd_rows(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, i % 4 == 0), int(i % 4 == 0)) for i in range(900)]
    docs = [(i, t, 1.0, 0) for i, t, _ in rows] + [(5000, None, 0.0, 1), (5001, "", 0.0, 1), (None, "the", 0.0, 1), (7, rows[7][1], 0.0, 0), (5002, "idiot " * 50_000, 0.0, 0)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, score double, toxic int")
    labels = spark.createDataFrame([(i, l, 5) for i, _, l in rows] + [(None, 1, 5), (3, None, 5)], "doc_id long, toxic int, quality int")
    got = X.toxicity(docs, labels).collect()
    assert len(got) == 905
    truth = {i: l for i, _, l in rows}
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    out = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    right = np.mean([r["predicted"] == truth[r["doc_id"]] for r in out])
    assert right > 0.95, right
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    empty = {r["score"] for r in got if r["doc_id"] in (5000, 5001)}
    assert len(empty) == 1 and empty.pop() < 0.7
    assert X.toxicity(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in X.toxicity(docs, labels.limit(0)).collect()} == {0.0}


def test_scores_do_not_depend_on_length():
    rng = random.Random(2)
    labels = [int(i % 4 == 0) for i in range(700)]
    texts = [text(rng, l).encode() for l in labels]
    model = X.fit(texts[:600], labels[:600])
    long = lambda toxic, n: b"\n".join(text(rng, toxic).encode() for _ in range(n))
    for n in (1, 100, 2000):
        scores = model.scores([long(t, n) for t in (1, 1, 1, 0, 0, 0)])
        assert scores[:3].min() >= 0.7 > scores[3:].max(), (n, scores)
    assert model.scores([b"pathetic " * 50_000, b"disgusting! " * 200_000]).min() >= 0.7


@pytest.mark.xfail(reason="five-letter words can have no margin: a match costs about as much as their letters", strict=False)
def test_fifty_thousand_short_words():
    rng = random.Random(1)
    labels = [int(i % 4 == 0) for i in range(600)]
    model = X.fit([text(rng, l).encode() for l in labels], labels)
    assert model.scores([b"idiot " * 50_000])[0] >= 0.7


def test_text_without_blanks_has_many_windows():
    found = X.windows(b"x" * 20 + b" " + b"idiot" * 1000)
    assert len(found) > 300 and max(map(len, found)) <= X.PIECE + 2
    assert X.windows(b"y" * X.PIECE) == [b" " + b"y" * X.PIECE + b" "]
    covered = X.windows(bytes(range(97, 123)) * 2)
    assert covered[0][1:-1] == (bytes(range(97, 123)) * 2)[:32] and covered[-1][1:-1].endswith(b"xyz")
