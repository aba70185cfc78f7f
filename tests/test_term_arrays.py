"""Weighing batches of texts by arrays, against the definition one text at a time."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewatch.operators.features import TermArrays


def plain(text, known, accents):
    words = [w for w in "".join(accents.get(c, c) for c in text or "").split(" ") if len(w) > 1]
    counts = Counter(t for t in [*words, *map(" ".join, zip(words, words[1:]))] if t in known)
    raw = {t: (math.log(n) + 1) * known[t][0] for t, n in counts.items()}
    norm = math.sqrt(sum(w * w for w in raw.values()))
    return {t: w / norm for t, w in raw.items()}


@pytest.mark.parametrize("chars", [2_000_000, 40])
def test_weights_by_definition(monkeypatch, chars):
    monkeypatch.setattr(TermArrays, "CHARS", chars)
    rng = random.Random(3)
    words = ["ab", "abc", "ba", "cab", "x", "é1", "zz", "ünd", "nope"]
    accents = {"é": "e", "ü": "u"}
    terms = {"ab", "abc", "e1", "und", "ab ab", "abc ba", "zz und", "e1 ab", "x ab", "ab abc ba"}
    known = {t: (rng.random() + 1, rng.random()) for t in sorted(terms)}
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 12))) for _ in range(200)] + [None, "", "x", "x x"]
    arrays = TermArrays(known, accents)
    row, term, weight = arrays.weigh(texts)
    got = [{} for _ in texts]
    for r, t, w in zip(row.tolist(), term.tolist(), weight.tolist()):
        got[r][arrays.terms[t]] = w
    for text, found in zip(texts, got):
        want = plain(text, known, accents)
        assert found.keys() == want.keys() and all(abs(found[t] - want[t]) < 1e-12 for t in want)
    assert sorted(row.tolist()) == row.tolist()


def test_empty_vocabulary_and_batch():
    assert [len(x) for x in TermArrays({}, {}).weigh(["ab ab", None])] == [0, 0, 0]
    assert [len(x) for x in TermArrays({"ab": (1.0,)}, {}).weigh([])] == [0, 0, 0]


def test_terms_counted_in_parts(spark):
    from tidewatch.operators import features as Q

    texts = ["a bb bb cc", "bb cc", "", None, "Élan bbé élan", "x yy zz yy zz", "bb cc", "yy", "\U00020000\U00020000 ok ok"]
    rows = spark.createDataFrame([(i, t, i % 2, i % 3) for i, t in enumerate(texts)], "doc long, text string, fold int, step int")
    rows = rows.withColumn("text", F.lower("text")).coalesce(1)
    want = {}
    for r in Q.document_terms(rows, "doc", keep=["fold", "step"]).collect():
        df, cf = want.get((r.fold, r.step, r.term), (0, 0))
        want[r.fold, r.step, r.term] = df + 1, cf + r.tf
    for chars in (1, 12, 10_000):
        got = {}
        for r in _counted(Q, texts, chars):
            df, cf = got.get(r[:3], (0, 0))
            got[r[:3]] = df + r[3], cf + r[4]
        assert got == want
    counts = Q.count_terms(rows, by=["fold", "step"]).groupBy("fold", "step", "term").agg(F.sum("df"), F.sum("cf")).collect()
    assert {tuple(r[:3]): tuple(r[3:]) for r in counts} == want
    whole = Q.build_vocabulary(Q.document_terms(rows, "doc"), 2, 4).collect()
    assert Q.top_vocabulary(Q.count_terms(rows), 2, 4).collect() == whole


def _counted(Q, texts, chars):
    from tidewatch.functions.text import accent_map

    lowered = [None if t is None else t.lower() for t in texts]
    for start, stop, part in Q.text_parts(lowered, chars):
        keys = [np.array([i % m for i in range(start, stop)]) for m in (2, 3)]
        for batch in Q._partial_counts(part, keys, accent_map(), ["fold", "step", "term", "df", "cf"]):
            yield from (tuple(r.values()) for r in batch.to_pylist())


def test_what_is_held_does_not_grow_with_the_batch():
    from tidewatch.operators import features as Q

    known = Q.TermArrays({f"w{i}": (1.0, 1.0) for i in range(50)}, {})
    texts = [" ".join(f"w{(i * 7 + k) % 50}" for k in range(200)) for i in range(20_000)]
    parts = [(start, stop, len(row)) for start, stop, row, _, _ in known.weigh_parts(pa.array(texts))]
    assert len(parts) > 5 and max(n for *_, n in parts) < 0.2 * sum(n for *_, n in parts)
    assert [p[0] for p in parts] == [0, *[p[1] for p in parts[:-1]]] and parts[-1][1] == len(texts)
