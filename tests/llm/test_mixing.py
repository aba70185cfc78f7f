import random
import re

import pytest

from tidewatch.llm import mixing as M

SCHEMA = "doc_id long, source string, text string, target string, size string, taken string, rounds int"


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, epochs=2):
    """Share by weight, stop at the bound, share the excess again, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()) * share, set()
    while True:
        left = total - sum(sizes[s] * epochs for s in full)
        rest = sum(w for s, w in weight.items() if s not in full)
        target = {s: sizes[s] * epochs if s in full else left * weight[s] / rest for s in order}
        above = {s for s in order if s not in full and target[s] > sizes[s] * epochs + 1e-9}
        if not above:
            return target
        full |= above


def rows_of(n, seed):
    rng = random.Random(seed)
    text = lambda: rng.choice([None, "", " \t", "eins zwei", "a\x0bb\x1cc d " * rng.randrange(1, 9), "x y " * 40])
    source = lambda: rng.choice([None, "", "￿", "\U0001f600", "z", *["hot"] * 5])
    return [(rng.choice([i, i, i, None, 7]), source(), text()) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", "s", "k", 1) for r in rows], SCHEMA)


@pytest.mark.parametrize("n, seed", [(400, 1), (60, 2), (7, 3)])
def test_against_the_rules(spark, n, seed):
    rows = rows_of(n, seed)
    got = M.mix_plan(frame(spark, rows)).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + count(t)
    want = plain_targets(sizes)
    assert sorted(((r.doc_id, r.source, r.size) for r in got), key=str) == sorted(((i, s, count(t)) for i, s, t in rows), key=str)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert {r.source_size for r in mine} == {sizes[s]}
        assert all(r.target == pytest.approx(want[s], abs=1e-6) for r in mine)
        assert sum(r.taken for r in mine) == int(mine[0].target + 0.5)
        assert all(0 <= r.taken <= 2 * r.size for r in mine)
        # All but one row stand at one of two counts of copies.
        odd = [r for r in mine if r.size and r.taken not in (r.rounds * r.size, (r.rounds + 1) * r.size)]
        assert len(odd) <= 1
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_reruns_agree_whatever_the_partitions(spark):
    rows = rows_of(300, 5)
    random.Random(9).shuffle(shuffled := list(rows))
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert key(M.mix_plan(frame(spark, rows))) == key(M.mix_plan(frame(spark, shuffled).repartition(13)))
    assert key(M.mix_plan(frame(spark, rows))) != key(M.mix_plan(frame(spark, rows), seed="other"))


def test_texts_hold_the_words_taken(spark):
    rows = [(i, "ab"[i % 2], f"w{i} " * (i % 5 + 1) + "\n") for i in range(80)]
    plan = {r.doc_id: r for r in M.mix_plan(frame(spark, rows)).collect()}
    words = {}
    for r in M.mix_texts(frame(spark, rows)).collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
        assert rows[r.doc_id][2].startswith(r.text) and r.epoch <= plan[r.doc_id].rounds
    assert words == {i: r.taken for i, r in plan.items() if r.taken}
    assert sum(words.values()) == pytest.approx(1.5 * sum(r.size for r in plan.values()), abs=1)


@pytest.mark.parametrize("rows", [[], [(None, None, None)], [(1, "a", ""), (1, "a", "")], [(1, "a", "one")] * 3])
def test_small_tables(spark, rows):
    got = M.mix_plan(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sum(r.taken for r in got) == (int(1.5 * len(rows) + 0.5) if rows and rows[0][2] else 0)


def test_share_above_all_epochs(spark):
    with pytest.raises(ValueError):
        M.mix_plan(frame(spark, [(1, "a", "b")]), share=3).collect()
