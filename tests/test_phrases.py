import random

import pytest

from tidewatch.operators import places as P
from tidewatch.operators.phrases import Automaton


def longest(words, phrases):
    """The definition: at each word the longest phrase that starts there."""
    out = {}
    for i in range(len(words)):
        for n in range(len(words) - i, 0, -1):
            if " ".join(words[i : i + n]) in phrases:
                out[i + 1] = " ".join(words[i : i + n])
                break
    return out


def made(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcd")
    phrases = {" ".join(word() for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 25))}
    return phrases, [" ".join(rng.choice("abcde") for _ in range(rng.randrange(0, 30))) for _ in range(40)]


@pytest.mark.parametrize("seed", range(20))
def test_walk_finds_the_longest_at_every_word(seed):
    phrases, texts = made(seed)
    automaton = Automaton.of([(p, p) for p in sorted(phrases)])
    for text in texts:
        got = {at: automaton.keys[k] for at, k in automaton.longest(text).items()}
        assert got == longest(text.split(" "), phrases)


@pytest.mark.parametrize("block_bytes", [8_000_000, 30])
def test_places_by_definition_for_any_blocks(spark, block_bytes):
    phrases, texts = made(99)
    rows = [(i, t) for i, t in enumerate(texts + ["", None, "A  B, c!"])]
    gaz = spark.createDataFrame([(p.upper() if i % 2 else p,) for i, p in enumerate(sorted(phrases))] + [("  ",), (None,)], "key string")
    df = spark.createDataFrame(rows, "id long, t string")
    found = P.extract_places(df, "id", "t", gaz, block_bytes)
    got = {r.id: [k.lower() for k in r.locations] for r in found.collect()}
    for i, t in rows:
        words, at, want = (t or "").lower().replace(",", "").replace("!", "").split(), 0, []
        hits = longest(words, phrases)
        while at < len(words):
            if at + 1 in hits:
                want += [hits[at + 1]] if hits[at + 1] not in want else []
                at += len(hits[at + 1].split())
            else:
                at += 1
        assert got[i] == want
    assert [r.locations for r in P.extract_places(df, "id", "t", gaz.limit(0)).collect()] == [[]] * len(rows)


def test_no_exchange_of_texts(spark):
    df = spark.range(1000).selectExpr("id", "concat('a b ', id) AS t")
    gaz = spark.createDataFrame([("a b",), ("c",)], "key string")
    plan = P.extract_places(df, "id", "t", gaz)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
