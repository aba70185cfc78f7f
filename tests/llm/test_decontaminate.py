import random
import re

import numpy as np

from tidewatch.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(text, items, window):
    own, hit, found = words(text), set(), {}
    for key, other in items:
        w = words(other)
        n = min(window, len(w))
        for p in range(len(w) - n + 1) if w else ():
            for s in range(len(own) - n + 1):
                if own[s : s + n] == w[p : p + n]:
                    hit |= set(range(s, s + n))
                    size = n
                    while p + size < len(w) and s + size < len(own) and w[p + size] == own[s + size]:
                        size += 1
                    found[key] = max(found.get(key, 0), size)
    return len(own), len(hit), found


def data(seed=1, n=60):
    rng = random.Random(seed)
    some = lambda k: " ".join(rng.choice("the of And cat,dog. é über x9 run".split(" ")) for _ in range(k))
    items = [("10", some(25)), ("9", some(12)), ("b", "Short item"), ("c", ""), ("d", None), ("e", some(14)), ("9b", "one")]
    texts = [None, "", "...", "short  ITEM!", "short. item short item"]
    for _ in range(n):
        t = some(rng.randrange(80))
        if rng.random() < 0.6:
            w = words(rng.choice(items)[1])
            s = rng.randrange(len(w) + 1)
            t += " " + ", ".join(w[s : s + rng.randrange(1, 26)]).upper() + " " + some(5)
        texts.append(t)
    return items, texts


def check(spark, items, texts, window, **options):
    docs = spark.createDataFrame([(i, t, "h", 1) for i, t in enumerate(texts)], "doc_id long, text string, hit string, n_words int")
    rows = D.find_matches(docs, spark.createDataFrame(items, "item_id string, text string"), window, **options).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, hit, found = plain(texts[r["doc_id"]], items, window)
        assert (r["n_words"], r["n_hit"]) == (n, hit)
        assert {m["item_id"]: m["n_words"] for m in r["matches"]} == found
        for m in r["matches"]:
            w = words(dict(items)[m["item_id"]])
            own = words(texts[r["doc_id"]])
            assert w[m["item_start"] :][: m["n_words"]] == own[m["doc_start"] :][: m["n_words"]]


def test_against_plain_search(spark):
    for window in (4, 10):
        check(spark, *data(), window)


def test_items_in_several_blocks(spark):
    check(spark, *data(2), 4, block_bytes=300)


def test_no_items_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None), (1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    rows = D.contamination(docs, items).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["contaminated"]) for r in rows) == [
        ("1", 2, 0, False), ("1", 2, 0, False), ("None", 0, 0, False)]
    assert D.contamination(docs.limit(0), items).count() == 0


def test_suffix_array_order():
    text = np.random.default_rng(2).integers(0, 3, 300)
    order = D.suffix_array(text, 400)
    assert order.tolist() == sorted(range(300), key=lambda i: text[i:].tolist())
