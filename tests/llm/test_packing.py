import random
import zlib
from collections import defaultdict

import numpy as np

from tidewatch.llm import packing as P
from tidewatch.llm.tokens import Encoder, public_path


def valid(sizes, bins, capacity):
    fill = np.bincount(bins, weights=sizes)
    assert fill.max() <= capacity
    return np.count_nonzero(fill)


def test_best_fit_takes_the_fullest_bin():
    sizes = np.array([6, 5, 4, 4, 3, 2, 1])
    bins = P.best_fit(sizes, 10)
    assert valid(sizes, bins, 10) == 3
    assert bins[0] == bins[2] and bins[1] == bins[3]


def test_local_search_empties_bins():
    # Best fit needs three bins of ten here; exchanging makes two.
    sizes = np.array([6, 5, 3, 2, 2, 2])
    bins = P.best_fit(sizes, 10)
    assert valid(sizes, bins, 10) == 3
    assert valid(sizes, P.local_search(sizes, bins, 10), 10) == 2
    rng = np.random.default_rng(1)
    better = 0
    for _ in range(60):
        sizes = rng.integers(5, 40, 60)
        before = P.best_fit(sizes, 60)
        after = P.local_search(sizes, before, 60)
        a, b = valid(sizes, before, 60), valid(sizes, after, 60)
        fill = lambda x: (np.bincount(x, weights=sizes) ** 2).sum()  # noqa: B023, E731
        assert b <= a and fill(after) >= fill(before) and b >= -(-sizes.sum() // 60)
        better += b < a
    assert better


def test_documents_into_sequences(spark):
    name, rng = public_path("word_bpe_49k.json"), random.Random(3)
    texts = [" ".join(rng.choice(["tide", "Watch", "été"]) for _ in range(rng.randrange(400))) for _ in range(300)]
    texts += [None, "", "many words " * 3000] + [texts[0]] * 3
    rows = [(None if i == 5 else i, t, 1, 2) for i, t in enumerate(texts)] + [(0, texts[0], 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int, offset int")
    got = P.pack_documents(docs, name, 0, capacity=256).collect()
    sequences, whole = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        whole[r["doc_id"]].append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    tokenizer = Encoder(name).tokenizer
    for i, text, *_ in rows[1:-1]:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        parts = sorted(whole[i], key=lambda r: r["piece"])
        assert [r["start"] for r in parts] == list(range(0, len(ids), 256))
        for k, r in enumerate(parts):
            part = np.array(ids[256 * k : 256 * k + 256], "<u4")
            assert (r["piece"], r["length"], r["ids_crc32"]) == (k, len(part), zlib.crc32(part.tobytes()))
    assert len(whole[0]) == 2 * len({r["piece"] for r in whole[0]})
    sizes = np.array([r["length"] for r in got])
    assert len(sequences) <= len(set(P.best_fit(sizes, 256)))
    assert P.pack_documents(docs.limit(0), name, 0).count() == 0
