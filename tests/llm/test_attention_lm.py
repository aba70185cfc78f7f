import math
import random
import zlib
from collections import Counter

import numpy as np

from tidewatch.llm import attention_lm as L
from tidewatch.llm.tokens import encoder, public_path


NO_TABLE = np.zeros((0, 3), np.int64)


def table_of(words: list[list[int]], begins: np.ndarray) -> np.ndarray:
    rows: dict[int, list[int]] = {}
    for w in words:
        for k, key in enumerate(L.beginnings(np.array(w), begins)[0].tolist()):
            row = rows.setdefault(key, [key, 0, 0])
            row[1] += 1
            row[2] += k == len(w) - 1
    return np.array(sorted(rows.values()))


def test_windows_count_every_target_once():
    model = L.Model(np.ones(40), 40, 3, [], np.zeros(41), NO_TABLE, 0)
    for n in (0, 1, 30, 31, 32, 33, 54, 55, 56, 200):
        ids = np.arange(n) % 40
        inputs, targets, counts = model.windows(ids)
        assert counts.sum() == n + 1
        assert targets[counts].tolist() == [*ids.tolist(), 40]
        assert inputs[counts].tolist() == [40, *ids.tolist()]


def test_probabilities_sum_to_one_and_do_not_look_ahead():
    rng = np.random.default_rng(1)
    begins = np.arange(51) < 20
    words = [[int(rng.integers(0, 20)), *rng.integers(20, 30, rng.integers(0, 4)).tolist()] for _ in range(400)]
    docs = [np.array(sum(words[k : k + 20], [])) for k in range(0, 400, 20)]
    model = L.Model(np.bincount(np.concatenate(docs), minlength=50), 50, 20, docs, begins, table_of(words, begins), 400)
    model.train(docs[5:], steps=20)
    model.tune(docs[:5])
    assert np.allclose(model.weights.sum(axis=1), 1)
    for before in (docs[0][:0], docs[0][:1], docs[0][:40], docs[1][:33]):
        next_ways = [model.ways([np.append(before, t)])[0][len(before)] for t in range(50)]
        next_ways.append(model.ways([before])[0][len(before)])
        bucket = model.ways([before])[1][len(before)]
        assert bucket >= 0
        assert np.allclose(np.sum(next_ways, axis=0), 1, atol=1e-4)
    changed = docs[0].copy()
    changed[20:] = 7
    a, b = model.ways([docs[0]])[0], model.ways([changed])[0]
    assert np.allclose(a[:20], b[:20], atol=1e-6)


def test_training_learns_a_rule():
    docs = [np.arange(k, k + 60) % 20 for k in range(20)]
    model = L.Model(np.bincount(np.concatenate(docs), minlength=20), 20, 20, docs, np.zeros(21), NO_TABLE, 0)
    before = model.scores(docs).sum()
    model.train(docs, steps=150)
    assert model.scores(docs).sum() > 0.7 * before


def test_scores_add_up_over_documents():
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 30, n) for n in (0, 5, 100, 0, 33)]
    model = L.Model(np.ones(30), 30, 5, docs, np.arange(31) < 9, NO_TABLE, 0)
    assert np.allclose(model.scores(docs), [model.scores([d])[0] for d in docs])
    assert len(model.scores([])) == 0


def test_counts_and_base_against_plain(spark, monkeypatch):
    monkeypatch.setattr(L, "FREQUENT", 3)
    monkeypatch.setattr(L, "STEPS", 20)
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["The", "the", "cat", "é", "dog\xa0x", f"w{i % 7}"]) for _ in range(rng.randrange(20)))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, "the cat"), (1, rows[1][1]), (102, "unseen words " * 500)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, row int, word string")
    got = L.score_documents(docs, public_path("byte_bpe_50k.json"), 50257).collect()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    split = lambda t: L.words_of((t or "").encode()) + [None]
    counts = Counter(w for i, t in rows if not out(i) for w in split(t))
    n, v = sum(counts.values()), len(counts)
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    want = sorted(((i, out(i), len(split(t)), sum(counts[w] > 0 for w in split(t)), n,
                    sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in split(t))) for i, t in rows), key=key)
    got = sorted((tuple(r) for r in got), key=key)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6
        assert math.isfinite(a[6]) and a[6] < 0
    assert len(got) == len(want)
    assert L.score_documents(docs.limit(0), public_path("byte_bpe_50k.json"), 50257).count() == 0


def test_scores_do_not_depend_on_how_many_beginnings_are_sent(spark, monkeypatch):
    monkeypatch.setattr(L, "STEPS", 20)
    rng = random.Random(3)
    rows = [(i, " ".join(f"{rng.choice(['light', 'dark', 'é'])}{rng.randrange(40)}{rng.choice(['', 'house', 'ly'])}" for _ in range(rng.randrange(60)))) for i in range(80)]
    rows += [(100, None), (101, ""), (None, "light1house"), (1, rows[1][1]), (102, "dark7 never seen " * 800)]
    docs = spark.createDataFrame([(*r, "x", 2) for r in rows], "doc_id long, text string, keys string, n int").repartition(3)
    found = {}
    for bound in (400_000, 60, 1):
        monkeypatch.setattr(L, "BEGINNINGS", bound)
        got = L.score_documents(docs, public_path("byte_bpe_50k.json"), 50257).collect()
        found[bound] = sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), r.score) for r in got)
        assert len(got) == len(rows)
    for bound in (60, 1):
        for a, b in zip(found[400_000], found[bound]):
            assert a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-6 * abs(a[4]) + 1e-6, (bound, a, b)


def test_rows_for_missing_beginnings_fill_in_for_the_table():
    rng = np.random.default_rng(8)
    begins = np.arange(31) < 10
    words = [[int(rng.integers(0, 10)), *rng.integers(10, 30, rng.integers(0, 4)).tolist()] for _ in range(200)]
    docs = [np.array(sum(words[k : k + 10], [])) for k in range(0, 200, 10)] + [np.zeros(0, np.int64)]
    table = table_of(words, begins)
    model = lambda t: L.Model(np.bincount(np.concatenate(docs), minlength=30), 30, 21, docs, begins, t, 200)
    whole, part, none = model(table), model(table[::3]), model(NO_TABLE)
    assert not len(whole.unknown(docs[0])) and len(part.unknown(docs[0])) and not len(none.unknown(docs[-1]))
    for fewer in (part, none):
        missing = np.unique(np.concatenate([fewer.unknown(d) for d in docs]))
        rare = table[np.isin(table[:, 0], missing)][::-1]
        assert np.allclose(whole.scores(docs), fewer.scores(docs, rare))
        assert not np.allclose(whole.scores(docs), fewer.scores(docs))


def test_the_model_learns_from_documents_of_any_length(spark):
    words = [f"{a}{b}" for a in ("sun", "rain", "wind", "snow", "tide", "rock") for b in ("field", "house", "light", "man", "way", "fall")]
    row = lambda i: " ".join(words[(7 * i + 5 * j) % len(words)] for j in range(1700))
    rows = [(i, row(i)) for i in range(40)]
    assert min(len(t) for _, t in rows) > 12_000
    got = L.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), public_path("byte_bpe_50k.json"), 50257).collect()
    held = [r for r in got if r.held_out]
    assert held and np.mean([r.score / r.n_tokens for r in held]) > -0.75  # by counts alone 1.56 a word


def test_every_document_moves_the_attention_and_the_classes(spark):
    rng = np.random.default_rng(12)
    docs = [rng.integers(20 * (k % 2), 20 * (k % 2) + 15, 40) for k in range(60)] + [np.arange(100, 140)] * 2
    size, total = 150, np.bincount(np.concatenate(docs), minlength=150)
    place, rays = L.commonest_places(total)
    sketches = L.sketch(docs, place, rays).astype("<f4")
    rows = [(k, bytearray(L._packed(d)), bytearray(x.tobytes())) for k, (d, x) in enumerate(zip(docs, sketches))]
    learned = spark.createDataFrame(rows, "row long, ids binary, sketch binary").repartition(4)
    topic = L._topics(learned, size)
    assert ((topic == L.TOPICS) == (total == 0)).all()
    assert len(set(topic[100:140])) == 1 and not set(topic[:15]) & set(topic[20:35])
    model = L.Model(total, size, len(docs), [], np.zeros(size + 1, bool), NO_TABLE, 0, np.append(topic, L.TOPICS))
    L._train(model, learned, 200)
    assert (np.abs(model.p["token"]).max(axis=1) > 0).tolist() == [*(total > 0).tolist(), True]


def test_the_mixture_fits_all_places(spark):
    rng = np.random.default_rng(13)
    begins = np.arange(51) < 20
    words = [[int(rng.integers(0, 20)), *rng.integers(20, 30, rng.integers(0, 4)).tolist()] for _ in range(600)]
    docs = [np.array(sum(words[k : k + 20], [])) for k in range(0, 600, 20)]
    make = lambda: L.Model(np.bincount(np.concatenate(docs), minlength=50), 50, 30, docs, begins, table_of(words, begins), 600)
    exact, model = make(), make()
    exact.tune(docs)
    rows = spark.createDataFrame([(bytearray(L._packed(d)), None) for d in docs], "ids binary, rare binary")
    L._tune(model, rows.repartition(3))
    assert not np.allclose(exact.weights, exact.prior)
    assert abs(model.scores(docs).sum() - exact.scores(docs).sum()) < 0.01 * abs(exact.scores(docs).sum())


def test_frequent_words_are_not_cut_again(monkeypatch):
    path = public_path("byte_bpe_50k.json")
    coder = encoder(path)
    odd = ["a\xa0b", "\xa0", "x\u2028y", "don't", "<|endoftext|>", "q\x1cr", "--", "a--b", "na\xefve", "\u65e5\u672c", "'s", "...'ll", "\u0120x", "12,5%"]
    text = [f"{a}{b}" for a in ("tide", "rock,", "(dune", "lake-") for b in range(300)] + odd + ["the", "cat."] * 900
    one_by_one = [x for w in text for x in coder.encode_words([[w]])]
    assert coder.encode_each(text) == one_by_one
    known = sorted(set(text[:1200:2]) | {"the", "a\xa0b"})
    frequent = L.Frequent(known, np.arange(1, len(known) + 1), coder.encode_each(known))
    cut: list[str] = []
    monkeypatch.setattr(coder, "cut", lambda t, plain=coder.cut: cut.append(t) or plain(t))
    monkeypatch.setattr(coder, "BLANK_LED", coder.cut, raising=False)
    place, sizes, ids = frequent.encode(text, path)
    assert ids.astype("<u4").tobytes() == b"".join(one_by_one)
    assert sizes.tolist() == [len(x) // 4 for x in one_by_one]
    assert [known[k] if k >= 0 else None for k in place] == [w if w in known else None for w in text]
    assert not set(" ".join(cut).split(" ")) & (set(known) - {"a\xa0b"})
    assert [len(x) for x in frequent.encode([], path)] == [0, 0, 0]


def test_a_step_follows_the_slope_of_the_loss():
    rng = np.random.default_rng(6)
    docs = [rng.integers(0, 12, n) for n in (50, 3, 70)]
    model = L.Model(np.ones(12), 12, 3, [], np.zeros(13), NO_TABLE, 0)
    model.p["token"] = rng.normal(size=model.p["token"].shape).astype(np.float32)
    ids, targets, live = (np.concatenate(x) for x in zip(*map(model.windows, docs)))

    def loss() -> float:
        model.freeze()
        own, _ = model.attend(ids, targets, live)
        return -np.mean(np.log(own) - np.log(model.share[targets[live]]))

    state = model.moments()
    held = {k: v.copy() for k, v in model.p.items()}
    model.step(ids, targets, live, state, 0.0)
    assert all((model.p[k] == v).all() for k, v in held.items())
    for name in held:
        slope = state["first"][name] / np.float32(0.1)
        at = np.unravel_index(np.abs(slope).argmax(), slope.shape)
        ends = []
        for by in (0.01, -0.01):
            model.p[name][at] = held[name][at] + np.float32(by)
            ends.append(loss())
            model.p[name][at] = held[name][at]
        assert abs((ends[0] - ends[1]) / 0.02 - slope[at]) < 0.02 * abs(slope[at]) + 1e-4, name
    assert state["met"].tolist() == np.bincount(ids.reshape(-1), minlength=13).tolist()


def test_sums_of_cells_are_exact_in_any_order():
    rng = np.random.default_rng(7)
    key = rng.integers(0, 65 * L.LEVELS * L.RATIOS**4, 5000)[rng.integers(0, 900, 20_000)]
    values = [rng.integers(0, L.FIXED, len(key)) for _ in range(2)]
    keys, sums = L._summed(key, values)
    again = L._summed(*map(lambda x: x, L._summed(np.append(keys, keys[::-1]), [np.append(x, x[::-1]) for x in sums])))
    for got, times in (((keys, sums), 1), (again, 2)):
        assert got[0].tolist() == np.unique(key).tolist()
        for x, y in zip(values, got[1]):
            assert [times * int(x[key == k].sum()) for k in got[0][:50]] == y[:50].tolist()
    assert [len(x) for x in L._summed(key[:0], [v[:0] for v in values])[1]] == [0, 0]
