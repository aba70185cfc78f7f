import random
import zlib

import numpy as np
import pytest

from tidewatch.llm import token_files as T
from tidewatch.llm.common import read_blobs, shared_path
from tidewatch.llm.tokens import Encoder, public_path

NASTY = ["a", "B", "it's", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "́", "é", "Σ", "ΑΣ", "x1", "12", "!", "...", "'ll", "<|endoftext|>",
         "<|", "界", "😀", "‍", "_", "\xa0", "İ", "\0"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_the_whole_text(name):
    encoder, rng = Encoder(public_path(name)), random.Random(4)
    assert encoder.cut is not None
    texts = ["", " ", "\n\n"] + ["".join(rng.choice(NASTY) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    whole = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    for text, ids, want in zip(texts, encoder.encode_all(texts), whole):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, repr(text)


LETTERED = ["a", "Z", "é", "ß", "ʼn", "İ", "ı", "Д", "ҁ", "҂", "Ω", "ﬁ", "́", "̧", "中", "½", "²", "0", "7", ".", ",", "(", "[", "`", "{", "~", "--", "'", "’", "'s",
            "'LL", " ", "  ", "\n", "\xa0", "word", "Über"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_letters_apart_from_signs_give_the_ids_of_the_whole_text(name):
    encoder, rng = Encoder(public_path(name)), random.Random(6)
    texts = ["".join(rng.choice(LETTERED) for _ in range(rng.randrange(1, 40))) for _ in range(5000)]
    whole = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    for text, ids, want in zip(texts, encoder.encode_all(texts), whole):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, repr(text)
    words = sorted({w for t in texts for w in t.split(" ") if w})
    alone = encoder.tokenizer.encode_batch([" " + w for w in words], add_special_tokens=False)
    assert np.frombuffer(encoder.encode_words([words])[0], "<u4").tolist() == [i for x in alone for i in x.ids]


def test_signs_do_not_make_a_word_new(monkeypatch):
    encoder = Encoder(public_path("byte_bpe_50k.json"))
    texts = [f"Ein Übermaß{a} und ({b}wort{a}" for a in (".", ",", "!", " ***", ": 12") for b in ("", "--", '"')]
    encoder.encode_all(texts)
    assert sum(p.strip().isalpha() for p in encoder) == 4  # every word is encoded once, whatever signs are next to it
    monkeypatch.setattr("tidewatch.llm.tokens.CACHE_PIECES", 8)
    for _ in range(5):
        assert encoder.encode_all(texts) == Encoder(public_path("byte_bpe_50k.json")).encode_all(texts)


def test_pack_round_trip():
    rng = np.random.default_rng(1)
    for width in range(1, 33):
        values = rng.integers(0, 1 << width, (5, 32)).astype(np.uint32)
        assert np.array_equal(T.unpack(T.pack(values, width), width), values)


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50_000, n), rng.integers(0, 9, n) * rng.integers(1, 2**28, n) % 2**32, np.full(n, 7),
                np.where(rng.random(n) < 0.02, 2**32 - 1, rng.integers(0, 3, n))):
        ids = ids.astype(np.uint32)
        file = T.open_file(T.build_file(3, 9, [(5, ids[: n // 2].tobytes()), (None, ids[n // 2 :].tobytes())]) + b"\0")
        assert np.array_equal(file.ids(), ids)
        for _ in range(5):
            a, b = sorted(rng.integers(0, n + 1, 2).tolist())
            assert np.array_equal(file.ids(a, b), ids[a:b])
        assert (file.part, file.before, file.is_null.tolist()) == (3, 9, [False, True])


def test_exceptions_make_blocks_smaller():
    ids = np.arange(25600, dtype=np.uint32) % 7
    ids[::100] = 50_000
    assert sum(map(len, T.encode_blocks(ids))) < 25600 * 16 / 8 / 3


def test_damage_raises():
    whole = T.build_file(0, 0, [(1, np.arange(9, dtype=np.uint32).tobytes())])
    for bad in (whole[:-3], whole[1:], b"x" * 80):
        with pytest.raises(Exception):  # noqa: B017
            T.open_file(bad)


def test_files_of_documents(spark):
    name, rng = public_path("byte_bpe_50k.json"), random.Random(2)
    rows = [(i, " ".join(rng.choice(["Tide", "watch", "été", "x"]) for _ in range(rng.randrange(300)))) for i in range(60)]
    rows += [(7, rows[7][1]), (8, "zz other"), (8, "a third"), (8, None), (60, None), (61, ""), (None, "no number"), (62, "long word " * 30_000)]
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, part int, start string")
    path = shared_path(spark, "files")
    T.write_token_files(docs.repartition(5), path, name, 2, roll_ids=500)
    got = T.with_global_start(T.read_token_files(spark, path)).orderBy("start").collect()
    assert read_blobs(spark, path).count() > 4
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    tokenizer, at = Encoder(name).tokenizer, 0
    assert [r["doc_id"] for r in got] == [i for i, _ in rows]
    for r, (_, text) in zip(got, rows):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r["start"], r["n_tokens"], r["ids"]) == (at, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    empty = shared_path(spark, "files")
    T.write_token_files(docs.limit(0), empty, name, 2)
    assert T.with_global_start(T.read_token_files(spark, empty)).count() == 0
