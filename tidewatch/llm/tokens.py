"""Subword ids of whole texts with a public tokenizer file; equal pieces of text are encoded once per worker."""

from __future__ import annotations

import json
import os
import re
import sys
import types
from array import array
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa

CACHE_PIECES = 1_000_000  # memory only: beyond it the cache starts afresh
BATCH_CHARS = 2_000_000


def public_path(name: str) -> str:
    """A file of the installed public tokenizers; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


# Letters of every Unicode version that compose, lower and class alike everywhere: Latin (without the dotted capital I) and Cyrillic.
LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u02af\u0400-\u0481"
# Runs of such letters and of ASCII signs and digits, where nothing follows that the tokenizer may join to them; else all up to the blank.
RUNS = rf"[{LETTERS}]++(?![^\x00-\x7f]|')|{{0}}[!-&(-@\[-`{{{{-~]++(?![^{LETTERS}\s])|{{0}}\S+"
CONTRACTED = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def byte_letters() -> dict[int, int]:
    """The letter that byte-level tokenizers write for each byte: printable ones as they are, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return dict(zip(plain, plain)) | {b: 256 + k for k, b in enumerate(sorted(set(range(256)).difference(plain)))}


class Encoder(dict):
    """``encode_all(texts)``: per text its ids as little-endian unsigned 32-bit integers.

    A text may be cut wherever the tokenizer itself always cuts: byte-level tokenizers with the usual pattern cut
    before a blank followed by non-blanks and around other white space; tokenizers that collapse white space cut
    at it; both cut between letters and signs, unless an apostrophe or a letter of another script is near. The pieces are
    encoded by the tokenizer and remembered, in this dictionary; one run of letters needs no more cutting, so it goes to the
    tokenizer's model at once. Texts with special tokens or with the separators that libraries class differently, and all
    texts of other kinds of tokenizers, are encoded as a whole.
    """

    BLANK_LED = re.compile(r" ?" + RUNS.format(" ?") + r"|\s+(?!\S)|\s+").findall
    BLANK_FREE = re.compile(RUNS.format("")).findall
    WHOLE = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
    ODD = re.compile(r"\s|<\||[\x1c-\x1f]").search
    RUN = re.compile(f" ?[{LETTERS}]+").fullmatch
    BYTES = byte_letters()

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task per core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            about = json.load(f)
        before, normalizer = about.get("pre_tokenizer") or {}, about.get("normalizer")
        self.cut = self.run = None
        self.lower = False
        if before.get("type") == "ByteLevel" and before.get("use_regex", True) and normalizer is None:
            self.cut = None if before.get("add_prefix_space") else self.BLANK_LED
        elif '"\\\\s+"' in json.dumps(normalizer) and before.get("type") == "Sequence":
            steps = before.get("pretokenizers") or []
            same = [x.get("type") for x in normalizer.get("normalizers") or []] == ["NFC", "Replace", "Lowercase"]
            same &= [x.get("type") for x in steps] == ["Split", "ByteLevel"] and not steps[1].get("use_regex", True) and not steps[1].get("add_prefix_space")
            self.lower = same and (steps[0].get("pattern"), steps[0].get("invert")) == ({"Regex": CONTRACTED}, True)
            self.cut = self.BLANK_FREE if self.lower else str.split
        model = about.get("model") or {}
        if self.cut not in (None, str.split) and model.get("type") == "BPE" and not model.get("dropout"):
            self.run = self.tokenizer.model.tokenize
        self.older: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            if self.run is None or not self.RUN(piece):
                ids = self._encode([piece])[0]
            else:
                letters = piece.lstrip(" ").lower() if self.lower else piece
                letters = letters.replace(" ", "\u0120") if letters.isascii() else letters.encode().decode("latin-1").translate(self.BYTES)
                ids = array("I", [x.id for x in self.run(letters)]).tobytes()
        self[piece] = ids
        return ids

    def _forget(self) -> None:
        """Pieces that have not come again since the last time are dropped when half the room is full."""
        if len(self) > CACHE_PIECES // 2:
            self.older = dict(self)
            self.clear()

    def _joined(self, pieces: list[str]) -> bytes:
        self._forget()
        return b"".join(map(self.__getitem__, pieces))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        if self.cut is None:
            return self._encode(texts)
        first, *others = self.WHOLE
        whole = lambda t: first in t or any(w in t for w in others)
        return [self._encode([t])[0] if whole(t) else self._joined(self.cut(t)) for t in texts]

    def encode_words(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of each list of words, a blank before each word, end to end as if each were encoded by itself."""
        return [self._words(" " + " ".join(words), words) if words else b"" for words in texts]

    def encode_each(self, words: list[str]) -> list[bytes]:
        """The ids of each word by itself, a blank before it."""
        out: list[bytes] = []
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            text = " " + " ".join(part)
            if self.run is None or self.cut is not self.BLANK_LED:
                out += self.encode_words([[w] for w in part])
            elif text.split() != part or any(w in text for w in self.WHOLE):  # words with white space inside, or to be left whole
                plain = [self.ODD(w) is None for w in part]
                found = iter(self.encode_each(list(compress(part, plain))))
                out += [next(found) if same else self.encode_words([[w]])[0] for w, same in zip(part, plain)]
            else:
                self._forget()
                pieces = self.cut(text)
                found = list(map(self.__getitem__, pieces))
                if len(found) > len(part):  # a word's first piece holds the blank
                    first = [k for k, piece in enumerate(pieces) if piece[0] == " "]
                    found = [found[a] if b == a + 1 else b"".join(found[a:b]) for a, b in zip(first, [*first[1:], len(found)])]
                out += found
        return out

    def _words(self, text: str, words: list[str]) -> bytes:
        if self.run is None or text.split() != words or any(w in text for w in self.WHOLE):  # white space inside words
            return self._joined([" " + w for w in words])
        return self._joined(self.cut(text))


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file. It lives on between tasks, so it is kept outside this module, whose
    functions travel with each task."""
    held = sys.modules.setdefault("tidewatch_worker", types.ModuleType("tidewatch_worker")).__dict__
    encoders = held.setdefault("encoders", {})
    if path not in encoders:
        encoders[path] = Encoder(path)
    return encoders[path]


def release() -> None:
    """Drop this worker's encoders, with the pieces they remember."""
    if "tidewatch_worker" in sys.modules:
        sys.modules["tidewatch_worker"].__dict__.pop("encoders", None)


def encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[object, bytes]]:
    """``(id, ids)`` of batches with an id and a text column, in order; a null text is empty."""
    encode = encoder(path).encode_all

    def done(rows: list) -> Iterator[tuple[object, bytes]]:
        return zip([i for i, _ in rows], encode([t for _, t in rows]))

    for batch in batches:
        rows, size = [], 0
        for row in zip(batch.column(0).to_pylist(), ("" if t is None else t for t in batch.column(1).to_pylist())):
            rows.append(row)
            size += len(row[1])
            if size >= BATCH_CHARS:
                yield from done(rows)
                rows, size = [], 0
        yield from done(rows)
