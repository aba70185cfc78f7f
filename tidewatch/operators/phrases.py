"""Phrases of a word list found in texts by one walk along each text (Aho and Corasick, on words)."""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from ..session import settle

BLOCK_BYTES = 8_000_000  # of phrases in one automaton; more phrases are walked block by block
HITS = "array<struct<at:int,rank:int,key:string>>"


@dataclass
class Automaton:
    """Trie over words with failure links. A node's word transitions are in ``step``, keyed by ``node * width + word``."""

    words: dict[str, int]
    step: dict[int, int]
    fail: list[int]
    found: list[int]  # per node: phrase that ends there, -1 for none
    next_found: list[int]  # per node: nearest node on its failure path where a phrase ends, 0 for none
    sizes: list[int]
    keys: list[str]

    @classmethod
    def of(cls, phrases: list[tuple[str, str]]) -> Automaton:
        words: dict[str, int] = {}
        split = [[words.setdefault(w, len(words)) for w in phrase.split(" ")] for phrase, _ in phrases]
        width = len(words) or 1
        step: dict[int, int] = {}
        found, children = [-1], [[]]
        for k, ids in enumerate(split):
            node = 0
            for w in ids:
                after = step.get(node * width + w)
                if after is None:
                    after = step[node * width + w] = len(found)
                    children[node].append((w, after))
                    found.append(-1)
                    children.append([])
                node = after
            found[node] = k
        fail, next_found = [0] * len(found), [0] * len(found)
        queue = deque([0])
        while queue:  # breadth first: a failure path is shorter than its node's
            node = queue.popleft()
            for w, child in children[node]:
                queue.append(child)
                if node:
                    back = fail[node]
                    while back and back * width + w not in step:
                        back = fail[back]
                    fail[child] = step.get(back * width + w, 0)
                    next_found[child] = fail[child] if found[fail[child]] >= 0 else next_found[fail[child]]
        return cls(words, step, fail, found, next_found, [len(s) for s in split], [key for _, key in phrases])

    def longest(self, text: str) -> dict[int, int]:
        """Phrase by the place (from 1) of its first word: the longest of those that start there."""
        width, step, fail, found = len(self.words) or 1, self.step, self.fail, self.found
        get, out, node = self.words.get, {}, 0
        for at, word in enumerate(text.split(" "), 1):
            w = get(word)
            if w is None:
                node = 0
                continue
            while node and node * width + w not in step:
                node = fail[node]
            node = step.get(node * width + w, 0)
            end = node if found[node] >= 0 else self.next_found[node]
            while end:
                k = found[end]
                start = at - self.sizes[k] + 1
                if start not in out or self.sizes[out[start]] < self.sizes[k]:
                    out[start] = k
                end = self.next_found[end]
        return out


def _walk(shared: Broadcast):
    @F.arrow_udf(HITS)
    def walk(texts: pa.Array) -> pa.Array:
        automaton = shared.value
        rows = [automaton.longest(t) if t else {} for t in texts.to_pylist()]
        found = [[{"at": at, "rank": -automaton.sizes[p], "key": automaton.keys[p]} for at, p in r.items()] for r in rows]
        return pa.array(found, pa.list_(pa.struct([("at", pa.int32()), ("rank", pa.int32()), ("key", pa.string())])))

    return walk


def phrase_hits(df: DataFrame, text: str, phrases: DataFrame, out: str = "hits", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add ``out``, an array of ``(at, rank, key)``: for each word of ``text`` where a phrase of ``phrases(phrase, key)``
    starts, the longest one of each block of phrases; ``rank`` is minus its words.

    Texts and phrases hold words with single blanks between them; a null text has no hits. Nothing is shuffled but the
    phrases: each block of at most about ``block_bytes`` of them goes to every task as one automaton.
    """
    spark = df.sparkSession
    phrases = settle(phrases.select("phrase", "key"))
    size = phrases.agg(F.coalesce(F.sum(F.octet_length("phrase") + F.octet_length("key")), F.lit(0))).first()[0]
    blocks = math.ceil(size / block_bytes)
    df = df.withColumn(out, F.array().cast(HITS))
    for k in range(blocks):
        part = phrases.filter(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == k).collect()  # bounded by block_bytes
        shared = spark.sparkContext.broadcast(Automaton.of([(r["phrase"], r["key"]) for r in part]))

        df = df.withColumn(out, F.concat(out, _walk(shared)(F.col(text))))
        if blocks > 1:  # one automaton at a time in a worker's memory
            df = settle(df)
            shared.unpersist()
    return df
