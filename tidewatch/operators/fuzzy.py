"""Exact fuzzy joins of short strings: only pairs that share a piece, or a rare letter, are compared."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import settle, shuffle_width

STRINGS_PER_BLOCK = 20_000
RANKED_LETTERS = 10_000  # letters whose frequency orders the prefixes; the order decides the work, never a pair


def _blocks(names: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names in blocks, keys once for each block: however common a piece is, no join key holds more than a block of names."""
    blocks = max(1, math.ceil(names.count() / STRINGS_PER_BLOCK))
    dealt = names.withColumn("nb", F.pmod(F.xxhash64("name"), F.lit(blocks)).cast("int"))
    return dealt, keys.withColumn("nb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))


def _partner_lengths(length: Column, cutoff: float) -> Column:
    return F.sequence(F.ceil(length * F.lit(cutoff) - 1e-9).cast("int"), F.floor(length / F.lit(cutoff) + 1e-9).cast("int"))


def edit_pairs(names: DataFrame, keys: DataFrame, cutoff: float) -> DataFrame:
    """``(name, key, similarity)`` of all pairs with ``1 - edits / longer length >= cutoff``, some more than once.

    A pair of lengths m and l may differ by k edits. A key cut into k + 1 pieces keeps one of them whole, and near its
    place; where that piece must start in the name follows from the edits left on either side of it. Where a key is shorter
    than its pieces are many, the empty piece meets all names of that length.
    """
    names, keys = _blocks(names.withColumn("m", F.length("name")), keys.withColumn("l", F.length("key")))
    edits = F.floor((1.0 - F.lit(cutoff)) * F.greatest("m", "l") + 1e-9).cast("int")
    least, extra = F.floor(F.col("l") / (F.col("k") + 1)).cast("int"), F.col("l") % (F.col("k") + 1)

    def pieces(df: DataFrame) -> DataFrame:
        """One row per piece of a key of length l: number ``i``, start ``p`` (from 0) and length ``w``."""
        each = df.withColumn("k", edits).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
        longer = F.greatest(F.col("i") - (F.col("k") + 1 - extra), F.lit(0))  # pieces before it that are one longer
        return each.withColumns({"p": F.col("i") * least + longer, "w": least + (F.col("i") >= F.col("k") + 1 - extra).cast("int")})

    index = pieces(keys.withColumn("m", F.explode(_partner_lengths(F.col("l"), cutoff))))
    index = index.withColumn("piece", F.expr("substring(key, p + 1, w)"))
    probe = pieces(names.withColumn("l", F.explode(_partner_lengths(F.col("m"), cutoff))))
    longer = F.col("m") - F.col("l")
    low = F.greatest(F.col("p") - F.col("i"), F.col("p") + longer - (F.col("k") - F.col("i")), F.lit(0))
    high = F.least(F.col("p") + F.col("i"), F.col("p") + longer + (F.col("k") - F.col("i")), F.col("m") - F.col("w"))
    probe = probe.withColumns({"low": low, "high": high}).filter("low <= high")
    probe = probe.withColumn("at", F.explode(F.sequence("low", "high"))).withColumn("piece", F.expr("substring(name, at + 1, w)"))
    probe = probe.select("name", "m", "l", "i", "piece", "nb").distinct()
    met = probe.join(index.select("key", "m", "l", "i", "piece", "nb"), ["m", "l", "i", "piece", "nb"])
    similarity = 1.0 - F.levenshtein("name", "key") / F.greatest("m", "l")
    return met.select("name", "key", similarity.alias("similarity")).filter(F.col("similarity") >= cutoff)


def _common_letters(keys: DataFrame) -> dict[str, int]:
    letters = keys.select(F.explode(F.split("key", "")).alias("c")).filter("c <> ''")
    counted = letters.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "c").limit(RANKED_LETTERS)
    return {r["c"]: r["n"] for r in counted.collect()}


def _with_letters(df: DataFrame, c: str, cutoff: float, common: dict[str, int]) -> DataFrame:
    """Add ``letters``: each letter of ``c`` with its number among equal ones; and ``prefix``, so many of the rarest that any
    string with a ratio of ``cutoff`` shares one of its own prefix with it."""

    @F.arrow_udf("struct<letters:array<long>,prefix:array<long>>")
    def cut(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            seen: Counter = Counter()
            ranked = []
            for c in text:
                seen[c] += 1
                # Rarest first; a second equal letter counts as a quarter as common.
                ranked.append((common.get(c, 0) / 4 ** min(seen[c] - 1, 100), ord(c) << 32 | seen[c]))
            ranked.sort()
            size = len(text)
            shortest = math.ceil(cutoff * size / (2 - cutoff) - 1e-9)
            shared = math.ceil(cutoff * (size + shortest) / 2 - 1e-9)  # by the pair with the fewest
            codes = [code for _, code in ranked]
            out.append({"letters": codes, "prefix": codes[: size - shared + 1]})
        return pa.array(out, pa.struct([("letters", pa.list_(pa.int64())), ("prefix", pa.list_(pa.int64()))]))

    return df.withColumn("_cut", cut(F.col(c))).select("*", "_cut.letters", "_cut.prefix").drop("_cut")


def ratio_candidates(names: DataFrame, keys: DataFrame, cutoff: float) -> DataFrame:
    """``(name, key, bound)``: each pair once whose shared letters, an upper bound on matched ones, reach the cutoff.

    Matching blocks hold at most the letters that both strings have, counted with repeats, so a pair that reaches the
    cutoff shares at least ``cutoff / 2`` of all its letters. By the prefix principle its rarest letters meet.
    """
    common = _common_letters(keys)
    names, keys = settle(_with_letters(names, "name", cutoff, common)), settle(_with_letters(keys, "key", cutoff, common))
    names, keys = _blocks(names, keys)
    left = names.withColumn("code", F.explode("prefix"))
    right = keys.select("key", "nb", F.col("letters").alias("key_letters"), F.col("prefix").alias("key_prefix"), F.explode("prefix").alias("code"))
    m, l = F.size("letters"), F.size("key_letters")  # noqa: E741
    once = F.element_at(F.array_intersect("prefix", "key_prefix"), 1) == F.col("code")
    met = left.join(right, ["code", "nb"]).filter((2.0 * F.least(m, l) >= F.lit(cutoff) * (m + l) - 1e-9) & once)
    bound = 2.0 * F.size(F.array_intersect("letters", "key_letters")) / (m + l)
    return met.select("name", "key", bound.alias("bound")).filter(F.col("bound") >= F.lit(cutoff) - 1e-9)


def best_by_ratio(candidates: DataFrame, cutoff: float) -> DataFrame:
    """``(name, key, similarity)``: the key with the highest matching-blocks ratio of each name, if at least ``cutoff``; the
    greatest key on ties. The candidates of a name pass by in falling order of their bounds, and the search ends once
    no bound reaches the best ratio; nothing is gathered."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, best, matcher = None, (cutoff, ""), SequenceMatcher()
        found: list[tuple[str, str, float]] = []

        def done() -> pa.RecordBatch:
            columns = list(zip(*found)) or [[], [], []]
            types = [pa.string(), pa.string(), pa.float64()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=["name", "key", "similarity"])

        for batch in batches:
            for each, key, bound in zip(*(c.to_pylist() for c in batch.columns)):
                if each != name:
                    if best[1]:
                        found.append((name, best[1], best[0]))
                    name, best = each, (cutoff, "")
                    matcher.set_seq2(name)
                if bound >= best[0]:
                    matcher.set_seq1(key)
                    best = max(best, (matcher.ratio(), key))
            if len(found) >= 1000:
                yield done()
                found.clear()
        if best[1]:
            found.append((name, best[1], best[0]))
        yield done()

    dealt = candidates.repartition(shuffle_width(candidates.sparkSession), "name")
    ordered = dealt.sortWithinPartitions("name", F.desc("bound"), F.desc("key"))
    return ordered.mapInArrow(search, "name string, key string, similarity double")
