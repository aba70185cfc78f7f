"""Places named in a text, and their coordinates."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.text import clean_text, distinct_keep_order, let
from ..session import settle
from .fuzzy import best_by_ratio, edit_pairs, ratio_candidates
from .phrases import BLOCK_BYTES, phrase_hits
from .scale import HOT_ROWS, hot_key_join


def extract_places(df: DataFrame, id: str, text: str, gaz: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add ``locations``: gazetteer keys that occur as phrases in the cleaned text.

    At every word the longest key wins and its words are used up. Texts are walked where they lie; the keys go to the
    tasks as automata of bounded size, several if they are many.
    """
    keys = gaz.select(clean_text("key").alias("phrase"), "key").filter("phrase <> ''")
    keys = keys.groupBy("phrase").agg(F.min("key").alias("key"))
    hits = phrase_hits(df.withColumn("_words", clean_text(text)), "_words", keys, "_hits", block_bytes)

    def take(acc, hit):
        taken = F.struct(
            (hit["at"] - hit["rank"]).alias("free"), F.concat(acc["words"], F.array(hit["key"])).alias("words")
        )
        return F.when(hit["at"] >= acc["free"], taken).otherwise(acc)

    start = F.struct(F.lit(1).alias("free"), F.array().cast("array<string>").alias("words"))
    picked = F.aggregate(F.sort_array("_hits"), start, take)["words"]
    return hits.withColumn("locations", distinct_keep_order(picked)).drop("_words", "_hits")


def lookup_key(loc):
    return F.lower(F.trim(F.col(loc) if isinstance(loc, str) else loc))


def lookup_exact(df: DataFrame, loc: str, gaz: DataFrame) -> DataFrame:
    """Add coordinates by exact key; blank names match nothing."""
    entries = gaz.select(F.col("key").alias("_key"), "lat", "lng", "full_name")
    named = df.withColumn("_key", F.nullif(lookup_key(loc), F.lit("")))
    found = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    return (
        named.join(entries, "_key", "left")
        .withColumn("full_name", F.when(found, F.coalesce("full_name", F.col(loc))))
        .drop("_key")
    )


def lookup_fuzzy(df: DataFrame, loc: str, gaz: DataFrame, cutoff: float = 0.6, metric: str = "ratio") -> DataFrame:
    """``(loc, match, similarity)``: the most similar key of each distinct name, if at least
    ``cutoff``; on ties the greatest key.

    ``ratio`` is the matching-blocks ratio of the standard library, ``levenshtein`` is one
    minus the edit distance over the longer length and stays inside the JVM. Both compare only pairs that share a piece or
    a rare letter, and miss none that reaches the cutoff, which has to be above 0.
    """
    if not 0 < cutoff <= 1:
        raise ValueError("the cutoff has to be above 0, and at most 1")
    names = df.select(lookup_key(loc).alias("name")).filter("name <> ''").distinct()
    keys = gaz.select("key").distinct()
    best = _closest_by_edits(names, keys, cutoff) if metric == "levenshtein" else _closest_by_ratio(names, keys, cutoff)
    return best.withColumnRenamed("name", loc)


def _closest_by_edits(names: DataFrame, keys: DataFrame, cutoff: float) -> DataFrame:
    pairs = edit_pairs(settle(names), settle(keys), cutoff)
    top = pairs.groupBy("name").agg(F.max(F.struct("similarity", "key")).alias("t"))
    return top.select("name", F.col("t.key").alias("match"), F.col("t.similarity").alias("similarity"))


def _closest_by_ratio(names: DataFrame, keys: DataFrame, cutoff: float) -> DataFrame:
    best = best_by_ratio(ratio_candidates(settle(names), settle(keys), cutoff), cutoff)
    return best.withColumnRenamed("key", "match")


def _letters(words: list[str], width: int = 64) -> np.ndarray:
    """How often each letter class occurs. Classes may share letters: the shared count is an
    upper bound on matched characters either way."""
    counts = np.zeros((len(words), width), dtype=np.int16)
    for i, word in enumerate(words):
        for ch in word:
            counts[i, ord(ch) % width] += 1
    return counts


def best_ratios(names: list[str], keys: list[str], cutoff: float) -> list[tuple[str, str, float]]:
    """Best key per name. Keys are tried in order of an upper bound on the ratio, and the
    search of a name ends once no remaining bound reaches the best ratio found."""
    if not names or not keys:
        return []
    key_letters, key_sizes = _letters(keys), np.array([len(k) for k in keys])
    out = []
    for name, letters in zip(names, _letters(names)):
        shared = np.minimum(key_letters, letters).sum(axis=1)
        bound = 2.0 * shared / np.maximum(key_sizes + len(name), 1)
        matcher, best = SequenceMatcher(), (cutoff, "")
        matcher.set_seq2(name)
        for i in np.argsort(-bound, kind="stable"):
            if bound[i] < best[0]:
                break
            matcher.set_seq1(keys[i])
            best = max(best, (matcher.ratio(), keys[i]))
        if best[1]:
            out.append((name, best[1], float(best[0])))
    return out


def first_resolved(df: DataFrame, id: str, pos: str = "pos") -> DataFrame:
    """The first name by position that has coordinates."""
    hit = F.struct("lat", "lng", F.col("full_name").alias("resolved_location"))
    known = df.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    return known.groupBy(id).agg(F.min_by(hit, pos).alias("_hit")).select(id, "_hit.*")


def geocode(
    df: DataFrame, id: str, locations: str, gaz: DataFrame, cutoff: float = 0.6, metric: str = "ratio",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``lat, lng, resolved_location`` of the first name that resolves, exactly or fuzzily.

    Names are looked up once each, however many incidents mention them; the fuzzy search sees
    only names without an exact entry. Incidents without a match keep null coordinates.
    """
    refs = df.select(id, F.posexplode(locations).alias("pos", "loc")).withColumn("name", lookup_key("loc"))
    wanted = settle(refs.filter("name <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("n")))
    entries = gaz.select(F.col("key").alias("name"), "lat", "lng", "full_name")
    exact = wanted.select("name").join(entries, "name")
    misses = wanted.select("name").join(entries, "name", "left_anti")
    fuzzy = lookup_fuzzy(misses, "name", gaz, cutoff, metric)
    near = fuzzy.join(gaz.withColumnRenamed("key", "match"), "match").select(
        "name", "lat", "lng", F.coalesce("full_name", "match").alias("full_name")
    )
    known = exact.unionByName(near)
    hot = wanted.filter(F.col("n") > hot_rows)
    placed = hot_key_join(refs, known, ["name"], hot, "inner").withColumn("full_name", F.coalesce("full_name", "loc"))
    return df.join(first_resolved(placed, id), id, "left")


def geocode_coverage(df: DataFrame, gaz: DataFrame) -> DataFrame:
    """Located incidents, all incidents and gazetteer entries, in one row."""
    located = df.agg(
        F.count_if(F.col("lat").isNotNull()).alias("geocoded"), F.count(F.lit(1)).alias("incidents")
    )
    # Two one-row tables.
    return located.join(F.broadcast(gaz.agg(F.count(F.lit(1)).alias("coverage"))))
