"""Text functions on columns. All of them run inside the JVM."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, functions as F

# What counts as a word character or blank, as Unicode classes. Java's own \w and \s are
# ASCII-only, and its (?U)\w also keeps combining marks, so both are spelled out.
WORD = r"\p{L}\p{N}_"
NOT_BLANK = r"(?U)[^\s\x1c-\x1f]"
BLANKS = r"(?U)[\s\x1c-\x1f]+"

# Labels of the event files and what they count as.
EVENT_LABELS = {
    "related and informative": 1,
    "related - but not informative": 1,
    "not related": 0,
    "not applicable": 0,
}

# Words that raise the urgency of an incident.
URGENT_WORDS = (
    "trapped", "trap", "stuck", "dying", "dead", "death",
    "help", "rescue", "sos", "urgent", "critical", "emergency",
    "drowning", "drown", "flood", "fire", "collapse", "collapsed",
    "missing", "injured", "injury", "hospital", "ambulance",
)

# Entity types that name a place.
PLACE_TYPES = ("LOC", "GPE", "B-LOC", "I-LOC", "B-GPE", "I-GPE")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    An expression captured by a lambda is evaluated again for every element; binding it to a
    lambda variable first avoids that.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean_text(c) -> Column:
    """Normal form used for features and duplicate checks; null becomes ``""``.

    Links, mentions and the ``#`` sign go; three HTML entities are decoded. Whatever is then
    neither letter, digit nor underscore is a separator, so one replacement covers both
    punctuation and runs of blanks.
    """
    out = F.lower(_col(c))
    # Most posts hold no link and no mention; looking for how they begin is far cheaper than the patterns.
    linked = F.contains(out, F.lit("http")) | F.contains(out, F.lit("www"))
    out = F.when(linked, F.regexp_replace(out, f"http{NOT_BLANK}+|www{NOT_BLANK}+", "")).otherwise(out)
    out = F.when(F.contains(out, F.lit("@")), F.regexp_replace(out, f"@[{WORD}]+", "")).otherwise(out)
    for seen, put in (("#", ""), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        out = F.replace(out, F.lit(seen), F.lit(put))
    return F.coalesce(F.trim(F.regexp_replace(out, f"[^{WORD}]+", " ")), F.lit(""))


def keep_nonempty(df: DataFrame, raw: str, clean: str = "text_clean") -> DataFrame:
    """Add the cleaned text next to the original and drop rows it leaves empty."""
    return df.withColumn(clean, clean_text(raw)).filter(F.length(clean) > 0)


def ws_tokens(c) -> Column:
    """Split on any run of blanks, without empty pieces."""
    return F.filter(F.split(_col(c), BLANKS), lambda t: t != "")


def word_tokens(c, min_len: int = 2) -> Column:
    """Runs of word characters of at least ``min_len``."""
    return F.regexp_extract_all(_col(c), F.lit(f"[{WORD}]{{{min_len},}}"), F.lit(0))


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Character table derived from the Unicode data: base characters first, then the
    combining marks, which ``translate`` deletes because they have no counterpart.

    Covers every character of the basic plane whose compatibility form is one base
    character plus marks. Characters that expand to several base characters (ligatures,
    fractions, Hangul syllables) are left as they are.
    """
    source, target, marks = [], [], []
    for point in range(0x80, min(sys.maxunicode, 0xFFFF) + 1):
        if 0xD800 <= point <= 0xDFFF:
            continue
        ch = chr(point)
        if unicodedata.combining(ch):
            marks.append(ch)
            continue
        base = "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))
        if base != ch and len(base) == 1:
            source.append(ch)
            target.append(base)
    return "".join(source + marks), "".join(target)


def strip_accents(c) -> Column:
    """Replace accented characters by their base character and drop combining marks."""
    source, target = _accent_table()
    return F.translate(_col(c), source, target)


def accent_map() -> dict[str, str]:
    """The same table for use inside tasks."""
    source, target = _accent_table()
    return {c: target[i : i + 1] for i, c in enumerate(source)}


def ngrams(tokens, lo: int = 1, hi: int = 2) -> Column:
    """Word n-grams of every size from ``lo`` to ``hi``, joined by one blank."""
    none = F.array().cast("array<string>")

    def of_size(words: Column, n: int) -> Column:
        if n == 1:
            return words
        starts = F.sequence(F.lit(1), F.size(words) - (n - 1))
        joined = F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) >= n, joined).otherwise(none)

    return let(_col(tokens), lambda words: F.concat(*[of_size(words, n) for n in range(lo, hi + 1)]))


def terms(c) -> Column:
    """Feature terms of a cleaned text: one- and two-word phrases without accents."""
    return ngrams(word_tokens(strip_accents(c)), 1, 2)


def term_counts(terms_col) -> Column:
    """``array<struct<term,tf>>`` of an array of terms, ordered by term.

    Sorting and cutting at the run ends is ``n log n`` and needs no shuffle, so even very
    long texts are counted inside their own row.
    """
    none = F.array().cast("array<struct<term:string,tf:int>>")

    def run_ends(ordered: Column) -> Column:
        spots = F.sequence(F.lit(1), F.size(ordered))
        return F.filter(spots, lambda i: (i == F.size(ordered)) | (F.get(ordered, i) != F.get(ordered, i - 1)))

    def runs(ordered: Column, ends: Column) -> Column:
        return F.transform(
            ends,
            lambda e, k: F.struct(
                F.get(ordered, e - 1).alias("term"),
                (e - F.coalesce(F.get(ends, k - 1), F.lit(0))).cast("int").alias("tf"),
            ),
        )

    return let(
        F.sort_array(_col(terms_col)),
        lambda ordered: F.when(
            F.size(ordered) > 0, let(run_ends(ordered), lambda ends: runs(ordered, ends))
        ).otherwise(none),
    )


def map_label(c, mapping: dict[str, int] | None = None, default: int = 0) -> Column:
    """0/1 value of a textual label; unknown and null labels give ``default``."""
    mapping = EVENT_LABELS if mapping is None else mapping
    pairs = [F.lit(v) for kv in mapping.items() for v in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(F.trim(_col(c)))), F.lit(default))


def clean_entity(c) -> Column:
    """Trim an entity word and drop sub-word marks; null when at most one character is left."""
    out = F.trim(F.replace(F.trim(_col(c)), F.lit("##"), F.lit("")))
    return F.when(F.length(out) > 1, out)


def char_prefix(c, n: int, ellipsis: str | None = None) -> Column:
    """First ``n`` characters, for display and for taggers with a bounded input."""
    c = _col(c)
    head = F.substring(c, 1, n)
    if ellipsis is None:
        return head
    return F.when(F.length(c) > n, F.concat(head, F.lit(ellipsis))).otherwise(head)


def has_keyword(c, words: Iterable[str] = URGENT_WORDS, normalise: bool = False) -> Column:
    """Does any blank-separated token equal one of ``words``?

    As published the raw lower-cased text is split, so ``Help!`` does not match ``help``;
    ``normalise=True`` splits the cleaned text instead.
    """
    text = clean_text(c) if normalise else F.lower(_col(c))
    wanted = F.array(*[F.lit(w) for w in words])
    return F.coalesce(F.arrays_overlap(F.split(text, BLANKS), wanted), F.lit(False))


def incident_line(n, label, place, text, k) -> Column:
    """One line of the digest."""
    return F.concat(
        F.lit("INCIDENT "), _col(n).cast("string"), F.lit(" ["), _col(label), F.lit("] at "),
        F.coalesce(_col(place), F.lit("Unknown location")), F.lit(": "), F.coalesce(_col(text), F.lit("")),
        F.lit(" ("), _col(k).cast("string"), F.lit(" reports)"),
    )


def cluster_name(n) -> Column:
    """``c_`` and the cluster number, padded to three digits but never cut."""
    digits = _col(n).cast("string")
    return F.concat(F.lit("c_"), F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits))


def singleton_name(post_id) -> Column:
    return F.concat(F.lit("singleton_"), F.substring(F.md5(_col(post_id).cast("string")), 1, 8))


def incident_key(post_id) -> Column:
    """Identifier that stays the same from run to run while the earliest post stays."""
    return F.md5(_col(post_id).cast("string"))


def iso_time(c) -> Column:
    return F.date_format(_col(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def text_lengths(df: DataFrame, c: str) -> DataFrame:
    """Add the number of characters and of blank-separated tokens."""
    return df.withColumns({"n_char": F.length(c), "n_token": F.size(ws_tokens(c))})


def keep_entity_types(c, types: Iterable[str] = PLACE_TYPES) -> Column:
    """Cleaned words of the entities whose type, upper-cased, is one of ``types``."""
    kept = F.filter(_col(c), lambda e: F.upper(e["entity_group"]).isin(*types))
    return F.filter(F.transform(kept, lambda e: clean_entity(e["word"])), lambda w: w.isNotNull())


def distinct_keep_order(c) -> Column:
    """Distinct without regard to case, first spelling and order of appearance kept."""
    c = _col(c)
    return let(
        F.transform(c, lambda w: F.lower(w)),
        lambda lowered: F.filter(c, lambda w, i: F.array_position(lowered, F.lower(w)) == i + 1),
    )
