"""Mixing sources to target weights: hash-random keys, a range sort inside each source, distributed prefix sums of token
counts, and a cut at each source's exact budget. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.scale import running_rank, running_totals
from ..session import settle
from .common import join_slices, range_slices

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE, EPOCHS, SEED = 1.5, 2, "mix"


def word_count(text: Column) -> Column:
    """Words between ASCII blanks; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(id: Column, seed: str) -> Column:
    """A number that looks random and is the same in every run."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit("-"))))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """``(source, source_size, target)`` for ``sizes(source, source_size)``, one row per source.

    Sources in code point order, null last, take the weights in turn. All targets together are ``share`` of all sizes, in
    proportion to the weights, but none is above ``epochs`` times its source's size: what is above goes to the others by
    weight until none is. So in the order of size over weight the first sources are full, the rest share by weight;
    which they are follows from running sums of sizes and weights along that order.
    """
    if share > epochs:
        raise ValueError("the mix cannot be larger than all epochs of all sources")
    ordered = sizes.select(F.col("source").isNull().alias("_none"), "source", "source_size")
    ranked = running_rank(ordered, ["_none", "source"], "_rank")
    turn = F.element_at(F.lit(list(weights)), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    exact = "decimal(38,0)"
    rows = settle(ranked.select(
        "source", "source_size", "_rank", turn.cast("long").alias("_weight"),
        (F.col("source_size") / turn).alias("_ratio"), (F.col("source_size") * epochs).cast(exact).alias("_cap"),
    ))
    every, weight = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_weight"), F.lit(0))).first()
    total = every * share
    sums = {"_caps": F.col("_cap"), "_weights": F.col("_weight").cast(exact)}
    summed = running_totals(rows, ["_ratio", "_rank"], sums)
    # Full if its cap is at most its share of what the earlier ones leave.
    left_weight = F.lit(weight) - F.col("_weights") + F.col("_weight")
    left = F.lit(total) - (F.col("_caps") - F.col("_cap")).cast("double")
    full = F.col("_cap").cast("double") * left_weight.cast("double") <= F.col("_weight") * left
    marked = settle(summed.withColumn("_full", full))
    caps, rest = marked.agg(
        F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))), F.lit(0)).cast("double"),
        F.coalesce(F.sum(F.when(~F.col("_full"), F.col("_weight"))), F.lit(0)),
    ).first()
    shared = F.col("_weight") * F.lit(total - caps) / F.lit(float(max(rest, 1)))
    return marked.select("source", "source_size", F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(shared).alias("target"))


def mix_plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED,
             keep_text: bool = False) -> DataFrame:
    """What a mix takes of each row of ``docs(doc_id, source, text)``: ``doc_id, source, size`` (words), ``source_size``,
    ``target`` (its source's, as in :func:`source_targets`), ``rounds`` (whole copies), ``cut`` (leading words of one more
    copy) and ``taken`` (words in all, repeats counted); with ``keep_text`` also the text.

    A source's budget is its target, rounded half up. Its rows stand in the order of a hash of the id: whole rounds over the
    source first, then rows from the front until the budget is used up, the last one in part. So a source's taken
    words are its budget exactly.

    Null and empty texts have size 0 and are never taken; a null source is a source; null ids are one key; rows of equal
    id stand by size, then by a hash of the text; equal rows are each counted. A source without words has target 0, and
    an empty table gives no rows. Long texts stay in their rows; what is sorted is the id and three numbers. Other
    columns are ignored, whatever their names.
    """
    text = F.col("text").cast("string")
    sized = settle(docs.select(
        F.col("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"),
        random_key(F.col("doc_id"), seed).alias("_key"), F.xxhash64(text).alias("_text"),
        *([text.alias("text")] if keep_text else []),
    ))
    order = ["_key", "doc_id", "size", "_text"]
    rows, slices = range_slices(sized, "source", order, "size")
    sizes = slices.groupBy("source").agg(F.max("_total").alias("source_size"))
    targets = settle(source_targets(sizes, weights, share, epochs)).withColumnRenamed("source", "_name")
    slices = slices.join(targets, slices["source"].eqNullSafe(targets["_name"])).drop("_name", "_total")
    local = F.expr("sum(size) over (partition by source, _slice order by _key, doc_id, size, _text rows unbounded preceding)")
    placed = join_slices(rows, slices, "source").withColumn("_upto", F.col("_before") + local)
    budget = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("_budget") - F.col("rounds") * F.col("source_size")
    cut = F.least(F.greatest(rest - (F.col("_upto") - F.col("size")), F.lit(0)), F.col("size"))
    planned = placed.withColumns({"_budget": budget, "rounds": whole}).withColumn("cut", cut)
    planned = planned.withColumn("taken", F.col("rounds") * F.col("size") + F.col("cut"))
    kept = ["text"] if keep_text else []
    return planned.select("doc_id", "source", "size", "source_size", "target", "rounds", "cut", "taken", *kept)


def mix_texts(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself, in its random order: ``doc_id, source, epoch`` (from 0), ``text``, one row for each copy; a cut copy
    ends after its last word. ``settings`` are those of :func:`mix_plan`; here the texts move with the sort."""
    plan = mix_plan(docs, keep_text=True, **settings).filter("taken > 0")
    last = F.col("rounds") - F.when(F.col("cut") > 0, 0).otherwise(1)
    copies = plan.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    part = (F.col("epoch") == F.col("rounds")) & (F.col("cut") < F.col("size"))
    words = F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    front = F.array_join(F.slice(words, F.lit(1), F.greatest(F.col("cut"), F.lit(1)).cast("int")), "")
    return copies.select("doc_id", "source", "epoch", F.when(part, front).otherwise(F.col("text")).alias("text"))
