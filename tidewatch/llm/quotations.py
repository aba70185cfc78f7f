"""Conversations in reply order: quoted passages are linked to the messages they come from and taken out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..operators.scale import running_rank
from ..session import settle

QUOTE = re.compile(r" {0,3}((?:> ?)+)(.*)", re.S)
ATTRIBUTION = re.compile(r"(?i).*\b(wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*$")
PARSED = "conv_id long, seq long, turn long, role string, text string, own array<long>, quoted array<struct<level: int, hash: long>>"
NO_CONVERSATION = -(1 << 63)  # stands for a null conv_id, which joins would drop


def _units(lines: list[str]) -> list[int]:
    """Hashes of the normalised sentences of a passage: case, white space, line breaks and punctuation at the ends
    do not matter, so a passage quoted in part or wrapped anew still meets its source."""
    passage = " ".join(" ".join(lines).lower().split())
    parts = (p.strip(" \t\"'*_-") for p in re.split(r"(?<=[.!?…])\s+", passage))
    return [xxhash.xxh64_intdigest(p.encode("utf-8", "surrogatepass"), 0) - (1 << 63) for p in parts if any(c.isalnum() for c in p)]


def parse_quotes(text: str) -> tuple[str, list[tuple[int, list[str]]]]:
    """``(own text, passages)`` of a message; a passage is the lines of one quote level in a row, with the level.

    Up to three blanks may stand before a quote mark; a level ends where the number of marks changes. The line before
    a quote that names its author goes with it. Text without quotes comes back unchanged, other text without
    blank lines at its ends.
    """
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    before = 0
    for line in text.split("\n"):
        quote = QUOTE.fullmatch(line)
        if quote is None:
            own.append(line)
            before = 0
            continue
        level = quote[1].count(">")
        if not before:
            while own and not own[-1].strip():
                own.pop()
            if own and ATTRIBUTION.match(own[-1]):
                own.pop()
            while own and not own[-1].strip():
                own.pop()
            own.append("")
        if level == before:
            passages[-1][1].append(quote[2])
        else:
            passages.append((level, [quote[2]]))
        before = level
    return ("\n".join(own).strip("\n") if passages else text), passages


def parse_messages(messages: DataFrame) -> DataFrame:
    """Own text and hashed passages of ``messages(conv_id, seq, turn, role, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, own, quoted = [], [], []
            for text in batch.column(4).to_pylist():
                clean, passages = parse_quotes(text or "")
                texts.append(clean if text is not None else None)
                own.append(_units(clean.split("\n")))
                quoted.append([{"level": n, "hash": h} for n, lines in passages for h in _units(lines)])
            kinds = pa.list_(pa.int64()), pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(texts, pa.string()), pa.array(own, kinds[0]), pa.array(quoted, kinds[1])],
                names=["conv_id", "seq", "turn", "role", "text", "own", "quoted"])

    return messages.select("conv_id", "seq", "turn", "role", "text").mapInArrow(run, PARSED)


def quote_links(parsed: DataFrame) -> DataFrame:
    """``(conv_id, seq, level, source, n)``: how many quoted sentences of a message come from which earlier message.

    The source of a sentence is the first message of the conversation that says it in its own words, so a sentence
    that is said often is one row, not one for each pair of messages.
    """
    quoted = parsed.select("conv_id", "seq", F.explode("quoted").alias("q")).select("conv_id", "seq", "q.level", "q.hash")
    wanted = settle(quoted.distinct())
    said = parsed.select("conv_id", "seq", F.explode("own").alias("hash"))
    first = settle(said.groupBy("conv_id", "hash").agg(F.min("seq").alias("source")))
    linked = wanted.join(first, ["conv_id", "hash"]).filter("source < seq")
    return linked.groupBy("conv_id", "seq", "level", "source").agg(F.count(F.lit(1)).alias("n"))


def reply_positions(nodes: DataFrame) -> DataFrame:
    """``(conv_id, node, position)`` of trees ``nodes(conv_id, node, parent)`` with parent < node: every message
    before its replies, the replies of a message in order, each with all its own replies behind it.

    By pointer jumping: a logarithmic number of joins on (conversation, message), which no key dominates, whatever
    the size or depth of a conversation.
    """
    rows = settle(nodes)
    ranked = settle(running_rank(rows.filter("parent is not null"), ["node"], "k", within=["conv_id", "parent"]))
    following = ranked.select("conv_id", "parent", (F.col("k") - 1).alias("k"), F.col("node").alias("sibling"))
    first = ranked.filter("k = 1").select("conv_id", F.col("parent").alias("node"), F.col("node").alias("child"))
    siblings = ranked.join(following, ["conv_id", "parent", "k"], "left").select("conv_id", "node", "sibling")
    # up: where a finished subtree goes on. hop: an ancestor still to be asked.
    up = settle(rows.join(siblings, ["conv_id", "node"], "left").select(
        "conv_id", "node", F.col("sibling").alias("up"), F.when(F.col("sibling").isNull(), F.col("parent")).alias("hop")))
    while not up.filter("hop is not null").isEmpty():
        other = up.select("conv_id", F.col("node").alias("hop"), F.col("up").alias("up2"), F.col("hop").alias("hop2"))
        up = settle(up.join(other, ["conv_id", "hop"], "left").select("conv_id", "node", F.coalesce("up", "up2").alias("up"), F.col("hop2").alias("hop")))
    chain = up.join(first, ["conv_id", "node"], "left").select("conv_id", "node", F.coalesce("child", "up").alias("next"), F.lit(1).cast("long").alias("left"))
    chain = settle(chain)  # left: messages from here up to next
    while not chain.filter("next is not null").isEmpty():
        other = chain.select("conv_id", F.col("node").alias("next"), F.col("next").alias("next2"), F.col("left").alias("left2"))
        chain = settle(chain.join(other, ["conv_id", "next"], "left").select(
            "conv_id", "node", F.col("next2").alias("next"), (F.col("left") + F.coalesce("left2", F.lit(0))).alias("left")))
    size = chain.groupBy("conv_id").agg(F.max("left").alias("size"))
    return chain.join(settle(size), "conv_id").select("conv_id", "node", (F.col("size") - F.col("left") + 1).alias("position"))


def link_conversations(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, role, position, reply_to, n_quoted, n_linked, text, formatted`` per row of
    ``messages(conv_id, turn, role, text)``.

    ``text`` is the message without quotes. ``reply_to`` is the turn of the message it answers: the source of most of
    the sentences quoted at the lowest linked level (the earliest on ties), or the message before. ``position`` (from 1)
    orders a conversation by replies, ``formatted`` is the message in chat markup, so the formatted conversation is its
    messages in order of position. ``n_quoted`` and ``n_linked`` count the different quoted sentences per level and those whose
    source was found.

    Messages are numbered by turn, then role and text; repeated rows are messages of their own. Null turns come
    first, null conversations are one conversation, null texts stay null and have no quotes.
    """
    columns = [F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")]
    keyed = messages.select(*columns).withColumn("conv_id", F.coalesce("conv_id", F.lit(NO_CONVERSATION)))
    parsed = settle(parse_messages(running_rank(keyed, ["turn", "role", "text"], "seq", within=["conv_id"])))
    links = settle(quote_links(parsed))
    best = F.max_by("source", F.struct(-F.col("level"), "n", -F.col("source")))
    parents = settle(links.groupBy("conv_id", "seq").agg(best.alias("source"), F.sum("n").alias("n_linked")))
    before = F.when(F.col("seq") > 1, F.col("seq") - 1)
    thin = parsed.select("conv_id", "seq", "turn")
    with_parent = parsed.join(parents, ["conv_id", "seq"], "left").withColumn("parent", F.coalesce("source", before))
    linked = parents.select("conv_id").distinct()
    if parents.isEmpty():  # every message answers the one before
        placed = with_parent.withColumn("position", F.col("seq"))
    else:
        nodes = with_parent.join(linked, "conv_id", "left_semi").select("conv_id", F.col("seq").alias("node"), "parent")
        places = settle(reply_positions(nodes)).withColumnRenamed("node", "seq")
        placed = with_parent.join(places, ["conv_id", "seq"], "left").withColumn("position", F.coalesce("position", "seq"))
    answered = thin.select("conv_id", F.col("seq").alias("parent"), F.col("turn").alias("reply_to"))
    quoted = F.size(F.array_distinct("quoted")).cast("long")
    body = F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))
    conv = F.when(F.col("conv_id") != NO_CONVERSATION, F.col("conv_id"))
    return placed.join(answered, ["conv_id", "parent"], "left").select(
        conv.alias("conv_id"), "turn", "role", "position", "reply_to", quoted.alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "text", body.alias("formatted"))
