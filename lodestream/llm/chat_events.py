"""Conversations rebuilt from an event log, then rendered with a chat template and a loss mask.

Events carry conv_id, seq, message_id, role, kind and text. Kinds: "open" begins a message, "delta" appends its text, "edit" replaces what the message
holds by its text, "regenerate" empties the message, so that later deltas start anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: The template's own marks.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: Control strings that a text may not hold as they are, by their first character's escape; all of them are fixed values of common templates.
CONTROL = {"<": ("<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>"), "[": ("[INST]", "[/INST]")}
ESCAPE = {"<": "\\l", "[": "\\b"}


def escape(text: Column) -> Column:
    r"""\ doubled, and a control string's first character written as \l or \b, so that no control string is left."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for first, strings in CONTROL.items():
        for s in strings:
            out = F.replace(out, F.lit(s), F.lit(ESCAPE[first] + s[1:]))
    return out


def unescape(text: Column) -> Column:
    """The inverse: pairs of backslashes are found first, from the left, so single ones always begin an escape."""

    def plain(part: Column) -> Column:
        for first, mark in ESCAPE.items():
            part = F.replace(part, F.lit(mark), F.lit(first))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, first_seq, message_id, role, text): each message as its events leave it, in order of seq (ties: kind, then text).

    Messages fold apart from one another, so a conversation of any length spreads over tasks; what is gathered is one message's
    own events. Null text adds nothing. The role is the first non-null one. A message without text is empty. Null conv_id and message_id are keys like any other.
    """
    e = F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"), "role")
    log = events.groupBy("conv_id", "message_id").agg(F.sort_array(F.collect_list(e)).alias("log"))
    resets = F.transform("log", lambda x: x["kind"].isin("edit", "regenerate"))
    cut = F.coalesce(F.size("log") - F.array_position(F.reverse(resets), F.lit(True)) + 1, F.lit(1))
    alive = F.slice("log", F.when(F.array_contains(resets, F.lit(True)), cut).otherwise(F.lit(1)).cast("int"), F.size("log"))
    said = F.transform(F.filter(alive, lambda x: x["kind"].isin("delta", "edit")), lambda x: x["text"])
    role = F.filter(F.transform("log", lambda x: x["role"]), lambda x: x.isNotNull())
    return log.select("conv_id", F.col("log")[0]["seq"].alias("first_seq"), "message_id", F.try_element_at(role, F.lit(1)).alias("role"), F.array_join(said, "").alias("text"))


def render(messages: DataFrame, *, learn_from: str = "assistant") -> DataFrame:
    """(conv_id, first_seq, message_id, segment, loss_start, loss_length): a message's part of the formatted conversation.

    A conversation's text is its segments in order of (first_seq, message_id), nothing between. Characters from loss_start on, loss_length of
    them, are under the loss mask (0 for other roles). A null role is written as empty.
    """
    head = F.concat(F.lit(TURN), escape(F.coalesce("role", F.lit(""))), F.lit(TEXT))
    body = escape(F.coalesce("text", F.lit("")))
    learned = F.coalesce(F.col("role") == learn_from, F.lit(False))
    return messages.select(
        "conv_id", "first_seq", "message_id", F.concat(head, body, F.lit(END)).alias("segment"),
        F.length(head).alias("loss_start"), F.when(learned, F.length(body)).otherwise(0).alias("loss_length"),
    )


def parse_segments(segments: DataFrame) -> DataFrame:
    """role and text read back from each segment, and the text under its mask."""
    role = F.regexp_extract("segment", r"(?s)^<\|turn\|>(.*?)<\|text\|>", 1)
    text = F.regexp_extract("segment", r"(?s)<\|text\|>(.*)<\|end\|>\n$", 1)
    under = F.substring(F.col("segment"), F.col("loss_start") + 1, F.col("loss_length"))
    return segments.withColumns({"role": unescape(role), "text": unescape(text), "learned": unescape(under)})


def conversation_digests(segments: DataFrame) -> DataFrame:
    """A row per conversation, read back from its segments: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Segments stream through a task in order and only hash states are held, however long a conversation is.
    """
    small_batches(segments.sparkSession)
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now, state = [], None, None
        close = lambda k, s: {"conv_id": k[0], "n_turns": s[0], "turns_sha256": s[1].hexdigest(), "loss_chars": s[2], "loss_sha256": s[3].hexdigest(), "formatted_chars": s[4]}
        for b in batches:
            for r in b.to_pylist():
                if now != (r["conv_id"],):
                    if now:
                        done.append(close(now, state))
                    now, state = (r["conv_id"],), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{r['role']}\n{r['text']}\n".encode())
                state[2] += len(r["learned"])
                state[3].update(r["learned"].encode())
                state[4] += len(r["segment"])
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        if now:
            yield pa.RecordBatch.from_pylist([*done, close(now, state)], schema)

    ordered = parse_segments(segments).repartition("conv_id").sortWithinPartitions("conv_id", "first_seq", "message_id")
    return ordered.select("conv_id", "role", "text", "learned", "segment").mapInArrow(fold, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
