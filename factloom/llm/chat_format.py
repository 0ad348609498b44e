"""Chat formatting by event-sourced reconstruction, in DataFrame operations only.

An event log has the columns conv_id, turn, seq, kind, role, text. Kinds: ``message`` begins a message at
its turn; ``delta`` appends streamed text; ``edit`` replaces the text; ``regenerate`` discards it and starts
again with its own text (later deltas append). Events are partitioned by conversation and ordered by
(turn, seq); a delta, edit or regeneration acts on the message begun last at its turn (one without a
message begins it). The final messages are rendered with a template whose control strings cannot occur
inside texts, since texts are escaped reversibly, and read back from the rendered string.

A conversation is one string in the end, so it must fit one row; its events are ordered by a window over the
sorted partition, folded per message, and only final messages are collected per conversation.

Edge cases: null text and null role are empty; a null kind is ``message``; a null conv_id forms a
conversation of its own; events equal in turn and seq go by role, then text; repeated events count each; very long
texts stay whole; an empty log gives no rows; extra columns are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BEGIN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of this and of other common templates; all are broken up inside texts.
CONTROL = r"<\|[a-z_]+\|>|</?s>|</?SYS>|\[/?INST\]"


def escape(text: Column) -> Column:
    r"""Backslashes are doubled, and one is put behind the first character of every control string."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, rf"([<\[])(?=(?:(?<=<)\|[a-z_]+\||(?<=<)/?s|(?<=<)/?SYS)>|(?<=\[)/?INST\])", r"$1\\")


def unescape(text: Column) -> Column:
    """A doubled backslash is one; a single one goes."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def reconstruct(events: DataFrame) -> DataFrame:
    """Final messages of an event log: conv_id, pos (order in the conversation), role, text."""
    e = events.select(
        "conv_id", "turn", "seq", F.coalesce("kind", F.lit("message")).alias("kind"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    order = W.partitionBy("conv_id").orderBy("turn", "seq", "role", "text", "kind")
    first = F.lag("turn").over(order)
    begins = (F.col("kind") == "message") | F.row_number().over(order).eqNullSafe(F.lit(1)) | ~first.eqNullSafe(F.col("turn"))
    numbered = e.withColumn("at", F.row_number().over(order)).withColumn("begins", begins.cast("int"))
    numbered = numbered.withColumn("pos", F.sum("begins").over(order.rowsBetween(W.unboundedPreceding, 0)))
    folded = numbered.groupBy("conv_id", "pos").agg(
        F.min_by("role", "at").alias("role"),
        F.max(F.when(F.col("kind") != "delta", F.col("at"))).alias("reset"),
        F.sort_array(F.collect_list(F.struct("at", "text"))).alias("parts"),
    )
    text = F.array_join(F.transform(F.filter("parts", lambda p: p["at"] >= F.coalesce("reset", F.lit(0))), lambda p: p["text"]), "")
    return folded.select("conv_id", "pos", "role", text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """Per conversation: formatted string and the spans (start, length; from 1) of its loss mask."""
    parts = messages.select(
        "conv_id", "pos", (F.col("role") == "assistant").alias("loss"),
        F.concat(F.lit(BEGIN), escape(F.col("role")), F.lit(TEXT)).alias("head"), escape(F.col("text")).alias("body"),
    )
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "head", "body", "loss"))).alias("turns"))
    sizes = whole.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        F.transform("turns", lambda t: F.struct(F.length(t["head"]).alias("head"), F.length(t["body"]).alias("body"), t["loss"].alias("loss"))).alias("sizes"),
    )
    zero = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,len:int>>").alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        start = acc["at"] + s["head"]
        span = F.struct(start.alias("start"), s["body"].alias("len"))
        return F.struct((start + s["body"] + len(END)).alias("at"), F.when(s["loss"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return sizes.select("conv_id", "formatted", F.aggregate("sizes", zero, step)["spans"].alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """From rendered strings alone: the turns (role, text) and the text under the loss mask."""
    cut = F.filter(F.split("formatted", r"<\|end\|>"), lambda x: x != "")
    turns = F.transform(cut, lambda x: F.struct(
        unescape(F.substring_index(F.substr(x, F.lit(len(BEGIN) + 1)), TEXT, 1)).alias("role"),
        unescape(F.substr(x, F.instr(x, TEXT) + len(TEXT))).alias("text"),
    ))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr("formatted", s["start"], s["len"]))), "")
    return formatted.select("conv_id", turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))


def digests(read: DataFrame) -> DataFrame:
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


def as_events(conversations: DataFrame) -> DataFrame:
    """Finished conversations as a log in which every row is a message."""
    return conversations.select("conv_id", "turn", F.lit(0).cast("long").alias("seq"), F.lit("message").alias("kind"), "role", "text")
