"""Chat formatting: conversations are rebuilt from an event log and rendered with a loss mask, in DataFrame expressions only.

Events of one message, by sequence: `message` sets its text, `delta` appends to it, `edit` replaces it, `regenerate`
empties it so that later deltas start anew, `delete` drops it. Every other kind is ignored. The fold needs no loop: the
last event that resets the text starts its version, and what follows is appended.

Template of a turn: `<|im_start|>` role, line feed, text, `<|im_end|>`, line feed. Inside texts `<|` gets a backslash
between its two characters, and one more where backslashes already stand there; in roles `%`, line feeds and `<` are
percent-encoded. Both are reversible, so the formatted string alone gives roles, texts and the loss mask back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

START, END = "<|im_start|>", "<|im_end|>"
RESETS = ("message", "edit", "regenerate")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): the final messages of events(conv_id, message, seq, kind, role, text).

    message orders the messages of a conversation. Ties in seq are read in order of kind and text; repeated events count
    each. A null text or role is empty; the role is that of the version's first event with one, else of any. Messages of
    deltas alone start empty. Null conv_ids form one conversation, null messages one message; null seq comes first.
    """
    e = F.struct(F.col("seq"), F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("text", F.lit("")).alias("text"), F.col("role"))
    log = events.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(e)).alias("log"))
    log = log.withColumn("kinds", F.col("log.kind"))
    last = F.array_max(F.transform("kinds", lambda k, i: F.when(k.isin(*RESETS, "delete"), i).otherwise(-1)))
    log = log.withColumn("last", F.coalesce(last, F.lit(-1)))
    version = F.slice("log", F.greatest(F.col("last"), F.lit(0)) + 1, F.size("log"))
    text = F.array_join(F.transform(F.filter("version", lambda x: x["kind"].isin("message", "edit", "delta")), lambda x: x["text"]), "")
    role = F.coalesce(F.get(F.filter(F.col("version.role"), lambda r: r.isNotNull()), F.lit(0)), F.get(F.filter(F.col("log.role"), lambda r: r.isNotNull()), F.lit(0)), F.lit(""))
    log = log.withColumn("version", version).filter(F.coalesce(F.get("kinds", "last"), F.lit("")) != "delete").filter(F.exists("kinds", lambda k: k.isin(*RESETS, "delta")))
    return log.select("conv_id", "message", role.alias("role"), text.alias("text"))


def from_rows(rows: DataFrame) -> DataFrame:
    """Events of conversations(conv_id, turn, role, text): each row is a message of its own, in order of turn, role, text."""
    message = F.struct(F.col("turn"), F.col("role"), F.col("text"))
    # Equal rows are told apart by their number; what tells them apart is their count, not a sort of the conversation.
    counted = rows.select("conv_id", message.alias("m")).groupBy("conv_id", "m").agg(F.count("*").alias("n"))
    each = counted.select("conv_id", "m", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    return each.select("conv_id", F.struct("m.turn", "m.role", "m.text", "copy").alias("message"), F.lit(0).alias("seq"), F.lit("message").alias("kind"), F.col("m.role").alias("role"), F.col("m.text").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) per conversation of messages(conv_id, message, role, text).

    loss_spans: start and length, in code points of formatted, of the escaped text of each assistant turn. A
    conversation is one string, so it must fit in a row; nothing else is gathered.
    """
    tail = len(END) + 1
    turns = messages.select("conv_id", "message", "role", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"))
    size = F.length("head") + F.length("body") + tail
    turns = turns.withColumn("start", F.sum(size).over(W.partitionBy("conv_id").orderBy("message")) - F.length("body") - tail)
    turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("message", "role", "head", "body", "start"))).alias("t"))
    spans = F.transform(F.filter("t", lambda x: x["role"] == "assistant"), lambda x: F.struct(x["start"].cast("int").alias("start"), F.length(x["body"]).alias("length")))
    formatted = F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(END + "\n"))), "")
    return turns.select("conv_id", formatted.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns: array<struct<role, text>>, loss_text, formatted_chars) read from formatted and loss_spans alone."""
    parts = F.split("formatted", r"<\|im_start\|>")
    parts = F.slice(parts, 2, F.size(parts))
    cut = F.transform(parts, lambda p: F.struct(F.substring_index(p, "\n", 1).alias("role"), p.alias("all")))
    turns = F.transform(cut, lambda x: F.struct(unescape_role(x["role"]).alias("role"), unescape(F.substring(x["all"], F.length(x["role"]) + 2, F.length(x["all"]) - F.length(x["role"]) - 1 - (len(END) + 1))).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return formatted.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))
