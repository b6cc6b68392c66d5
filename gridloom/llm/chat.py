"""Chat formatting with typed content parts, by DataFrame functions only.

A message's content is an array of parts ``struct<type, text, ref, tokens>``.  A visitor flattens the parts in order:
neighbouring texts are joined, escaped as one (a control string may begin in one part and end in the next) and copied, and an image, audio or document part leaves a placeholder ``<|image:0|>`` numbered within the
conversation, whose reference and expanded token count are recorded.

Template, per turn: ``<|turn|>role<|body|>content<|end|>\\n``.  Inside texts and roles, a control string gets one more
backslash after its first character (``<|end|>`` becomes ``<\\|end|>``), which :func:`unescape` takes out again; texts that
already hold such backslashes survive too.

Defined results: a null text is an empty text and a null role an empty role; parts of an unknown type count as text; turns
with equal numbers are ordered by role and content and all kept; null turns come first; a null conversation id is a
conversation of its own; a conversation is one row, so it has to fit a task; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>\n"
ATTACHMENTS = ("image", "audio", "document")
#: First character and rest of every control string, ours and those of common other templates.
CONTROL = r"([<\[])({})(\||/?s>|/?INST\]|</?SYS>>)"
PART = "struct<type:string,text:string,ref:string,tokens:long>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL.format(r"\\*"), r"$1$2\\$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL.format(r"\\*") .replace(r"\\*)(", r"\\*)\\("), r"$1$2$3")


def text_part(text: Column) -> Column:
    """The content of a plain text message."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("long").alias("tokens")))


def flatten_parts(content: Column, first: Column) -> Column:
    """Visit parts in order: struct of the body and the attachments, numbered from ``first``."""
    state = F.struct(F.lit("").alias("body"), F.lit("").alias("text"), F.array().cast("array<struct<type:string,ref:string,tokens:bigint,no:int>>").alias("attachments"))

    def visit(acc: Column, part: Column) -> Column:
        no = (first + F.size(acc["attachments"])).cast("int")
        attached = F.coalesce(part["type"].isin(*ATTACHMENTS), F.lit(False))
        mark = F.concat(F.lit("<|"), part["type"], F.lit(":"), no.cast("string"), F.lit("|>"))
        entry = F.struct(part["type"].alias("type"), part["ref"].alias("ref"), F.coalesce(part["tokens"], F.lit(0).cast("long")).alias("tokens"), no.alias("no"))
        return F.struct(
            F.when(attached, F.concat(acc["body"], escape(acc["text"]), mark)).otherwise(acc["body"]).alias("body"),
            F.when(attached, F.lit("")).otherwise(F.concat(acc["text"], F.coalesce(part["text"], F.lit("")))).alias("text"),
            F.when(attached, F.concat(acc["attachments"], F.array(entry))).otherwise(acc["attachments"]).alias("attachments"),
        )

    def finish(acc: Column) -> Column:
        return F.struct(F.concat(acc["body"], escape(acc["text"])).alias("body"), acc["attachments"].alias("attachments"))

    return F.aggregate(F.coalesce(content, F.array().cast(f"array<{PART}>")), state, visit, finish)


def format_chats(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "content", loss_roles=("assistant",)) -> DataFrame:
    """One row per conversation: formatted text, loss spans (start and length in code points of the formatted text), attachments and their expanded tokens."""
    rows = messages.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.col(content).alias("content"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content")
    attached = F.size(F.filter(F.coalesce("content", F.array().cast(f"array<{PART}>")), lambda p: p["type"].isin(*ATTACHMENTS)))
    before = F.coalesce(F.sum(attached).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.select("conv_id", "role", "content", F.row_number().over(order).alias("place"), before.alias("before"))
    visited = placed.withColumn("flat", flatten_parts(F.col("content"), F.col("before")))
    turns = F.array_sort(F.collect_list(F.struct("place", "role", F.col("flat.body").alias("body"), F.col("flat.attachments").alias("attachments"))))
    chats = visited.groupBy("conv_id").agg(turns.alias("turns"))
    head = lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(BODY))
    pieces = F.transform("turns", lambda t: F.struct(head(t).alias("head"), t["body"].alias("body"), t["role"].isin(*loss_roles).alias("loss"), t["attachments"].alias("attachments")))
    laid = chats.select("conv_id", pieces.alias("pieces"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def place(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["head"])
        span = F.struct((begin + 0).alias("start"), F.length(p["body"]).alias("length"))
        return F.struct((begin + F.length(p["body"]) + len(END)).alias("at"), F.when(p["loss"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    attachments = F.flatten(F.transform("pieces", lambda p, i: F.transform(p["attachments"], lambda a: F.struct(i.alias("turn_no"), a["no"].alias("no"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return laid.select(
        "conv_id",
        F.concat_ws("", F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END)))).alias("formatted"),
        F.aggregate("pieces", start, place, lambda acc: acc["spans"]).alias("loss_spans"),
        attachments.alias("attachments"),
    ).withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda acc, a: acc + a["tokens"]))


def parse_chats(formatted: DataFrame) -> DataFrame:
    """Read a formatted conversation back: its turns (role and text) and the unescaped text under the loss mask."""
    parts = F.filter(F.split("formatted", r"<\|turn\|>"), lambda p: p != "")
    parsed = formatted.withColumn("__gl_parts", parts)
    turn = lambda p: F.struct(
        unescape(F.substring_index(p, BODY, 1)).alias("role"),
        unescape(F.substring_index(F.substring_index(p, BODY, -1), END, 1)).alias("text"),
    )
    masked = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    return parsed.withColumn("turns", F.transform("__gl_parts", turn)).withColumn("loss_text", F.concat_ws("", masked)).drop("__gl_parts")
