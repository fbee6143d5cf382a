"""Chat formatting with Spark expressions only.

Template: each turn is ``<|im_start|>role\\ntext<|im_end|>\\n``; adjacent turns of one role share a
block, their texts parted by ``<|im_sep|>``. Inside roles and texts a backslash is doubled and
``<|`` becomes ``<\\|``, so no control string can occur there and unescaping restores them exactly;
a line feed in a role becomes ``<\\nl|``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, SEP = "<|im_start|>", "<|im_end|>", "<|im_sep|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _role_out(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\nl|"))


def _role_in(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\nl|"), F.lit("\n")))


def format_chats(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (array of start and end code points).

    Turns are collected as structs, sorted by (turn, role, text), and adjacent turns of one role are
    merged by an array aggregation. ``loss_spans`` cover the escaped texts of ``loss_role`` turns, one
    span per turn; roles, control strings and separators lie outside. Null texts and roles count as
    empty, null turns sort first, repeated rows are all kept, a null conv_id is a conversation of its
    own, other columns are ignored, and an empty table gives no rows. A conversation becomes one string,
    so its turns necessarily meet in one task; rows of all conversations are spread by conv_id.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    n = F.size("turns")
    # Whether a turn opens and closes a block follows from its neighbours.
    pieces = F.transform("turns", lambda t, i: F.struct(
        F.when((i > 0) & (F.get("turns", i - 1)["role"] == t["role"]), F.lit(SEP))
         .otherwise(F.concat(F.lit(START), _role_out(t["role"]), F.lit("\n"))).alias("before"),
        escape(t["text"]).alias("body"),
        F.when((i < n - 1) & (F.get("turns", i + 1)["role"] == t["role"]), F.lit(""))
         .otherwise(F.lit(f"{END}\n")).alias("after"),
        (t["role"] == loss_role).alias("learn")))
    grouped = grouped.select("conv_id", pieces.alias("pieces"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))
    walked = F.aggregate("pieces", start, lambda acc, p: F.struct(
        (acc["at"] + F.length(p["before"]) + F.length(p["body"]) + F.length(p["after"])).alias("at"),
        F.when(p["learn"], F.concat(acc["spans"], F.array(F.struct(
            (acc["at"] + F.length(p["before"])).alias("start"),
            (acc["at"] + F.length(p["before"]) + F.length(p["body"])).alias("end")))))
         .otherwise(acc["spans"]).alias("spans")))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["body"], p["after"])), "").alias("formatted"),
        walked["spans"].alias("loss_spans"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """Turns and learned texts read back from ``formatted`` and ``loss_spans``.

    Adds turns (array of role and text, unescaped) and learned (array of unescaped texts under the mask).
    """
    blocks = F.filter(F.split("formatted", F.lit("<\\|im_start\\|>")), lambda b: b != "")
    def turns_of(block: Column) -> Column:
        cut = F.instr(block, "\n")
        role = _role_in(F.substring(block, F.lit(1), cut - 1))
        body = F.substring(block, cut + 1, F.length(block) - cut - len(END) - 1)
        return F.transform(F.split(body, F.lit("<\\|im_sep\\|>"), -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))
    return formatted.select(
        "*", F.flatten(F.transform(blocks, turns_of)).alias("turns"),
        F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))).alias("learned"))
