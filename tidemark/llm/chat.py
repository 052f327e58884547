r"""Chat formatting: prefix-target expansion with a reversible template.

A conversation is written turn after turn as ``<turn>### role: text</turn>``. Inside roles
and texts the characters that control strings are made of are replaced (``\`` by ``\b``,
``<`` by ``\l``, ``#`` by ``\h``), so no text can hold a mark, and the replacement can be
undone. Every assistant turn becomes an example of its own: all turns before it as context
and only its text trainable, given as a character range. A conversation that doesn't end in an
assistant turn has one more example, without a trainable range, so that the output holds every turn.

Built-in expressions only. Rows are grouped by conversation, since a formatted conversation
is one text; nothing is gathered across conversations.

Defined results: turns are ordered by turn (null first), then role, then text, so repeated
turn numbers have one order; repeated rows are turns of their own; a null role or text is
an empty one; a row without conv_id is a conversation of its own. Very long texts and conversations are formatted in whole. Other
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import table

OPEN, MARK, CLOSE = "<turn>", "### ", "</turn>"
TRAINED = "assistant"
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
CONTROL_TEXT = r"\### Assistant: </turn> ok"


def escape(c: Column) -> Column:
    for plain, coded in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def unescape(c: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return c


def _colon(c: Column) -> Column:
    """A role has no colon of its own, so that the first ': ' ends it."""
    return F.replace(escape(c), F.lit(":"), F.lit("\\c"))


def _plain_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("\\c"), F.lit(":")))


def conversations_as_text(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, own (the row's number, for rows without conv_id), formatted turns in order, with where
    each begins."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(OPEN + MARK), _colon(role), F.lit(": "))
    turn = F.struct("turn", role.alias("role"), text.alias("text"), head.alias("head"),
                    escape(text).alias("body"))
    own = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    grouped = rows.select("conv_id", own.alias("own"), turn.alias("turn")).groupBy("conv_id", "own") \
        .agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    sizes = F.transform("turns", lambda t: F.length(t["head"]) + F.length(t["body"]) + len(CLOSE))
    starts = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    return grouped.select("conv_id", "own", "turns", starts.alias("starts"), formatted.alias("formatted"))


def expand(rows: DataFrame) -> DataFrame:
    """One example per assistant turn: conv_id, own, target (its place, from 0), text, loss_start, loss_end.

    The range [loss_start, loss_end) counts characters from 0; both are null in the example
    that only completes a conversation.
    """
    t = conversations_as_text(rows)
    n = F.size("turns")
    targets = F.transform("turns", lambda x, i: F.when(
        (x["role"] == TRAINED) | (i == n - 1), F.struct(
            i.alias("target"), F.get("starts", i + 1).alias("upto"),
            F.when(x["role"] == TRAINED, F.get("starts", i) + F.length(x["head"])).alias("begin"), F.length(x["body"]).alias("body"))))
    e = t.select("conv_id", "own", "formatted", F.inline(F.array_compact(targets)))
    return e.select("conv_id", "own", "target", F.expr("left(formatted, upto)").alias("text"),
                    F.col("begin").alias("loss_start"), (F.col("begin") + F.col("body")).alias("loss_end"))


def read_back(examples: DataFrame) -> DataFrame:
    """What the examples hold, parsed from their texts and ranges alone: one row per conversation (conv_id, own)."""
    parsed = F.transform(F.filter(F.split(F.col("whole"), CLOSE), lambda x: x != ""), lambda x: F.struct(
        _plain_role(F.substring_index(F.substr(x, F.lit(len(OPEN + MARK) + 1)), ": ", 1)).alias("role"),
        unescape(F.substr(x, F.instr(x, ": ") + 2)).alias("text")))
    loss = F.when(F.col("loss_start").isNotNull(), unescape(F.substr(
        "text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))))
    return examples.groupBy("conv_id", "own").agg(
        F.max(F.struct("target", "text"))["text"].alias("whole"),
        F.array_sort(F.collect_list(F.struct("target", loss.alias("loss")))).alias("replies"),
        F.sum(F.length("text")).cast("long").alias("example_chars"), F.count(F.lit(1)).alias("n_examples"),
    ).select("conv_id", parsed.alias("turns"), F.array_join(F.transform("replies", lambda r: r["loss"]), "").alias("loss"),
             F.length("whole").cast("long").alias("formatted_chars"), "example_chars", "n_examples")


def with_control_case(rows: DataFrame) -> DataFrame:
    """The conversations and conversation -7, whose two texts are control strings."""
    spark = rows.sparkSession
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise(TRAINED).alias("role"),
                                  F.lit(CONTROL_TEXT).alias("text"))
    return rows.select("conv_id", "turn", "role", "text").unionByName(extra)


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its examples.

    formatted_chars counts the longest example, which holds the whole conversation;
    example_chars counts all examples.
    """
    back = read_back(expand(with_control_case(table(spark, sf_dir, "conversations"))))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"),
                       "formatted_chars", "example_chars", "n_examples")
