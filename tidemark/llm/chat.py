"""Chat formatting in Spark expressions.

Turn structs are collected and sorted, adjacent turns of one role share a
header, and each conversation becomes a list of segments whose texts joined are
the training text. A segment knows whether the loss counts it.

Template, with the control strings below:

    <|im_start|>ROLE \\n TEXT [<|im_sep|>TEXT ...] <|im_end|>\\n

Escape, reversible: in roles and texts, one backslash is put between each "<"
and "|" that follow each other directly or over backslashes only. So no escaped
text holds "<|", and taking one backslash out restores it. A line feed in a role
is written <|lf|>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values of the template.
START, SEP, END, LINE = "<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|lf|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def format_chats(turns: DataFrame, *, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, segments array<struct<text, loss>>, formatted) per conversation.

    turns: conv_id, turn, role, text; other columns are ignored. Null texts and
    roles are empty, null turns come first, ties go by role and text, repeated
    rows stay repeated. A null conv_id is a conversation of its own. Conversations
    are as long as their turns: the row of one holds it whole.
    """
    struct = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    sorted_turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(struct)).alias("turns"))

    def role_at(i: Column) -> Column:
        return F.get(F.col("turns"), i)["role"]

    def pieces(t: Column, i: Column) -> Column:
        first = (i == 0) | (role_at(i - 1) != t["role"])
        last = (i == F.size("turns") - 1) | (role_at(i + 1) != t["role"])
        role = F.regexp_replace(escape(t["role"]), "\n", LINE)
        lead = F.when(first, F.concat(F.lit(START), role, F.lit("\n"))).otherwise(F.lit(SEP))
        tail = F.when(last, F.lit(END + "\n")).otherwise(F.lit(""))
        return F.array(
            F.struct(lead.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("text"), t["role"].isin(*loss_roles).alias("loss")),
            F.struct(tail.alias("text"), F.lit(False).alias("loss")),
        )

    segments = F.filter(F.flatten(F.transform("turns", pieces)), lambda s: s["loss"] | (s["text"] != ""))
    return (
        sorted_turns.withColumn("segments", segments)
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
        .select("conv_id", "segments", "formatted")
    )


def parse_chats(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns read back from a formatted text."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = unescape(F.regexp_replace(F.substring_index(block, "\n", 1), r"<\|lf\|>", "\n"))
        body = F.regexp_extract(block, r"(?s)\A[^\n]*\n(.*)<\|im_end\|>\n\z", 1)
        return F.transform(
            F.split(body, r"<\|im_sep\|>", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text"))
        )

    return F.flatten(F.transform(blocks, turns))


def loss_text(segments: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
