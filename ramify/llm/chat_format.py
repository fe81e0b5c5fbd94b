"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all preceding turns are context, and only that reply is under
the loss mask. A template marks turns; control strings inside texts are escaped, and the escape is undone on reading.

Defined results: a null text or role is empty; turns of a conversation are ordered by turn, then role, then text
(nulls first), so ties and repeated rows have one order and none is lost; a null conversation id is a conversation;
turns after the last reply, or of a conversation without one, come as one example whose target is null, so that the
output holds every turn; an empty table gives no examples; columns beyond the four named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A turn is OPEN role MID text CLOSE.
OPEN, MID, CLOSE = "<s>[INST]", "[/INST]", "</s>"


def escape(text: Column) -> Column:
    """Text in which no control string is left: ~ marks what was replaced, and a ~ of the text is ~0."""
    text = F.replace(text, F.lit("~"), F.lit("~0"))
    text = F.regexp_replace(text, r"<(?=/?s>)", "~1")
    return F.regexp_replace(text, r"\[(?=/?INST\])", "~2")


def unescape(text: Column) -> Column:
    """What escape() was given: ~0 is undone last, as in JSON pointers."""
    text = F.replace(text, F.lit("~2"), F.lit("["))
    text = F.replace(text, F.lit("~1"), F.lit("<"))
    return F.replace(text, F.lit("~0"), F.lit("~"))


def format_conversations(rows: DataFrame, target_role: str = "assistant") -> DataFrame:
    """Rows (conv_id, turn, role, text) to examples: conv_id, example, n_turns, formatted, loss_start, loss_length.

    example counts from 0; loss_start (code points from 0) and loss_length mark the target's text in `formatted`,
    null where there is no target. The unit is the conversation: its turns meet in one task.
    """
    turns = rows.select(
        "conv_id",
        F.struct(
            F.col("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    marked = grouped.select(
        "conv_id",
        F.transform(
            "turns",
            lambda t: F.struct(t["role"].alias("role"), F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MID)).alias("head"), escape(t["text"]).alias("body")),
        ).alias("turns"),
    )
    # last turns of the examples: the replies, and the last turn of all
    last = F.size("turns") - 1
    ends = F.filter(F.sequence(F.lit(0), last), lambda i: (F.get("turns", i)["role"] == target_role) | (i == last))
    examples = marked.select("conv_id", "turns", F.posexplode(ends).alias("example", "last"))
    target = F.get("turns", "last")
    text = F.array_join(F.transform(F.slice("turns", 1, F.col("last") + 1), lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    is_reply = target["role"] == target_role
    return (
        examples.select("conv_id", "example", (F.col("last") + 1).alias("n_turns"), text.alias("formatted"), is_reply.alias("r"), F.length(target["body"]).alias("n"))
        .select(
            "conv_id", "example", "n_turns", "formatted",
            F.when(F.col("r"), F.length("formatted") - len(CLOSE) - F.col("n")).alias("loss_start"),
            F.when(F.col("r"), F.col("n")).alias("loss_length"),
        )
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted string, with escapes undone."""
    parts = F.filter(F.split(formatted, CLOSE), lambda p: p != "")

    def turn(p: Column) -> Column:
        inner = F.substr(p, F.lit(len(OPEN) + 1))
        return F.struct(unescape(F.substring_index(inner, MID, 1)).alias("role"), unescape(F.substr(inner, F.instr(inner, MID) + len(MID))).alias("text"))

    return F.transform(parts, turn)


def read_loss(examples: DataFrame) -> Column:
    """The text under the mask of an example, with escapes undone."""
    return unescape(F.substr(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_length")))


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation, from the formatted output alone: counts and hashes of its turns and of all text under the mask."""
    read = examples.select(
        "conv_id", "example", "n_turns", F.length("formatted").cast("long").alias("chars"), read_loss(examples).alias("loss"),
        read_turns(F.col("formatted")).alias("turns"),
    ).select(
        "conv_id", "example", "n_turns", "chars", "loss", F.size("turns").cast("long").alias("n_read"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("sha"),
    )
    loss = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))), lambda x: x["loss"]), "")
    return (
        read.groupBy("conv_id")
        .agg(F.max_by("n_read", "n_turns").alias("n_turns"), F.max_by("sha", "n_turns").alias("turns_sha256"), loss.alias("loss"), F.sum("chars").alias("formatted_chars"))
        .select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
    )
