"""Chat formatting with prefix-target expansion.

Every assistant turn becomes an example of its own: the turns before it as
context, its text alone trainable, as a span of code points. A turn is written
as START, its role, a line end, its text, END, a line end. Inside texts,
backslashes are doubled and "<|" becomes "<\\|", so that no control string can
stand in them; roles are percent-encoded. Both ways back are exact.

Turns are in the order of `turn`, then role and text; a null text is empty, a
null role is an empty one. Turns after the last assistant turn make one more
row without a span, so that nothing is lost. Rows without conv_id belong to no
conversation and are left out. A conversation's turns come together in one
row, as each of its examples needs them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TARGET = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _opening(turn: Column) -> Column:
    return F.concat(F.lit(START), F.url_encode(turn["role"]), F.lit("\n"))


def formatted(turn: Column) -> Column:
    """A turn (role, text) as the template writes it."""
    return F.concat(_opening(turn), escaped(turn["text"]), F.lit(END + "\n"))


def examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, text, loss_start, loss_end) from conversations (conv_id, turn, role, text): a row for each assistant turn, and one without a span for turns after the last."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    parts = whole.select("conv_id", "turns", F.transform("turns", formatted).alias("parts"))
    each = parts.select("conv_id", "turns", "parts", F.explode(F.sequence(F.lit(1), F.size("turns"))).alias("n_turns"))
    each = each.select("conv_id", "n_turns", F.element_at("turns", F.col("n_turns")).alias("last"), F.array_join(F.slice("parts", F.lit(1), F.col("n_turns")), "").alias("text"), (F.col("n_turns") == F.size("turns")).alias("ends"))
    each = each.where((F.col("last.role") == TARGET) | F.col("ends"))
    stop = F.length("text") - len(END) - 1
    target = F.col("last.role") == TARGET
    start = stop - F.length(escaped(F.col("last.text")))
    return each.select("conv_id", F.col("n_turns").cast("bigint").alias("n_turns"), "text", F.when(target, start).alias("loss_start"), F.when(target, stop).alias("loss_end"))


def turns_in(text: Column) -> Column:
    """The turns, array<struct<role, text>>, that a formatted text holds."""
    pieces = F.split(text, r"<\|im_start\|>")
    pieces = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        begin = F.length(role) + 1
        return F.struct(F.url_decode(role).alias("role"), unescaped(F.substr(piece, begin + 1, F.length(piece) - begin - len(END) - 1)).alias("text"))

    return F.transform(pieces, turn)


def loss_text(text: Column, start: Column, end: Column) -> Column:
    """The trainable text of an example, as it was before escaping."""
    return unescaped(F.substr(text, start + 1, end - start))
