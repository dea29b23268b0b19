"""Chat formatting by prefix-target expansion: every assistant turn becomes one example whose context is all turns before it; only that reply is trainable.

The template writes a turn as ``<|turn|>ROLE`` newline, the text, ``<|end|>`` newline. Inside roles and
texts a backslash becomes ``\\\\``, ``<`` becomes ``\\(`` and ``[`` becomes ``\\{`` (in roles a newline also
becomes ``\\n``), so no control string that begins with ``<`` or ``[`` can occur there, and
``unescape`` gives the text back exactly.

Turns after the last assistant turn (or of a conversation without one) are kept by a last example
without a trainable part (loss_length 0, target_turn null), so the output holds every turn. Null text and null role
count as empty; rows of a conversation go by turn (nulls first), then role, then text; a null conv_id is a conversation of its own.
The method's output grows with turns times length of a conversation; each example is one row, never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's marks.
TURN, END = "<|turn|>", "<|end|>\n"


def escape(text: Column) -> Column:
    for a, b in (("\\", "\\\\"), ("<", "\\("), ("[", "\\{")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    """Undo ``escape``: split at the escaped backslashes first, so that each other escape stands for itself."""
    parts = F.split(text, "\\\\\\\\")
    parts = F.transform(parts, lambda x: F.replace(F.replace(F.replace(x, F.lit("\\("), F.lit("<")), F.lit("\\{"), F.lit("[")), F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def expand(df: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target_role: str = "assistant") -> DataFrame:
    """Examples: (conv_id, example, n_turns, n_examples, target_turn, formatted, loss_start, loss_length); positions in code points, loss_start from 0."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    shown = F.replace(escape(role), F.lit("\n"), F.lit("\\n"))
    turns = df.select(
        F.col(id_col).alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), F.concat(F.lit(TURN), shown, F.lit("\n")).alias("head"), escape(text).alias("body")).alias("t"),
    )
    convs = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    n = F.size("turns")
    is_target = lambda i: F.element_at(F.col("turns"), i)["role"] == target_role
    targets = F.filter(F.sequence(F.lit(1), n), lambda i: is_target(i) | (i == n))
    convs = convs.select("conv_id", "turns", n.alias("all"), F.size(targets).alias("n_examples"), F.posexplode(targets).alias("example", "upto"))
    convs = convs.withColumn("last", F.element_at("turns", F.col("upto")))
    before = F.array_join(F.transform(F.slice("turns", 1, F.col("upto") - 1), lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    convs = convs.select("conv_id", "example", "n_examples", F.col("upto").alias("n_turns"), "last", F.concat(before, F.col("last.head")).alias("context"))
    trained = F.col("last.role") == target_role
    return convs.select(
        "conv_id", "example", "n_examples", "n_turns",
        F.when(trained, F.col("last.turn")).alias("target_turn"),
        F.concat("context", "last.body", F.lit(END)).alias("formatted"),
        F.char_length("context").alias("loss_start"),
        F.when(trained, F.char_length("last.body")).otherwise(0).alias("loss_length"),
    )


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted example."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda x: x != "")

    def turn(piece: Column) -> Column:
        body = F.substring(piece, F.lit(len(TURN) + 1), F.char_length(piece))
        cut = F.instr(body, "\n")
        return F.struct(unescape(F.substring(body, F.lit(1), cut - 1)).alias("role"), unescape(F.substring(body, cut + 1, F.char_length(body))).alias("text"))

    return F.transform(pieces, turn)


def read_back(examples: DataFrame) -> DataFrame:
    """One row per conversation, from the formatted examples alone: all turns (from the longest example) and all text under the loss mask, in order."""
    last = F.col("example") == F.col("n_examples") - 1
    said = F.transform(parse(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.when(F.col("loss_length") > 0, unescape(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_length")))).otherwise("")
    rows = examples.select(
        "conv_id",
        F.when(last, F.struct(F.size(parse(F.col("formatted"))).cast("long").alias("n_turns"), F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"))).alias("whole"),
        F.struct("example", loss.alias("loss")).alias("part"),
        F.char_length("formatted").cast("long").alias("chars"),
    )
    rows = rows.groupBy("conv_id").agg(F.max("whole").alias("whole"), F.array_sort(F.collect_list("part")).alias("parts"), F.sum("chars").alias("formatted_chars"))
    rows = rows.withColumn("loss", F.array_join(F.transform("parts", lambda p: p["loss"]), ""))
    return rows.select("conv_id", F.col("whole.n_turns").alias("n_turns"), F.col("whole.turns_sha256").alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
