"""Chat formatting by prefix-target expansion: one example per assistant turn.

A turn is written ``<s>role[INST] text [/INST]</s>``.  Each assistant turn becomes an example of its
own: all turns before it as context, then the reply, and only the reply's text is trainable
(``loss_start`` to ``loss_end``, code points).  What follows the last reply of a conversation, or a
conversation without one, gives one more example without a target, so no turn is lost.

Control strings inside a role or text are escaped by one more backslash after their bracket
(``[INST]`` to ``[\\INST]``, ``[\\INST]`` to ``[\\\\INST]``), which ``unescape`` takes away again;
every other text stays as it is.

One shuffle by conversation; a window hands each row the pieces up to it.  An example is a row, so its
text has to fit into one (2 GB): that is the feature's own bound.  No example is cut.

Defined results: null text and null role are empty; rows are ordered by turn (null last), equal turns by
role, then text; repeated rows are turns of their own; rows without conversation id are one conversation;
an empty table gives no example; other columns are left out, so their names cannot clash.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The template and the strings that it gives a meaning.
OPEN, TEXT, CLOSE = "<s>", "[INST] ", " [/INST]</s>"
CONTROL = r"(/?INST\]|/?s>)"
ASSISTANT = "assistant"

ESCAPE = rf"([\[<])(\\*){CONTROL}", r"$1\\$2$3"
UNESCAPE = rf"([\[<])\\(\\*){CONTROL}", "$1$2$3"
TURN = r"(?s)<s>(.*?)\[INST\] (.*?) \[/INST\]</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, *ESCAPE)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, *UNESCAPE)


def examples(turns: DataFrame) -> DataFrame:
    """conv_id, target_turn (null: no reply), n_turns, whole, text, loss_start, loss_end of every example.

    ``turns`` has conv_id, turn, role and text.  ``whole`` marks the example that holds every turn.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("said"))
    rows = rows.withColumn("reply", escape(F.col("said"))).withColumn(
        "piece", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(TEXT), F.col("reply"), F.lit(CLOSE)))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "said")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("conv_id", "turn", F.char_length("reply").alias("reply_chars"), (F.col("role") == ASSISTANT).alias("target"),
                       F.lead(F.lit(False), 1, True).over(order).alias("whole"), F.collect_list("piece").over(so_far).alias("pieces"))
    end = F.char_length("text") - len(CLOSE)
    return (rows.where("target OR whole")
            .select("conv_id", F.when(F.col("target"), F.col("turn")).alias("target_turn"), "target", "whole", "reply_chars",
                    F.size("pieces").cast("long").alias("n_turns"), F.array_join("pieces", "").alias("text"))
            .select("conv_id", "target_turn", "n_turns", "whole", "text",
                    F.when(F.col("target"), end - F.col("reply_chars")).alias("loss_start"), F.when(F.col("target"), end).alias("loss_end")))


def read_back(made: DataFrame) -> DataFrame:
    """Digests per conversation, read from the text and loss mask of its examples."""
    # no control string holds a line break, so undoing the escapes after the joining cannot bridge two turns
    said = unescape(F.regexp_replace("text", F.lit(TURN), F.lit("$1\n$2\n")))
    masked = unescape(F.substring("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    whole = F.col("whole")
    rows = made.select(
        "conv_id", F.when(whole, F.regexp_count("text", F.lit(CLOSE.strip().replace("[", r"\[").replace("]", r"\]"))).cast("long")).alias("n"),
        F.when(whole, F.sha2(said.cast("binary"), 256)).alias("turns"),
        F.when(F.col("loss_start").isNotNull(), F.struct("n_turns", masked.alias("reply"))).alias("loss"),
        F.char_length("text").cast("long").alias("chars"))
    loss = rows.groupBy("conv_id").agg(
        F.max("n").alias("n_turns"), F.max("turns").alias("turns_sha256"), F.sum("chars").alias("formatted_chars"),
        F.array_join(F.transform(F.sort_array(F.collect_list("loss")), lambda x: x["reply"]), "").alias("loss"))
    return loss.select("conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"),
                       F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
