"""Multi-party perspective rotation of dialogues.

For every participant a dialogue is rendered once with that speaker as the
assistant, the others as users under their names, and a loss mask on the
assistant's words.  The result has a row for each turn of a rendering:
sorting a rendering by turn and joining its texts gives the whole prompt.
So a dialogue of any length is never gathered in one task, and the only
shuffle beyond the participants' (aggregated first) is a join on the dialogue,
whose hot keys the adaptive planner splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
UNKNOWN = "unknown"


def rotate_perspectives(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", narrators: tuple[str, ...] = ("system",)
) -> DataFrame:
    """Render every dialogue from the perspective of each of its participants.

    Result, one row for each (dialogue, perspective, turn): conv_id,
    perspective (the speaker who is the assistant), turn, speaker, role
    (``assistant``, ``user`` or ``system``), name (of a user), text (the rendered
    turn), loss_start and loss_end (code points of ``text`` that bear loss, end
    exclusive: an assistant's words and the end mark; equal where none do).

    ``narrators`` are no participants and stay ``system`` turns.  A null speaker
    is a user named ``unknown`` and never a perspective; a dialogue without
    participants has no rendering.  A null text is empty; null dialogue ids are
    one dialogue; repeated rows and turns are rendered each.  Other columns are
    ignored.
    """
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(speaker_col).cast("string").alias("speaker"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("words"))
    people = rows.where(F.col("speaker").isNotNull() & ~F.col("speaker").isin(*narrators)).select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    narrator = F.coalesce(F.col("speaker").isin(*narrators), F.lit(False))
    mine = F.coalesce(F.col("speaker") == F.col("perspective"), F.lit(False))
    both = rows.join(people, F.col("conv_id").eqNullSafe(F.col("of")))
    both = both.withColumn("role", F.when(narrator, "system").when(mine, "assistant").otherwise("user"))
    both = both.withColumn("name", F.when(F.col("role") == "user", F.coalesce("speaker", F.lit(UNKNOWN))))
    head = F.concat(F.lit(START), "role", F.when(F.col("name").isNotNull(), F.concat(F.lit(" name="), "name")).otherwise(""), F.lit("\n"))
    both = both.withColumn("head", head).withColumn("text", F.concat("head", "words", F.lit(END)))
    begin = F.when(mine, F.length("head")).otherwise(0).cast("long")
    end = F.when(mine, F.length("text") - 1).otherwise(0).cast("long")  # without the line break
    return both.select("conv_id", "perspective", "turn", "speaker", "role", "name", "text", begin.alias("loss_start"), end.alias("loss_end"))
