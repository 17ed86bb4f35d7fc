"""Chat formatting by rotating perspectives.

Every speaker of a dialogue becomes the assistant of one rendering, in which all others
are named users; only what the assistant says is trained on. Column functions and
aggregates only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import quoted
from tessella.scale import running_position

START, END = "<|im_start|>", "<|im_end|>\n"
SYSTEM = "system"
UNNAMED = "unknown"
# Turns of one part of a rendering; longer dialogues come in several parts.
PART_TURNS = 256


def rotate_perspectives(
    df: DataFrame,
    conversation_column: str = "conv_id",
    turn_column: str = "turn",
    speaker_column: str = "role",
    text_column: str = "text",
    part_turns: int = PART_TURNS,
) -> DataFrame:
    """One row per conversation, perspective and part: conversation id, perspective (the
    speaker taken as assistant), part (from 0), n_turns, text, masks (array of start and end
    offsets in ``text``, half open, in code points) and n_trained.

    Turns are ordered by number (NULL first), then speaker and text; repeated rows are
    repeated turns. A NULL speaker is one named ``unknown``, a NULL text is empty. ``system``
    turns keep their role and are nobody's perspective: a conversation without another
    speaker gives no row. NULL conversation ids are one conversation. The mask of an
    assistant turn covers its text and the end mark, not its header. Parts bound the rows
    collected into one text, however long a dialogue is; all its parts together hold every
    turn. Other columns are not read.
    """
    turns = df.select(
        quoted(conversation_column).alias("_conv"),
        quoted(turn_column).cast("long").alias("_turn"),
        F.coalesce(quoted(speaker_column), F.lit(UNNAMED)).alias("_who"),
        F.coalesce(quoted(text_column), F.lit("")).alias("_text"),
    )
    placed = running_position(turns, ["_conv"], ["_turn", "_who", "_text"], "_pos")
    speakers = turns.where(F.col("_who") != SYSTEM).select("_conv", F.col("_who").alias("_me")).distinct()
    seen = placed.alias("t").join(speakers.alias("s"), F.col("t._conv").eqNullSafe(F.col("s._conv"))).select(
        "t._conv", "s._me", "t._who", "t._text", "t._pos"
    )
    mine = F.col("_who") == F.col("_me")
    head = (
        F.when(F.col("_who") == SYSTEM, F.lit(f"{START}system\n"))
        .when(mine, F.lit(f"{START}assistant\n"))
        .otherwise(F.concat(F.lit(f"{START}user name="), "_who", F.lit("\n")))
    )
    pieces = seen.select(
        "_conv",
        "_me",
        F.floor((F.col("_pos") - 1) / part_turns).cast("int").alias("_part"),
        F.struct(
            "_pos",
            head.alias("head"),
            F.concat("_text", F.lit(END)).alias("body"),
            mine.alias("mine"),
        ).alias("_piece"),
    )
    parts = pieces.groupBy("_conv", "_me", "_part").agg(F.array_sort(F.collect_list("_piece")).alias("_pieces"))
    blank = F.array().cast("array<struct<start:int,end:int>>")

    def advance(state: Column, piece: Column) -> Column:
        start = state["at"] + F.char_length(piece["head"])
        end = start + F.char_length(piece["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(
            end.alias("at"),
            F.when(piece["mine"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    masks = F.aggregate(
        "_pieces", F.struct(F.lit(0).alias("at"), blank.alias("spans")), advance, lambda s: s["spans"]
    )
    text = F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["body"])), "")
    rendered = parts.select(
        "_conv", "_me", "_part", F.size("_pieces").alias("n_turns"), text.alias("text"), masks.alias("masks")
    )
    trained = F.aggregate("masks", F.lit(0), lambda n, m: n + m["end"] - m["start"])
    return rendered.select(
        F.col("_conv").alias(conversation_column),
        F.col("_me").alias("perspective"),
        F.col("_part").alias("part"),
        "n_turns",
        "text",
        "masks",
        trained.alias("n_trained"),
    )
