"""Multi-party dialogues rendered once from the perspective of every participant."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_TURNS = 1_024
SYSTEM = "system"
END = "<|end|>\n"


def _piece(speaker: Column, own: Column) -> Column:
    """The head of a turn: the speaker in whose place the model stands, the system, or a named user."""
    return (
        F.when(own, F.lit("<|assistant|>\n"))
        .when(speaker == SYSTEM, F.lit("<|system|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), speaker, F.lit("|>\n")))
    )


def perspectives(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Every dialogue of ``turns`` (conv_id, turn, role, text) from each participant's perspective, in pieces.

    A participant is a role other than the system that speaks in the dialogue. For each, the dialogue is
    rendered with that speaker as the assistant and all others as users under their names. There is one
    row per perspective and turn, as a whole dialogue in one row would grow with its turns: conv_id,
    assistant, place (from 0), turn, speaker, piece, start and length of the piece in the rendered
    dialogue, mask_start and mask_length of the characters that are trained on (the assistant's own
    text and its end mark; length 0 for others). The pieces by place are the dialogue.

    Places and starts are running sums over blocks of ``block_turns`` turn numbers first and inside the
    blocks then, so a dialogue with any share of the rows is spread over many tasks.

    Nulls: a null role is a participant "unknown", a null text is empty, a null conv_id is a dialogue of
    its own, null turns come first. Ties: rows of one turn are in the order of role and text; repeated
    rows are turns of their own. A dialogue of the system alone has no perspective and no row. Empty
    texts have a piece without text. Empty table: no rows. Other columns are not read.
    """
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("block", F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(-(1 << 62))))
    length = F.length("text").cast("bigint")
    # The characters of a turn for the others; what the own perspective saves on the head is the same each time.
    as_user = F.length(_piece(F.col("speaker"), F.lit(False))) + length + len(END)
    own_less = F.length(_piece(F.col("speaker"), F.lit(False))) - F.length(_piece(F.col("speaker"), F.lit(True)))
    sums = rows.groupBy("conv_id", "block", "speaker").agg(
        F.count(F.lit(1)).alias("turns"), F.sum(as_user).alias("chars"), F.sum(own_less).alias("less"))
    cast = sums.where(F.col("speaker") != SYSTEM).select("conv_id", F.col("speaker").alias("assistant")).distinct()
    per_block = sums.select("conv_id", "block", "speaker", "turns", "chars", "less").alias("b").join(
        cast.alias("c"), F.col("b.conv_id").eqNullSafe(F.col("c.conv_id")))
    own = F.col("b.speaker") == F.col("assistant")
    per_block = per_block.groupBy(F.col("b.conv_id").alias("of_conv"), "assistant", F.col("block").alias("of_block")).agg(
        F.sum("turns").alias("turns"), F.sum(F.col("chars") - F.when(own, F.col("less")).otherwise(0)).alias("chars"))
    before = Window.partitionBy("of_conv", "assistant").orderBy("of_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_block.select(
        "of_conv", "assistant", "of_block",
        F.coalesce(F.sum("turns").over(before), F.lit(0)).alias("place_start"),
        F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("char_start"))
    seen = rows.join(starts, F.col("conv_id").eqNullSafe(F.col("of_conv")) & (F.col("block") == F.col("of_block")))
    own = F.col("speaker") == F.col("assistant")
    seen = seen.withColumn("head", _piece(F.col("speaker"), own))
    size = F.length("head") + length + len(END)
    in_block = Window.partitionBy("conv_id", "block", "assistant").orderBy(F.col("turn").asc_nulls_first(), "speaker", "text")
    earlier = in_block.rowsBetween(Window.unboundedPreceding, -1)
    seen = seen.withColumns({
        "place": F.col("place_start") + F.row_number().over(in_block) - 1,
        "start": F.col("char_start") + F.coalesce(F.sum(size).over(earlier), F.lit(0)),
    })
    trained = F.when(own, length + len(END)).otherwise(F.lit(0))
    return seen.select(
        "conv_id", "assistant", "place", "turn", "speaker",
        F.concat("head", "text", F.lit(END)).alias("piece"),
        "start", size.cast("bigint").alias("length"),
        (F.col("start") + F.length("head")).cast("bigint").alias("mask_start"),
        trained.cast("bigint").alias("mask_length"),
    )
