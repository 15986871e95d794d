"""Token-bounded, overlapping chunks of texts, without a shuffle."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditweave import vocab
from auditweave.functions import text


def chunk_array(content: Column, tokens: Column, max_tokens: int, overlap_tokens: int) -> Column:
    """Chunks of one text as an array of (index, first line, last line, content).

    Every line is charged the average of the text, so the borders follow from four numbers: the
    lines a chunk can hold, the lines it repeats, the step between chunks and the line count.
    """
    def piece(index: Column, first: Column, last: Column, body: Column) -> Column:
        return F.struct(
            index.cast("int").alias("chunk_index"),
            first.cast("long").alias("line_start"),
            last.cast("long").alias("line_end"),
            body.alias("content"),
        )

    def sizes(source: Column) -> Column:
        lines = F.size(source["text"])
        average = source["tokens"] / lines
        charge = F.greatest(F.lit(1), F.floor(average))
        hold = F.greatest(F.lit(1), F.floor(F.lit(max_tokens) / charge))
        repeat = F.greatest(F.lit(1), F.floor(F.lit(overlap_tokens) / average))
        return F.struct(
            source["text"].alias("text"), lines.alias("lines"),
            hold.cast("long").alias("hold"), repeat.cast("long").alias("repeat"),
            F.greatest(F.lit(1), hold - repeat).cast("long").alias("step"),
        )

    def cut_all(size: Column) -> Column:
        body, lines, hold, repeat, step = (size[n] for n in ("text", "lines", "hold", "repeat", "step"))
        more = F.ceil(F.greatest(F.lit(0), lines - hold) / step).cast("long")

        def cut(i: Column) -> Column:
            last = F.least(lines, hold + i * step)
            first = F.when(i == 0, F.lit(1)).otherwise(F.greatest(F.lit(1), hold + (i - 1) * step - repeat + 1))
            own = F.slice(body, first.cast("int"), (last - first + 1).cast("int"))
            return piece(i, first, last, F.array_join(own, "\n"))

        return F.transform(F.sequence(F.lit(0).cast("long"), more), cut)

    source = F.struct(F.split(content, "\n", -1).alias("text"), tokens.alias("tokens"))
    split_up = text.bind(text.bind(source, sizes), cut_all)
    whole = F.array(piece(F.lit(0), F.lit(1), text.line_count(content), content))
    return F.when(tokens <= max_tokens, whole).otherwise(split_up)


def chunk_text(
    files: DataFrame,
    max_tokens: int = vocab.CHUNK_TOKENS,
    overlap_tokens: int = vocab.CHUNK_OVERLAP,
    counter=text.ESTIMATE,
    keys: Sequence[str] = ("project", "path"),
    is_diff: bool = False,
) -> DataFrame:
    """Split ``content`` into chunks; one row per chunk with true line numbers and the total."""
    counted = files.select(*keys, "content", counter.of(F.col("content")).alias("_tokens"))
    chunks = chunk_array(F.col("content"), F.col("_tokens"), max_tokens, overlap_tokens)
    rows = counted.select(*keys, chunks.alias("_chunks"))
    rows = rows.select(*keys, F.size("_chunks").alias("total_chunks"), F.explode("_chunks").alias("_c"))
    return rows.select(
        *[F.col(k).alias("file_path") if k == "path" else F.col(k) for k in keys],
        "_c.chunk_index", "total_chunks", "_c.line_start", "_c.line_end", "_c.content",
        F.lit(is_diff).alias("is_diff"),
    )
