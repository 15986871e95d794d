"""Mixing sources to target weights along a time-varying curriculum."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditweave.llm.base import parts_for
from auditweave.plans.joins import stored

WEIGHTS = (5, 2, 1)
#: Slope of a source's weight over training time, by the same turn: early, even and late sources.
SLOPES = (-0.5, 0.0, 0.5)
SHARE = 1.5
MOST = 2
BUCKET_ROWS = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def turn(rank: Column, values: Sequence[float]) -> Column:
    """The value of ``values`` whose turn it is at ``rank`` (from 0), again and again."""
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (rank % len(values) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, slopes: Sequence[float] = SLOPES,
                   share: float = SHARE, most: int = MOST) -> DataFrame:
    """Per source (columns source, source_size) its weight, slope, target and quota in whole words.

    One row per source is ordered in one task, so that task grows with the number of different sources and
    with nothing else. Water is filled to one level: a source that
    reaches ``most`` times its size stops there and the rest is shared by weight.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(every) - 1)
    ranked = ranked.withColumn("weight", turn(F.col("rank"), weights)).withColumn("slope", turn(F.col("rank"), slopes))
    cap = (F.col("source_size") * most).cast("double")
    filled = Window.orderBy((cap / F.col("weight")).asc(), "rank")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    everything = filled.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = F.when(left / rest * F.col("weight") < cap, left / rest)
    # The first source in this order that is not full gives the level of all after it.
    ranked = ranked.withColumn("own_level", level)
    ranked = ranked.withColumn("level", F.first("own_level", ignorenulls=True).over(filled.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.when(F.col("level").isNull(), cap).otherwise(F.least(cap, F.col("level") * F.col("weight")))
    return ranked.select("source", "source_size", "slope", target.alias("target"), F.floor(target).cast("bigint").alias("quota"))


def position(words: Column, target: Column, slope: Column) -> Column:
    """The training time in [0, 1] at which a source has spent ``words`` of its ``target``.

    The weight over time is ``1 + slope (2u - 1)`` of its mean; its integral ``u + slope (u*u - u)`` is
    inverted in closed form.
    """
    spent = words / F.nullif(target, F.lit(0.0))
    return 2 * spent / ((1 - slope) + F.sqrt((1 - slope) * (1 - slope) + 4 * slope * spent))


def mix(docs: DataFrame, size: Column | None = None, weights: Sequence[float] = WEIGHTS, slopes: Sequence[float] = SLOPES,
        share: float = SHARE, most: int = MOST, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Every row of ``docs`` as struct ``row``, with ``size, source_size, target, taken, epochs``.

    ``docs`` has doc_id, source and text, or what ``size`` is computed from. A source's documents are
    laid end to end in the order of a hash of their ids, as often as its target asks; the mix takes the
    words up to the target. ``epochs`` has one (words, position) for each time a document is taken,
    where the position inverts the source's integrated demand. Running sums are split into hash
    buckets, so that a source with any share of the rows is summed by many tasks.

    Nulls: a null text has size 0, a null source is a source (the last), a null id is hashed as empty.
    Repeated rows and ties: each row takes its own place; equal rows are alike, so their order is
    immaterial. Empty table: no rows. Documents of size 0 take nothing. Other columns stay in ``row``.
    """
    size = word_count(F.col("text")) if size is None else size
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    slim = stored(docs.select(F.col("source").alias("source"), size.alias("size"), key.alias("key")), "mixing")
    digits = len(f"{parts_for(slim.count(), bucket_rows):x}")
    sums = slim.groupBy("source", F.substring("key", 1, digits).alias("bucket")).agg(F.sum("size").alias("words"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, slopes, share, most)
    in_source = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("words").over(in_source), F.lit(0)))
    starts = starts.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select(
        F.col("s.source").alias("of_source"), F.col("bucket").alias("of_bucket"), "start", "source_size", "target", "quota", "slope")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source").alias("source"), size.alias("size"), key.alias("key"))
    rows = rows.withColumn("bucket", F.substring("key", 1, digits))
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("bucket") == F.col("of_bucket")))
    in_bucket = Window.partitionBy("source", "bucket").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.col("start") + F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
    begins = [F.col("start") + i * F.col("source_size") for i in range(most)]
    takes = [F.greatest(F.lit(0), F.least(F.col("size"), F.col("quota") - b)).cast("bigint") for b in begins]
    taken = takes[0]
    for more in takes[1:]:
        taken = taken + more
    epochs = F.array(*[
        F.struct(t.alias("words"), position(b.cast("double"), F.col("target"), F.col("slope")).alias("position"))
        for t, b in zip(takes, begins, strict=True)
    ])
    return rows.select("row", "size", "source_size", "target", taken.alias("taken"), F.filter(epochs, lambda e: e["words"] > 0).alias("epochs"))


def range_sorted(rows: DataFrame, *by: Column) -> DataFrame:
    """Rows in ranges of ``by``, sorted within each range: the order in which training reads them.

    Further columns after the position split ranges of equal or missing positions.
    """
    return rows.repartitionByRange(*by).sortWithinPartitions(*by)


def curriculum(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus itself: one row per document and epoch, the columns of ``docs``, in training order.

    A document that the target cuts keeps its first words (separated by single spaces). Null and empty texts
    have no words and no row; ids and sources may be null; repeated rows each take their turn. Empty table:
    no rows. Columns may have any name.
    """
    words = F.col("epoch.words")
    rows = mix(docs, **options).withColumn("epoch", F.explode("epochs"))
    cut_text = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0)), F.lit(1), words.cast("int")), " ")
    text = F.when(words < F.col("size"), cut_text).otherwise(F.col("row.text"))
    rows = rows.withColumn("row", F.col("row").withField("text", text))
    return range_sorted(rows.select("row", "epoch"), F.col("epoch.position")).select("row.*")
