"""Joins of a large table with a per-key table whose size is checked first."""

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 20_000
SALTS = 8


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; stops counting one row later."""
    return df.limit(rows + 1).count() <= rows


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    spread: Sequence[str | Column] = (),
    size_of: DataFrame | int | None = None,
    max_rows: int = MAX_BROADCAST_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Join ``big`` with ``small``, which has one row per key and rows of bounded width.

    If ``size_of`` (by default the keys of ``small``) has at most ``max_rows`` rows, ``small`` is
    broadcast. Pass a cheap table with as many rows where ``small`` is expensive to compute, or their number.
    Otherwise both sides are shuffled, and every key is split into ``salts`` parts by a hash of the
    ``spread`` columns, so that one key with a third of all rows still lands in several tasks;
    adaptive execution splits a part that is still too large.
    """
    keys = [on] if isinstance(on, str) else list(on)
    few = size_of <= max_rows if isinstance(size_of, int) else at_most(size_of if size_of is not None else small.select(*keys), max_rows)
    if few:
        return big.join(F.broadcast(small), keys, how)
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    left = big.withColumn("_salt", salt)
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # The hint keeps Catalyst from broadcasting: it would judge by the compressed size before the salts.
    return left.join(right.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def shared_folder(spark: SparkSession) -> str:
    """The folder that survives lost executors, as the cluster names it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder.rstrip("/")


def stored(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from there: no lineage, no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)
