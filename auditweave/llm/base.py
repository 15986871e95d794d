"""Small helpers that the operators of this subpackage share."""

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditweave.plans.joins import shared_folder

HELD_OUT = 2


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept for evaluation: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def parts_for(rows: int, per_part: int) -> int:
    """How many parts of about ``per_part`` rows hold ``rows`` rows, one at least."""
    return max(1, -(-rows // per_part))


class Scratch:
    """Tables in the shared folder that are deleted as soon as what was made of them is stored."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def path(self, name: str) -> str:
        self.paths.append(f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}")
        return self.paths[-1]

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    def drop(self) -> None:
        for path in map(self.spark._jvm.org.apache.hadoop.fs.Path, self.paths):
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.paths = []


def packed_rows(docs: DataFrame, *also: str) -> DataFrame:
    """``docs`` as the columns text, ``row`` (all others in a struct) and ``also``; names in it clash with nothing."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.struct(*others).alias("row"), F.col("text").alias("text"), *[F.col(f"`{c}`").alias(c) for c in also])


def unpacked_rows(rows: DataFrame, docs: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of ``docs`` again from :func:`packed_rows`, with another ``text`` if given."""
    text = F.col("text") if text is None else text
    return rows.select(*[text.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def map_texts(
    df: DataFrame,
    column: str,
    added: str,
    worker: Callable[[], Callable[[list], list[pa.Array]]],
    max_chars: int = 4_000_000,
) -> DataFrame:
    """``df`` and the columns ``added`` (a DDL text) that ``worker()`` computes from lists of texts.

    The worker is made once in each task. Lists hold ``max_chars`` characters at most, or one text.
    Columns of ``df`` that are called like the added ones are replaced by them.
    """
    names = [f.strip().split(" ")[0] for f in added.split(",")]
    df = df.drop(*[f"`{c}`" if "." in c else c for c in df.columns if c.lower() in names and c != column])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = worker()
        for batch in batches:
            for part in split_batch(batch, column, max_chars):
                arrays = compute(part.column(column).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=[*part.schema.names, *names])

    return df.mapInArrow(run, schema)


def split_batch(batch: pa.RecordBatch, column: str, max_chars: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts have about ``max_chars`` bytes together."""
    start = total = 0
    sizes = pa.compute.binary_length(batch.column(column)).to_pylist()
    for i, size in enumerate(sizes):
        if total and total + (size or 0) > max_chars:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def sorted_groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """The rows of each group of ``keys`` as one table, from batches that are sorted by them.

    Only the group at hand is held, so a caller bounds the size of its groups, not of its partitions.
    """
    held, of = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k) for k in keys]
        changed = np.zeros(batch.num_rows - 1, dtype=bool)
        for column in columns:
            changed |= pa.compute.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
        for begin, end in zip(cuts, cuts[1:]):
            now = tuple(c[begin].as_py() for c in columns)
            if held and now != of:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(begin, end - begin))
            of = now
    if held:
        yield pa.Table.from_batches(held)
