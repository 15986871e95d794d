"""Tables in buckets of their key: a later run that needs some of their rows moves only its own keys."""

import json
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditweave.operators.findings import BASELINE_KEYS

LAYOUT = "keys array<string>, buckets int, fields string"


def write_bucketed(rows: DataFrame, path: str, keys: Sequence[str], buckets: int | None = None) -> None:
    """Store ``rows`` at the new folder ``path``, in ``buckets`` by a hash of ``keys`` and sorted by them.

    Without a number there are as many buckets as shuffle partitions. The layout is written last, so a
    write that died is no table. Keys may be null and repeat, but all rows of a key are in one bucket:
    take keys that no large part of the rows shares.
    """
    spark = rows.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        raise FileExistsError(path)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    _insert(rows, path, keys, buckets, rows.schema)
    spark.createDataFrame([(list(keys), buckets, rows.schema.json())], LAYOUT).coalesce(1).write.parquet(f"{path}/layout")


def append_bucketed(rows: DataFrame, path: str) -> None:
    """Add ``rows`` to the table at ``path``; each bucket gets one more file."""
    keys, buckets, fields = _layout(rows.sparkSession, path)
    _insert(rows, path, keys, buckets, fields)


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path``, whichever session wrote it; plans know its buckets."""
    keys, buckets, fields = _layout(spark, path)
    with _named(spark, path, keys, buckets, fields) as name:
        return spark.table(name)


def rows_for(path: str, wanted: DataFrame) -> DataFrame:
    """The rows of the table at ``path`` whose keys occur in ``wanted``, which has columns called like them.

    The distinct keys of ``wanted`` are shuffled into the table's buckets; the table is read where it lies and only
    sorted, also where one key has a third of the rows of ``wanted``. Null keys match nothing.
    """
    spark = wanted.sparkSession
    keys, buckets, _ = _layout(spark, path)
    # By the number of buckets, or a table with fewer buckets than shuffle partitions would be moved as well.
    ids = wanted.select(*map(_quoted, keys)).distinct().repartition(buckets, *map(_quoted, keys))
    return read_bucketed(spark, path).join(ids, list(keys), "left_semi")


def write_baseline(findings: DataFrame, path: str, buckets: int | None = None) -> None:
    """Store what marks ``findings`` as known, once each; null is the same as empty."""
    write_bucketed(findings.select(*_marks()).distinct(), path, BASELINE_KEYS, buckets)


def add_to_baseline(findings: DataFrame, path: str) -> None:
    """Add the marks of ``findings`` that the baseline does not have yet."""
    marks = findings.select(*_marks()).distinct()
    append_bucketed(marks.join(rows_for(path, marks), list(BASELINE_KEYS), "left_anti"), path)


def baseline_for(findings: DataFrame, path: str) -> DataFrame:
    """The part of a stored baseline that ``findings`` meet: pass it to ``flag_known`` or ``without_known``."""
    return rows_for(path, findings.select(*_marks()))


def write_answers(responses: DataFrame, path: str, buckets: int | None = None) -> None:
    """Store attempts (prompt_id, attempt, response, error and what else they have) by their prompt."""
    write_bucketed(responses, path, ["prompt_id"], buckets)


def answers_for(prompts: DataFrame, path: str) -> DataFrame:
    """The stored attempts at ``prompts`` (prompt_id): pass them to ``replay`` or ``review_errors``."""
    return rows_for(path, prompts.select("prompt_id"))


def _marks() -> list[Column]:
    return [F.coalesce(k, F.lit("")).alias(k) for k in BASELINE_KEYS]


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _layout(spark: SparkSession, path: str) -> tuple[list[str], int, T.StructType]:
    row = spark.read.schema(LAYOUT).parquet(f"{path}/layout").first()
    return row["keys"], row["buckets"], T.StructType.fromJson(json.loads(row["fields"]))


@contextmanager
def _named(spark: SparkSession, path: str, keys: Sequence[str], buckets: int, fields: T.StructType) -> Iterator[str]:
    """A name in the catalogue for the files at ``path``, as only tables have buckets. The name goes, the files stay."""
    name = f"bucketed_{uuid.uuid4().hex}"
    columns = spark._jvm.org.apache.spark.sql.types.DataType.fromJson(fields.json()).toDDL()
    by = ", ".join(map(_quoted, keys))
    place = f"{path}/rows".replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{place}'")
    try:
        yield name
    finally:
        spark.sql(f"DROP TABLE {name}")


def _insert(rows: DataFrame, path: str, keys: Sequence[str], buckets: int, fields: T.StructType) -> None:
    # One task for a bucket, else every task would add a file to every bucket.
    placed = rows.select(*map(_quoted, fields.names)).repartition(buckets, *map(_quoted, keys))
    with _named(rows.sparkSession, path, keys, buckets, fields) as name:
        placed.write.insertInto(name)
