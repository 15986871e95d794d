"""Registry of queries with the SQL that must give the same rows."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Where its scan has fewer tasks than the cluster has threads, its rows are spread."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    threads = spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= threads else rows.repartition(threads)


def whole(df: DataFrame, *columns: str) -> DataFrame:
    """Cast the integer columns to bigint, as the SQL side does."""
    small = {c for c, kind in df.dtypes if kind in ("int", "smallint", "tinyint")}
    chosen = columns or tuple(df.columns)
    return df.select(*[F.col(c).cast("bigint").alias(c) if c in small else F.col(c) for c in chosen])


def joined(column: str, separator: str = "|"):
    """An array of texts as one text."""
    return F.array_join(column, separator).alias(column)
