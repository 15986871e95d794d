"""Findings of earlier reports, as a baseline or for explanation."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditweave import vocab


def read_reports(spark: SparkSession, path: str, project: str | None = None, multi_line: bool = False) -> DataFrame:
    """JSON reports below ``path``; ``project=...`` directories name the project unless one is given.

    ``multi_line`` reads files that hold one indented document each. Unreadable documents give
    no rows, so they suppress nothing.
    """
    schema = vocab.REPORT if project else T.StructType([*vocab.REPORT.fields, T.StructField("project", T.StringType())])
    docs = spark.read.schema(schema).option("multiLine", str(multi_line).lower()).json(path)
    return docs.withColumn("project", F.lit(project)) if project else docs


def report_findings(reports: DataFrame) -> DataFrame:
    """One row per reported finding; missing texts become empty."""
    rows = reports.select("project", F.explode("findings").alias("f")).select("project", "f.*")
    texts = [c for c, kind in rows.dtypes if kind == "string"]
    filled = rows.select(*[F.coalesce(c, F.lit("")).alias(c) if c in texts else F.col(c) for c in rows.columns])
    return filled.withColumnRenamed("id", "finding_id")


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """The findings of JSON reports that were written in parts, one finding to a line."""
    finding = T.StructType([*vocab.FINDING_FIELDS.fields])
    lines = spark.read.text(path)
    found = lines.where(F.col("value").rlike(r'^,?\{"id":')).select(
        F.col("project").cast("string").alias("project"), F.from_json(F.ltrim("value", F.lit(",")), finding).alias("f"))
    return report_findings(found.select("project", F.array("f").alias("findings")))
