"""A table of findings in which a few ids are found without reading the rest."""

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditweave import vocab
from auditweave.operators.findings import find_by_id
from auditweave.plans.joins import at_most

ROW_GROUP_BYTES = 16_000_000
#: Rows of a page; the page index leads to the pages that may hold an id.
PAGE_ROWS = 1_000
#: Up to so many ids are looked up by the statistics of the files, more by a join.
FEW_IDS = 500


def write_lookup_table(findings: DataFrame, path: str, row_group_bytes: int = ROW_GROUP_BYTES, page_rows: int = PAGE_ROWS) -> None:
    """All findings as Parquet in ranges of ``finding_id``, sorted, with a Bloom filter of the ids in each row group.

    The layout follows ids, not projects, so a million projects make no folders and one with a third of all
    findings spreads over all files. Ranges and filters tell which row groups may hold an id, the page index where.
    """
    fields = [f for f in vocab.FINDING_FIELDS.fieldNames() if f != "id"]
    ranged = findings.select("project", "finding_id", *fields).repartitionByRange("finding_id").sortWithinPartitions("finding_id", "project")
    (
        ranged.write.mode("overwrite")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.bloom.filter.enabled#finding_id", "true")
        .option("parquet.bloom.filter.adaptive.enabled", "true")
        .parquet(path)
    )


def find_in_table(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The findings at ``path`` with the ids in ``wanted(finding_id)``; nulls and repeats in it add nothing.

    A few ids are compared one by one, since a list of more than ten would reach the scan as one range only.
    """
    table = spark.read.parquet(path)
    ids = wanted.select("finding_id").where("finding_id IS NOT NULL").distinct()
    if not at_most(ids, FEW_IDS):
        return find_by_id(table, ids)
    hits = [F.col("finding_id") == r.finding_id for r in ids.collect()]
    return table.where(reduce(or_, hits) if hits else F.lit(False))
