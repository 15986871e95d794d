import pytest
from pyspark.sql import functions as F

from auditweave import vocab
from auditweave.sinks import lookup

ROWS = 60_000


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lookup") / "t")
    fields = [f for f in vocab.FINDING_FIELDS.fields if f.name != "id"]
    # Two thirds of the findings are of one project.
    project = F.when(F.col("id") % 3 < 2, F.lit("hot")).otherwise(F.concat(F.lit("p"), F.col("id")))
    rows = spark.range(ROWS).select(
        project.alias("project"), F.concat(F.lit("FND-"), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 16)).alias("finding_id"),
        *[F.lit(None).cast(f.dataType).alias(f.name) if f.name != "title" else F.sha2(F.concat(F.lit("t"), F.col("id")), 256).alias("title") for f in fields],
    )
    lookup.write_lookup_table(rows, path, row_group_bytes=100_000, page_rows=100)
    return path, [r.finding_id for r in rows.select("finding_id").orderBy(F.xxhash64("finding_id")).limit(700).collect()]


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "finding_id string")


def rows_read(found):
    plan = found._jdf.queryExecution().executedPlan()
    found._jdf.queryExecution().toRdd().count()
    return plan.collectLeaves().head().metrics().get("numOutputRows").get().value()


def test_ten_ids_read_a_small_part(spark, table):
    path, known = table
    found = lookup.find_in_table(spark, path, ids(spark, known[:10]))
    assert sorted(r.finding_id for r in found.collect()) == sorted(known[:10])
    assert 10 <= rows_read(found) < 0.05 * ROWS


def test_unknown_null_and_repeated_ids(spark, table):
    path, known = table
    found = lookup.find_in_table(spark, path, ids(spark, [known[0], known[0], None, "FND-none"]))
    assert [r.finding_id for r in found.collect()] == [known[0]]
    assert lookup.find_in_table(spark, path, ids(spark, [])).count() == 0


def test_many_ids_are_joined(spark, table):
    path, known = table
    found = lookup.find_in_table(spark, path, ids(spark, known))
    assert sorted(r.finding_id for r in found.collect()) == sorted(known)
