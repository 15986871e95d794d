"""Every registered query over the given tables: against SQL where there is some, else its shape and rows."""

import pytest

import __spark_entry__ as contract
from auditweave.llm.queries import ORACLES, QUERIES
from tests.oracle import compare, database

SMALL = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op2_edits": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op4_repeats": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op5_neighbours": {"query_id", "rank", "vec_id", "score"},
    "op7_simhash": {"doc_id", "fingerprint", "component_id"},
    "op8_quality": {"doc_id", "score", "keep"},
    "op9_language": {"doc_id", "held_out", "lang_pred", "score"},
    "op10_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "pipeline": {"doc_id", "start", "length", "sequence_id", "offset"},
}


def test_all_are_registered():
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())
    assert {n.split("_")[0] for n in QUERIES} == {"pipeline", *(f"op{i}" for i in range(1, 14))}
    assert set(QUERIES) == set(COLUMNS) | set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(spark, database(SMALL), SMALL, QUERIES[name], ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_gives_its_rows(spark, name):
    got = QUERIES[name](spark, SMALL)
    assert COLUMNS[name] <= set(got.columns)
    rows = got.collect()
    documents = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert rows if name in ("op5_neighbours", "op10_packing", "pipeline") else len(rows) == documents
