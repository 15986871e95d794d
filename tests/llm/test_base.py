import zlib

import pyarrow as pa

from auditweave.llm import base
from tests.llm.helpers import documents


def sizes():
    return lambda texts: [pa.array([len(t or "") for t in texts], type=pa.int64())]


def test_map_texts_replaces_columns_of_its_name(spark):
    docs = documents(spark, [(1, "abc"), (2, None), (3, "")], ("size", "Size2", "batch"))
    got = base.map_texts(docs, "text", "size bigint", sizes)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "Size2", "batch", "size"]
    assert sorted((r.doc_id, r["size"]) for r in got.collect()) == [(1, 3), (2, 0), (3, 0)]
    assert base.map_texts(documents(spark, []), "text", "size bigint", sizes).count() == 0


def test_batches_are_split_by_size():
    batch = pa.RecordBatch.from_pydict({"text": ["aa", None, "b" * 50, "", "cc", "dd"], "n": list(range(6))})
    parts = list(base.split_batch(batch, "text", 4))
    assert [p.column("n").to_pylist() for p in parts] == [[0, 1], [2], [3, 4, 5]]
    assert list(base.split_batch(batch.slice(0, 0), "text", 4)) == []


def test_rows_are_packed_and_unpacked(spark):
    docs = documents(spark, [(1, "abc"), (None, None)], ("row", "key", "pair"))
    again = base.unpacked_rows(base.packed_rows(docs, "doc_id"), docs)
    assert again.columns == docs.columns and sorted(again.collect(), key=str) == sorted(docs.collect(), key=str)


def test_held_out(spark):
    ids = [*range(60), None]
    got = documents(spark, [(i, "") for i in ids])
    got = {r.doc_id: r.h for r in got.select("doc_id", base.held_out(got.doc_id).alias("h")).collect()}
    assert got == {i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i in ids}


def test_scratch_tables_go(spark):
    scratch = base.Scratch(spark)
    kept = scratch.stored(spark.range(5), "five")
    path = kept.inputFiles()[0]
    assert kept.count() == 5
    scratch.drop()
    assert not spark._jvm.java.io.File(path.removeprefix("file://").removeprefix("file:")).exists()
