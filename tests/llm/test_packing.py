import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from auditweave.llm import packing
from tests.llm.helpers import documents, prose

TEXTS = ["", None, "one", prose(1, 3000), prose(2, 700), "é ñ\n\n  x　y" * 50, "a<|endoftext|>b", "x" * 5000, prose(1, 3000)]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_equal_the_tokenizers_library(spark, tokenizer):
    encode = packing.byte_bpe()
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    texts += [t for t in TEXTS if t is not None]
    for text in texts:
        assert tokenizer.encode(text, add_special_tokens=False).ids == encode(text).tolist()


def check(rows, docs, tokenizer, capacity=1024):
    """Every id of every document lies in one piece, and sequences have no gap."""
    ids = {}
    for doc_id, text in docs:
        ids.setdefault(doc_id, []).append(np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4"))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for doc_id, pieces in by_doc.items():
        want = ids[doc_id]
        assert all(len(w) == len(want[0]) for w in want)
        starts = sorted((p.start, p.length) for p in pieces)
        for k in range(len(want)):
            own, at = starts[k :: len(want)], 0
            for start, length in own:
                assert start == at
                at += length
            assert at == len(want[0])
        for p in pieces:
            assert p.doc_tokens == len(want[0])
            assert p.ids_crc32 == zlib.crc32(want[0][p.start : p.start + p.length].tobytes())
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity


def test_pieces_and_sequences(spark, tokenizer):
    docs = [*enumerate(TEXTS), (0, ""), (None, "no id"), (50, prose(5, 40)), *((100 + i, prose(i, 20 + i)) for i in range(300))]
    got = packing.pack(documents(spark, docs, ("rank", "bin", "block")), block_pieces=400).collect()
    check(got, docs, tokenizer)


def test_little_padding(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = packing.pack(docs).collect()
    check(got, [(r.doc_id, r.text) for r in docs.collect()], tokenizer)
    tokens = sum(r.length for r in got)
    assert len({r.sequence_id for r in got}) * 1024 < 1.01 * tokens + 1024


@pytest.mark.parametrize("length", [0, 1, 2, 511, 512, 513, 700, 1023, 1024, 1025, 5000])
def test_cut(length):
    pieces = packing.cut(length)
    assert sum(size for size, _ in pieces) == length
    assert all(1024 // (k + 1) < size <= 1024 // k for size, k in pieces)


def test_empty_table(spark):
    assert packing.pack(documents(spark, [])).count() == 0
