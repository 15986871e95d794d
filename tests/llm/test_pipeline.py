"""Every stage of the pipeline against a brute-force version of it, on what the stage before kept."""

import random
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from tests.llm import test_mixing, test_simhash
from tests.llm.helpers import documents, prose


def rows():
    rng = random.Random(7)
    passage = prose("passage", 90)
    out = []
    for i in range(160):
        text = prose(i, 60 + i, "abcde") if i % 2 else prose(i, 60 + i, "vwxyz")
        if i % 9 == 0:
            text = f"{text} {passage} {prose((i, 'end'), 20)}"
        out.append((i, text, "one" if i % 2 else "two", f"src{i % 4}"))
    for i in range(20):
        words = out[3 * i][1].split(" ")
        if i % 2:
            words[rng.randrange(len(words))] = "changed"
        out.append((200 + i, " ".join(words), out[3 * i][2], "src1"))
    return out + [(300, None, "one", "src0"), (301, "", "two", None), (302, "123 456 ... ###", None, "src2"), (303, prose("long", 4000, "abcde"), "one", None),
                  (0, out[0][1], "two", "src0")]


def cut_passages(texts, length):
    """Bytes of strings that start more than once are cut; characters that lose a byte are left out."""
    data = [t.encode() for t in texts]
    seen = {}
    for d in data:
        for p in range(len(d) - length + 1):
            seen[d[p : p + length]] = seen.get(d[p : p + length], 0) + 1
    out = []
    for d in data:
        gone = [False] * len(d)
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        out.append(bytes(b for b, g in zip(d, gone) if not g).decode("utf-8", "ignore"))
    return out


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pipeline"))
    documents(spark, rows()).write.parquet(f"{folder}/documents.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        out[name] = docs
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    out["end"] = docs
    return out, folder


def pairs(frame):
    return [(r.doc_id, r.text) for r in frame.collect()]


def test_columns_stay(stages):
    kept, _ = stages
    for name in ("near_duplicates", "repeats", "mixing", "packing"):
        assert kept[name].columns == kept["language"].columns


def test_language_keeps_what_has_letters(stages):
    kept, _ = stages
    assert sorted(d for d, _ in pairs(kept["near_duplicates"])) == sorted(r[0] for r in rows() if re.search("[a-z]", r[1] or ""))


def test_one_of_each_group_stays(stages):
    kept, _ = stages
    groups = {component for _, _, component in test_simhash.brute_groups(pairs(kept["near_duplicates"]))}
    assert sorted(d for d, _ in pairs(kept["repeats"])) == sorted(groups)
    assert len(groups) < kept["near_duplicates"].count()


def test_passages_are_cut(stages):
    kept, _ = stages
    before, after = dict(pairs(kept["repeats"])), dict(pairs(kept["mixing"]))
    want = dict(zip(before, cut_passages(before.values(), pipeline.PASSAGE_BYTES)))
    assert after == {d: t for d, t in want.items() if t.strip()}
    assert after != before


def test_sources_meet_their_targets(stages):
    kept, _ = stages
    sizes, taken = {}, {}
    for r in kept["mixing"].collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    for r in kept["packing"].collect():
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    want = test_mixing.targets(sizes)
    assert all(abs(taken.get(s, 0) - want[s]) < 1 for s in sizes)


def test_every_token_is_packed_once(stages):
    kept, folder = stages
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc = {}
    for doc_id, text in pairs(kept["packing"]):
        by_doc.setdefault(doc_id, []).append(len(tokenizer.encode(text, add_special_tokens=False).ids) + 1)
    got, sequences = {}, {}
    for r in kept["end"].collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(got) == set(by_doc)
    for doc_id, sizes in by_doc.items():
        assert sum(length for _, length, _ in got[doc_id]) == sum(sizes)
        assert {t for _, _, t in got[doc_id]} == set(sizes)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024


def test_run_and_empty_documents(spark, stages, tmp_path):
    kept, folder = stages
    assert pipeline.run(spark, folder).count() == kept["end"].count()
    documents(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
