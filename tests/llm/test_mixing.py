import re

import pytest

from auditweave.llm import mixing
from tests.llm.helpers import documents, prose


def rows():
    out = [(i, prose(i, 5 + i % 40), "en", f"src{i % 7}") for i in range(400)]
    out += [(1000 + i, prose(i, 50), "en", "hot") for i in range(300)]
    out += [(2000, None, "en", "src1"), (2001, "", "en", None), (2002, "a b c", "en", None), (None, "x y", "en", "src1")]
    return out + [(2002, "a b c", "en", None), (3000, prose(9, 30_000), "en", "src2"), (4000, None, "en", "none")]


def targets(sizes, share=1.5):
    """Share again and again until no source is above twice its size."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full = set()
    while True:
        left = share * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        rest = sum(weight[s] for s in sizes if s not in full)
        level = {s: left * weight[s] / rest for s in sizes if s not in full}
        over = {s for s in level if level[s] > 2 * sizes[s]}
        if not over:
            return level | {s: 2.0 * sizes[s] for s in full}
        full |= over


@pytest.mark.parametrize("bucket_rows", [10, 50_000])
def test_targets_are_met(spark, bucket_rows):
    docs = documents(spark, rows(), ("key", "bucket", "start", "size", "of_source"))
    got = mixing.mix(docs, bucket_rows=bucket_rows).select("row.*", "size", "source_size", "target", "taken").toDF(
        "doc_id", "text", "lang", "source", "n_chars", *"abcde", "size", "source_size", "target", "taken").collect()
    assert len(got) == len(rows())
    sizes, taken = {}, {}
    for r in got:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert 0 <= r.taken <= 2 * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    want = targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for source in sizes:
        assert abs(taken[source] - want[source]) < 1


def test_positions_follow_the_schedule(spark):
    """Half of an even source is read by half of the time, more of an early one and less of a late one."""
    docs = documents(spark, [(i, "w w", "en", f"s{i % 3}") for i in range(900)])
    mixed = mixing.mix(docs).selectExpr("row.source", "explode(epochs) AS e").selectExpr("source", "e.words", "e.position").collect()
    assert all(0 <= r.position <= 1 for r in mixed)
    share = {}
    for s in ("s0", "s1", "s2"):
        own = [r for r in mixed if r.source == s]
        share[s] = sum(r.words for r in own if r.position < 0.5) / sum(r.words for r in own)
    assert share["s0"] == pytest.approx(0.625, abs=0.02)
    assert share["s1"] == pytest.approx(0.5, abs=0.02)
    assert share["s2"] == pytest.approx(0.375, abs=0.02)


def test_curriculum_has_the_words_taken(spark):
    docs = documents(spark, rows())
    words = sum(r.taken for r in mixing.mix(docs).select("taken").collect())
    out = mixing.curriculum(docs)
    assert out.columns == docs.columns
    assert sum(len(r.text.split()) for r in out.collect()) == words


def test_columns_may_have_any_name(spark):
    docs = documents(spark, rows(), ("a.b", "row", "size", "epoch"))
    out = mixing.curriculum(docs)
    assert out.columns == docs.columns
    assert sum(len(r.text.split()) for r in out.collect()) == sum(len(r.text.split()) for r in mixing.curriculum(documents(spark, rows())).collect())


def test_empty_table_and_reruns(spark):
    assert mixing.mix(documents(spark, [])).count() == 0
    docs = documents(spark, rows())
    once = [tuple(r) for r in mixing.mix(docs).select("row.doc_id", "taken").collect()]
    again = [tuple(r) for r in mixing.mix(docs.repartition(5)).select("row.doc_id", "taken").collect()]
    assert sorted(once, key=str) == sorted(again, key=str)
