import hashlib
import random

import numpy as np

from auditweave.llm import edits
from tests.llm.helpers import documents, prose


def expected(rows):
    """(doc_id, n_chars, edited_sha256, near_edited, near_next) by brute force; rows have distinct ids."""
    rows = sorted(rows, key=lambda r: -(r[0] if r[0] is not None else -1))
    texts = [t or "" for _, t in rows]
    out = []
    for i, (doc_id, _) in enumerate(rows):
        own, following = texts[i], texts[(i + 1) % len(rows)]
        part = len(own) // 3
        changed = own[: len(own) - part] + following[:part]
        a, b, c = edits.fingerprints([own, changed, following])
        bits = [np.unpackbits(x ^ a).sum() for x in (b, c)]
        near = [max(0.0, 1 - 2 * int(n) / 512) for n in bits]
        out.append((doc_id, len(own), hashlib.sha256(changed.encode()).hexdigest(), a.tobytes().hex(), b.tobytes().hex(), *near))
    return sorted(out, key=str)


def test_report_equals_brute_force(spark):
    rows = [(i * 7 % 211, prose(i, 1 + i * 13 % 90)) for i in range(1, 100)]
    rows += [(500, None), (501, ""), (502, "é" * 10), (503, "ab"), (None, "no id at all"), (504, prose("long", 30_000)), (505, "ab")]
    got = edits.edit_report(documents(spark, rows, ("edge", "part", "following")))
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)


def test_one_row_and_none(spark):
    assert [tuple(r) for r in edits.edit_report(documents(spark, [(1, "abcdef")])).collect()] == expected([(1, "abcdef")])
    assert edits.edit_report(documents(spark, [])).count() == 0


def test_repeated_rows_keep_their_number(spark):
    rows = [(1, "one text here"), (1, "one text here"), (2, "another"), (1, "and more of it")]
    got = edits.edit_report(documents(spark, rows)).collect()
    assert sorted(r.doc_id for r in got) == [1, 1, 1, 2]


def test_walks_alone_and_together_agree():
    texts = [prose(i, 1 + i % 70) for i in range(80)] + ["", "x"]
    together = edits.fingerprints(texts)
    for i, text in enumerate(texts):
        assert (edits.fingerprints([text])[0] == together[i]).all()


def test_likeness_falls_with_edits():
    rng = random.Random(5)
    texts = [prose(i, 400) for i in range(30)]

    def changed(text, share):
        text = list(text)
        for _ in range(int(len(text) * share)):
            text[rng.randrange(len(text))] = rng.choice("abcdefgh ")
        return "".join(text)

    base = edits.fingerprints(texts)
    near = [float(np.mean(edits.likeness(base, edits.fingerprints([changed(t, s) for t in texts])))) for s in (0.0, 0.002, 0.02, 0.5)]
    assert near[0] == 1.0 and near[0] > near[1] > near[2] > near[3] and near[1] > 0.8 and near[3] < 0.35


def test_near_documents(spark):
    texts = [prose(i, 300) for i in range(20)]
    copies = [t[:-12] + "tail" for t in texts[:10]]
    prints = [x.tobytes().hex() for x in edits.fingerprints(texts + copies)]
    frame = spark.createDataFrame([(p,) for p in [*prints, prints[0], None]], "fingerprint string")
    groups = dict(map(tuple, edits.near_documents(frame).collect()))
    assert set(groups) == set(prints)
    for i in range(10):
        assert groups[prints[i]] == groups[prints[20 + i]]
    assert len(set(groups.values())) == 20
    assert edits.near_documents(frame.limit(0)).count() == 0


def test_near_documents_keeps_chains(spark):
    """One bucket holds chains of versions, each alike to the next only; groups are the brute-force components."""
    rng = np.random.default_rng(4)
    sampled = np.random.default_rng((edits.SEED, 2)).choice(edits.BITS // 4, 6, replace=False)
    free = np.setdiff1d(np.arange(edits.BITS), (sampled[:, None] * 4 + np.arange(4)).ravel())
    prints = []
    for _ in range(6):
        bits = np.zeros(edits.BITS, dtype=np.uint8)
        bits[free] = rng.integers(0, 2, len(free))
        for _ in range(10):
            prints.append(np.packbits(bits))
            bits = bits.copy()
            bits[rng.choice(free, 40, replace=False)] ^= 1
    prints = np.array(prints)
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in np.flatnonzero(edits.likeness(prints[:i], prints[i]) >= edits.LIKENESS):
            parent[find(i)] = find(int(j))
    names = [p.tobytes().hex() for p in prints]
    groups = dict(map(tuple, edits.near_documents(spark.createDataFrame([(n,) for n in names], "fingerprint string"), bands=1).collect()))
    assert len({find(i) for i in range(len(names))}) == 6
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            assert (groups[a] == groups[b]) == (find(i) == find(j))
