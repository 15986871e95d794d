import hashlib
import random

import numpy as np
import pytest

from auditweave.llm import repeats
from tests.llm.helpers import documents, prose


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for text in texts:
        for p in range(len(text) - length + 1):
            seen[text[p : p + length]] = seen.get(text[p : p + length], 0) + 1
    out = []
    for (doc_id, _), text in zip(rows, texts):
        gone = np.zeros(len(text) + 1, dtype=bool)
        for p in range(len(text) - length + 1):
            if seen[text[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = bytes(b for b, g in zip(text, gone) if not g)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((doc_id, len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def sample(length):
    rng = random.Random(3)
    shared = [prose(f"p{i}", length // 3) for i in range(6)]
    edge = prose("edge", 2 * length)[: length + 3]
    rows = []
    for i in range(60):
        parts = [prose(i, rng.randint(5, 60))]
        for _ in range(rng.randint(0, 3)):
            piece = rng.choice(shared)
            cut = rng.randint(0, 8)
            parts += [piece[cut : len(piece) - rng.randint(0, 8)], prose((i, len(parts)), rng.randint(1, 30))]
        rows.append((i, rng.choice(["", " ", "é"]).join(parts)))
    rows += [(100 + i, f"{prose(i, 9)}{edge}{prose(-i, 9)}") for i in range(1, 9)]
    rows += [(200, "ab" * length), (201, "z" * (length + 1)), (202, "q" * length), (203, "ü" * length)]
    rows += [(300, rows[0][1]), (301, rows[1][1]), (301, rows[1][1]), (302, None), (303, ""), (None, "short"), (None, prose(5, 40))]
    return rows + [(304, prose("long", 20_000) + shared[0]), (305, prose("x", 10) + edge[:length]), (306, prose("y", 8) + edge[:length - 1])]


@pytest.mark.parametrize(("length", "group_segments", "block_bytes"), [(60, 2000, 1 << 20), (60, 3, 2000), (400, 2000, 20_000)])
def test_equals_brute_force(spark, length, group_segments, block_bytes):
    rows = sample(length)
    docs = documents(spark, rows, ("key", "copies", "body"))
    got = repeats.repeat_report(docs, length, group_segments=group_segments, block_bytes=block_bytes)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == brute(rows, length)
    # What is left is the text less the removed bytes, and less the rest of cut characters.
    for r in got.collect():
        assert 0 <= r.n_bytes - r.n_removed - len(r.text.encode()) <= 6 * r.n_spans
        if len(r.text.encode()) == r.n_bytes - r.n_removed:
            assert hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256


def test_interval_expansion_equals_brute_force():
    rng = random.Random(4)
    for length in (3, 8, 20):
        segments = ["".join(rng.choices("ab", k=rng.randint(0, 60))).encode() for _ in range(12)] + [b"\xff\x00" * 15]
        seen = {}
        for s in segments:
            for p in range(len(s) - length + 1):
                seen[s[p : p + length]] = seen.get(s[p : p + length], 0) + 1
        flags, at = repeats.repeated_starts(segments, length), 0
        for s in segments:
            for p in range(len(s) - length + 1):
                assert flags[at + p] == (seen[s[p : p + length]] > 1)
            at += len(s) + 1


def test_cells_hold_each_start_once():
    texts = [prose(i, 80).encode() for i in range(5)] + [b"", b"x" * 300]
    own, group, lo, hi, at = repeats.cells_of(texts, 60)
    for i, text in enumerate(texts):
        starts = sorted(p for k in np.flatnonzero(own == i) for p in range(lo[k], hi[k] + 1))
        assert starts == list(range(max(0, len(text) - 59)))
    assert ((lo <= at) & (hi <= at)).sum() >= 0 and (at - lo <= 60).all() and len(group) == len(at)


def test_rest_of_the_corpus(spark):
    rows = sample(60)
    docs = documents(spark, rows, ("kept_text", "runs"))
    got = repeats.without_repeats(docs, 60)
    assert got.columns == docs.columns
    texts = {r.doc_id: r.text for r in got.where("doc_id IS NOT NULL").collect()}
    assert 200 not in texts and 300 not in texts and texts[303] == "" and 302 in texts
    sizes = {d: n - gone for d, n, gone, _, _ in brute(rows, 60) if d is not None}
    for doc_id, text in texts.items():
        assert 0 <= sizes[doc_id] - len((text or "").encode()) <= 6


def test_empty_table(spark):
    empty = documents(spark, [])
    assert repeats.repeat_report(empty).count() == 0
    assert repeats.without_repeats(empty).columns == empty.columns
