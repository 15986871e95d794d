"""The Jaccard join against all pairs of small tables, with chains, stars, dense clusters and odd rows."""

import random

import numpy as np
import pytest

from auditweave.llm import jaccard
from auditweave.llm.jaccard import jaccard_components
from tests.llm.helpers import documents, prose


def shingles(text, words=4):
    tokens = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    tokens = [t for t in tokens if t]
    if len(tokens) < words:
        return frozenset([tuple(tokens)] if tokens else [])
    return frozenset(tuple(tokens[i : i + words]) for i in range(len(tokens) - words + 1))


def brute(rows, words=4, least=85):
    sets = [shingles(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, one in enumerate(sets):
        for j in range(i):
            both = len(one & sets[j])
            if one and sets[j] and 100 * both >= least * (len(one) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(doc_id)
    smallest = {r: min((d for d in found if d is not None), default=None) for r, found in ids.items()}
    return sorted(((d, len(s), smallest[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def changed(text, places, word):
    tokens = text.split(" ")
    for p in places:
        tokens[p % len(tokens)] = f"{word}{p}"
    return " ".join(tokens)


def cluster(start, count, words, changes, seed):
    """Versions of one text, each with some words changed."""
    rng, text = random.Random(seed), prose(seed, words)
    return [(start + i, changed(text, rng.sample(range(words), rng.randint(0, changes)), f"v{i}x")) for i in range(count)]


def chain(start, count, words, seed):
    """Each text is alike to the next one only."""
    text, out = prose(seed, words), []
    for i in range(count):
        out.append((start + i, text))
        text = changed(text, [7 * i, 7 * i + 3], f"c{i}x")
    return out


def odd():
    return [(900, None), (901, ""), (902, " \t\n"), (903, "two words"), (904, "TWO  words"), (905, "one"), (None, "one"), (None, "only here"),
            (None, None), (906, "É one"), (907, "é one"), (908, prose("long", 9000)), (909, prose("long", 9000) + " tail"),
            (905, "one"), (910, "a a a a a a a a"), (911, "a a a a")]


def star(start, words):
    """Versions that are alike to the middle only: hardly a link between them, all in one component."""
    middle = prose("star", words)
    return [(start + 50, middle)] + [(start + i, changed(middle, [4 * i, (3 * i) % 97], f"s{i}x")) for i in range(25)]


CASES = [
    *cluster(0, 60, 60, 4, "dense"), *cluster(1000, 60, 80, 9, "loose"), *cluster(1100, 20, 30, 2, "other"), *chain(2000, 40, 90, "chain"),
    *odd(), *star(3000, 100), *((4000 + i, f"{prose(i, 20)} {prose('shared', 40)} {prose((i, 2), i)}") for i in range(40)),
]


@pytest.mark.parametrize("block_shingles", [100, jaccard.BLOCK_SHINGLES])
def test_equal_to_all_pairs(spark, block_shingles):
    got = jaccard_components(documents(spark, CASES), block_shingles=block_shingles).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(CASES)


def test_prefixes_of_similar_sets_meet():
    """The prefix filter loses no pair, whatever the counters say."""
    rng = random.Random(3)
    counts = np.array([rng.randrange(9) for _ in range(1 << jaccard.SLOT_BITS)])
    for n in [*range(1, 30), 100, 333]:
        own = np.unique(np.array([rng.getrandbits(64) for _ in range(n)], dtype=np.uint64))
        drop = rng.randint(0, n * 15 // 100)
        other = np.unique(np.concatenate([own[drop:], np.array([rng.getrandbits(64) for _ in range(drop // 2)], dtype=np.uint64)]))
        both = len(np.intersect1d(own, other))
        if 100 * both >= 85 * (len(own) + len(other) - both):
            assert set(jaccard.prefix(own, counts).tolist()) & set(jaccard.prefix(other, counts).tolist())


def test_extra_columns_and_an_empty_table(spark):
    rows = cluster(0, 6, 40, 1, "extra")
    extra = documents(spark, rows, extra=("node", "n", "component_id", "a.b", "mark"))
    got = jaccard_components(extra)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute(rows))
    assert jaccard_components(documents(spark, [])).collect() == []
