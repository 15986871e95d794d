import random

import numpy as np
import xxhash

from auditweave.llm import components, simhash
from tests.llm.helpers import documents, prose


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows):
    prints = [brute_print(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [r[0] for j, r in enumerate(rows) if find(j) == find(i) and r[0] is not None]
        out.append((doc_id, f"{prints[i]:016x}", min(ids, default=None)))
    return sorted(out, key=str)


def sample():
    rng = random.Random(1)
    rows = []
    for g in range(25):
        base = prose(g, 300).split(" ")
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = prose(rng.random(), 1)
            rows.append((len(rows) * 3, " ".join(copy)))
    rows += [(1, ""), (2, None), (4, " \n\t"), (5, "One two"), (7, "one TWO"), (None, "ONE two"), (None, "lonely"), (5, "One two")]
    rows.append((8, prose("long", 60_000)))
    rng.shuffle(rows)
    return rows


def test_components_equal_brute_force(spark):
    rows = sample()
    got = simhash.simhash_components(documents(spark, rows, ("fingerprint", "group", "row")))
    assert sorted(map(tuple, got.collect()), key=str) == brute_groups(rows)


def test_divided_groups_lose_no_link(spark):
    rows = sample()
    ids = simhash.fingerprinted(documents(spark, rows).select("doc_id", "text"), "text")
    whole = simhash.near_groups(ids).orderBy("fingerprint").collect()
    assert simhash.near_groups(ids, group_rows=1).orderBy("fingerprint").collect() == whole


def test_index_finds_all_close_pairs():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    codes = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(12)]))
    got = {(min(a, b), max(a, b)) for left, right in simhash.close_pairs(codes, most=64) for a, b in zip(codes[left], codes[right])}
    assert got == {(a, b) for i, a in enumerate(codes) for b in codes[i + 1 :] if int(a ^ b).bit_count() <= 2}
    assert list(simhash.close_pairs(codes[:0])) == []


def test_gray_rank():
    n = np.arange(5000, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def test_one_of_each_group_stays(spark):
    rows = sample()
    kept = simhash.without_near_duplicates(documents(spark, rows, ("place", "of_id")))
    assert kept.columns[-2:] == ["place", "of_id"]
    groups = {}
    for doc_id, _, component in brute_groups(rows):
        groups.setdefault(component, set()).add(doc_id)
    assert sorted((r[0] for r in kept.collect()), key=str) == sorted((c for c in groups), key=str)


def test_empty_table(spark):
    empty = documents(spark, [])
    assert simhash.simhash_components(empty).count() == 0
    assert simhash.without_near_duplicates(empty).columns == empty.columns


def test_chain_and_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = dict(components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
