"""The prefix trie against one made of dictionaries, with hot turns, long and turnless conversations."""

import hashlib
import random
import zlib

import pytest

from auditweave.llm.trie import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(own)] for c, own in turns.items()}
    members, ends = {}, {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        lead = turns.get(c - c % 20, []) if c >= 0 else turns.get(c + -c % 20, [])
        whole = lead[:h] + own[h:]
        for d in range(len(whole) + 1):
            members.setdefault(tuple(whole[:d]), []).append(c)
        ends.setdefault(tuple(whole), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[b] for b in below) or 1
        words = len(node[-1][1].encode().split()) if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[b] for b in below)
    return sorted(
        (min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children.get(node, [])), leaves[node], saved[node],
         hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest())
        for node, own in members.items())


def conversations():
    rng = random.Random(11)
    rows = []
    for conv in range(140):
        for turn in range(rng.randint(1, 6)):
            # Few different turns, so that many conversations agree for long.
            rows.append((conv, turn, "user" if turn % 2 == 0 else "assistant", "hello there" if rng.random() < 0.8 else f"word {rng.randint(0, 2)} more"))
    rows += [(conv, turn, "user", f"line {turn}") for conv in (300, 301, 320) for turn in range(90)]
    rows += [(500 + i, 0, None, None) for i in range(5)] + [(541, None, "user", "null turn"), (541, None, None, "another"), (541, 2, "user", None)]
    rows += [(None, 1, "user", "no conversation"), (-5, 0, "user", "minus"), (-25, 0, "user", "minus"), (-20, 1, "user", "minus"), (7, 0, "user", "hello there"), (7, 0, "user", "hello there")]
    rows += [(560 + i, 0, "user", "") for i in range(3)] + [(580, 0, "a", "bc"), (600, 0, "ab", "c")]
    return rows


@pytest.mark.parametrize("options", [{}, {"shard_convs": 2, "fanout": 2, "block_turns": 4}])
def test_equal_to_dictionaries(spark, options):
    rows = conversations()
    got = prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(5), **options).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(brute(rows), key=str)


def test_a_hot_conversation_lies_in_many_parts(spark):
    rows = [(0, t, "user", f"turn {t}") for t in range(3000)] + [(i, t, "user", f"turn {t}") for i in range(1, 40) for t in range(3)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(8)
    got = prefix_trie(frame, shard_convs=4, fanout=3).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(brute(rows), key=str)


def test_extra_columns_and_an_empty_table(spark):
    extra = spark.createDataFrame([(1, 0, "user", "x y", "z", 3)], SCHEMA + ", node string, `a.b` int")
    assert [tuple(r)[:7] for r in prefix_trie(extra).collect()] == [tuple(r)[:7] for r in brute([(1, 0, "user", "x y")])]
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
