"""Hard negatives against all pairs, with hot vectors, odd rows, small cells and early certificates."""

import math
import random

import numpy as np
import pytest

from auditweave.llm.negatives import hard_negatives, inner_products

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def brute(rows, positives=5, negatives=3):
    known = {}
    for vec_id, v, label in rows:
        if vec_id is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = ((label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * x) for x in v])
        if sum(x * x for x in row[1]) <= 1 << 62:
            known[vec_id] = min(known.get(vec_id, row), row)
    sizes = [len(v) for _, v in known.values()]
    dim = max(sorted(set(sizes)), key=sizes.count, default=0)
    known = {i: r for i, r in known.items() if len(r[1]) == dim}
    out = []
    for anchor in sorted(i for i in known if i % 50 == 0):
        label, own = known[anchor]
        scores = sorted(((-sum(x * y for x, y in zip(own, v)), i, other) for i, (other, v) in known.items() if i != anchor))
        for score, positive, _ in [s for s in scores if s[2] == label][:positives]:
            fit = [s for s in scores if s[2] != label and 50 * -score <= 100 * -s[0] <= 95 * -score]
            out += [(anchor, positive, rank, n, -score, -s) for rank, (s, n, _) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def clustered(seed, count, dim, centers, spread):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((centers, dim))
    return [(i, (middle[i % centers] + spread * rng.standard_normal(dim)).tolist(), int(rng.integers(0, 4))) for i in range(count)]


def odd(dim):
    rng = random.Random(2)
    some = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(4)]
    rows = [(1000 + i, some[0], i % 3) for i in range(120)] + [(1150, some[0], 1), (1200, [0.0] * dim, 2), (1201, [0.0] * dim, 2), (1202, [0.0] * dim, 3)]
    rows += [(1250, None, 1), (1300, some[1], None), (1350, [None, *some[1][1:]], 1), (1351, [math.nan, *some[1][1:]], 1), (1352, [math.inf, *some[1][1:]], 1),
             (None, some[1], 1), (1353, [], 1), (1354, some[1][:2], 1), (1400, some[2], 1), (1400, some[2], 1), (1400, some[3], 0), (1450, [1e300, *some[1][1:]], 1),
             (1451, [1e6, *some[2][1:]], 2), (1500, [2e6, *some[2][1:]], 2), (-50, some[3], 2)]
    return rows


@pytest.mark.parametrize("options", [{}, {"clusters": 3, "first_step": 40, "block_rows": 30}])
def test_equal_to_all_pairs(spark, options):
    rows = clustered(1, 600, 6, 5, 0.2) + odd(6)
    got = hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(4), **options).collect()
    assert sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got) == brute(rows)


def test_certified_anchors_stop_early(spark, monkeypatch):
    """In clustered vectors every anchor is certified before the end of its list."""
    from auditweave.llm import negatives

    steps = []
    cells = negatives.Walk.cells
    monkeypatch.setattr(negatives.Walk, "cells", lambda self, step, walking: steps.append((step, len(self.steps()))) or cells(self, step, walking))
    rng = np.random.default_rng(3)
    middle = 4 * np.eye(8)
    rows = [(i, (middle[i % 8] + 0.3 * rng.standard_normal(8)).tolist(), i // 8 % 3) for i in range(800)]
    got = hard_negatives(spark.createDataFrame(rows, SCHEMA), clusters=8, first_step=120).collect()
    assert sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got) == brute(rows)
    assert max(step for step, _ in steps) + 1 < steps[0][1]


def test_inner_products_are_exact_beyond_doubles():
    left, right = np.array([[2.0**30, 3.0]]), np.array([[2.0**30 + 1, 5.0]])
    assert inner_products(left, right).tolist() == [[2**60 + 2**30 + 15]]


def test_extra_columns_and_empty_tables(spark):
    rows = clustered(4, 120, 3, 2, 0.5)
    extra = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", v string, `a.b` int")
    got = hard_negatives(extra)
    assert sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got.collect()) == brute(rows)
    for none in ([], [(1, [1.0], 1)], [(50, None, 1)], [(50, [1.0], 1)]):
        assert hard_negatives(spark.createDataFrame(none, SCHEMA)).collect() == []
