import numpy as np
import pytest

from auditweave.llm import neighbours

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(ids, vectors, every=50, nearest=5):
    x = np.array(vectors, dtype=np.float64)
    sizes = np.sqrt((x * x).sum(axis=1))
    out = {}
    for i in range(len(x)):
        if ids[i] % every == 0:
            scores = (x * x[i]).sum(axis=1) / (sizes * sizes[i])
            order = [j for j in np.lexsort((ids, -scores)) if ids[j] != ids[i]][:nearest]
            out[int(ids[i])] = [(int(ids[j]), float(scores[j])) for j in order]
    return out


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def clusters(n, dim, groups, noise, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dim))
    return (centres[rng.integers(0, groups, n)] + noise * rng.standard_normal((n, dim))).astype(np.float32)


@pytest.mark.parametrize(("groups", "noise"), [(400, 0.1), (1, 1.0)])
def test_recall(spark, groups, noise):
    x = clusters(4000, 24, groups, noise)
    ids = np.arange(4000)
    got = found(neighbours.search(spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x)], SCHEMA)).collect())
    want = brute(ids, x)
    assert set(got) == set(want)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q in want:
        scores = dict(want[q])
        for v, score in got[q]:
            assert v not in scores or score == pytest.approx(scores[v], abs=1e-12)


def test_finer_buckets_where_neighbours_are_near(spark):
    x = clusters(6000, 24, 600, 0.02)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, v array<float>")
    hashing = neighbours.fit(frame, 1_000_000, 24)
    assert hashing.hashes >= 4 and hashing.probes < 100


def test_copies_ties_and_split_buckets(spark):
    x = np.vstack([np.tile(clusters(1, 8, 1, 1.0), (700, 1)), clusters(300, 8, 30, 0.5, seed=1)])
    ids = np.arange(1000)[::-1].copy()
    frame = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x)], SCHEMA)
    got = found(neighbours.search(frame, block_rows=64).collect())
    want = brute(ids, x)
    for q in want:
        if q >= 300:
            assert [v for v, _ in got[q]] == [v for v, _ in want[q]] and len({s for _, s in got[q]}) == 1


def test_unusable_vectors_and_few_candidates(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 1.0], 1), (2, [0.0, 0.0], 1), (50, None, 1), (100, [nan, 1.0], 1), (150, [float("inf"), 1.0], 1),
            (200, [None, 1.0], 1), (None, [1.0, 2.0], 1), (250, [], 1), (3, [0.0, 1.0], 1), (3, [0.0, 1.0], 1), (300, [1.0], 1)]
    got = found(neighbours.search(spark.createDataFrame(rows, SCHEMA)).collect())
    assert list(got) == [0] and [v for v, _ in got[0]] == [1, 3]
    assert neighbours.search(spark.createDataFrame([], SCHEMA)).count() == 0
    assert neighbours.search(spark.createDataFrame([(0, [1.0, 2.0], 1)], SCHEMA)).count() == 0


def test_outlying_queries_get_their_full_number(spark):
    x = clusters(3000, 16, 20, 0.01)
    x[::50] = clusters(60, 16, 1, 1.0, seed=9)
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    got = found(neighbours.search(frame, hashing=neighbours.Hashing(16, 12, 1, 0.05)).collect())
    want = brute(np.arange(3000), x)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    for q in want:
        for v, score in got[q]:
            size = np.linalg.norm(x[q].astype(float)) * np.linalg.norm(x[v].astype(float))
            assert score == pytest.approx(x[q].astype(float) @ x[v].astype(float) / size, abs=1e-9)
