"""Exact top-k against exhaustive search."""

import numpy as np
import pytest

from leadloom.llm import mtree


def brute(rows, every, top):
    vectors = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            w = tuple(float(x) for x in v)
            vectors[i] = min(vectors.get(i, w), w)
    size = max([1, *map(len, vectors.values())])
    whole = {i: [int(np.floor(1024 * x)) for x in v] + [0] * (size - len(v)) for i, v in vectors.items()}
    out = []
    for q in whole:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(whole[q], whole[i])), i) for i in whole if i != q)
            out += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:top])]
    return sorted(out)


@pytest.mark.parametrize(("n", "dim", "copies"), [(700, 16, 0), (900, 2, 300), (400, 3, 399), (3, 4, 0), (1, 4, 0)])
def test_tree(n, dim, copies):
    rng = np.random.default_rng(n)
    vectors = np.floor(1024 * rng.normal(size=(n, dim)) * rng.choice([0.1, 1, 3], (n, 1)))
    vectors[:copies] = vectors[0]
    tree = mtree.MTree(np.arange(n), vectors)
    for q in range(0, n, max(1, n // 25)):
        scores = sorted((-int(s), i) for i, s in enumerate(vectors @ vectors[q]) if i != q)[:10]
        assert tree.search(q, vectors[q], 10) == [(-s, i) for s, i in scores]


def test_bounds_spare_computations():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 8)) * 5
    vectors = np.floor(1024 * (centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 8)) * 0.05))
    vectors *= (5000 / np.linalg.norm(vectors, axis=1))[:, None]
    vectors = np.floor(vectors)
    tree = mtree.MTree(np.arange(4000), vectors)
    tree.search(0, vectors[0], 10)
    assert tree.computed < 1500


def test_frames(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(300, None), (400, [1.0, None, 2.0]), (500, [float("nan")] * 6), (600, [float("inf")] * 6), (None, [1.0] * 6)]
    rows += [(700, []), (7, [9.0] * 6), (100, list(rows[100][1])), (800, [0.25, 0.5]), (900, [1e15] * 3)] + [(1000 + k, rows[3][1]) for k in range(50)]
    df = spark.createDataFrame([(i, v, i, "s") for i, v in rows], "vec_id long, embedding array<double>, rank long, score string")
    for block_rows, chunk in (((1024, 65536), 4096), ((40, 60), 3)):
        got = mtree.top_products(df, block_rows=block_rows, chunk_queries=chunk).collect()
        clip = lambda s: max(-2**63, min(2**63 - 1, s))
        want = [(q, k, i, clip(s)) for q, k, i, s in brute(rows, 100, 10)]
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want


def test_few_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, -1.0]), (1, [0.5, 0.5]), (200, [-0.0004, 0.0])], schema)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in mtree.top_products(few).collect())
    assert got == brute([(0, [1.0, -1.0]), (1, [0.5, 0.5]), (200, [np.float32(-0.0004), 0.0])], 100, 10)
    assert mtree.top_products(spark.createDataFrame([], schema)).count() == 0
    assert mtree.top_products(few.filter("vec_id = 0")).count() == 0
