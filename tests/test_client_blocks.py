"""Exact top-k through blocks with bounds: against brute force, with waves, clusters, ties and odd rows."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leadloom.operators import client_blocks as cb


def brute(p, c, k):
    a = p / np.linalg.norm(p, axis=1, keepdims=True)
    b = c / np.linalg.norm(c, axis=1, keepdims=True)
    s = np.round(a @ b.T, cb.DECIMALS)
    return [(i, r + 1, j) for i in range(len(p)) for r, j in enumerate(sorted(range(len(c)), key=lambda j: (-s[i, j], j))[:k])]


def frame_of(spark, m, key):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], f"{key} bigint, embedding array<double>")


def clustered(rng, n, groups, dim=16, spread=0.03):
    centres = rng.normal(size=(groups, dim))
    return centres[rng.integers(groups, size=n)] + spread * rng.normal(size=(n, dim))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 8), st.integers(1, 60), st.integers(1, 6))
def test_search_in_waves(seed, blocks, n, k):
    rng = np.random.default_rng(seed)
    x, c = rng.integers(-2, 3, (7, 3)).astype(float), rng.integers(-2, 3, (n, 3)).astype(float)
    x, c = x[np.abs(x).sum(1) > 0], c[np.abs(c).sum(1) > 0]  # small whole numbers: many ties
    if not len(x) or not len(c):
        return
    (ux, _), (uc, _) = cb._unit_rows(x), cb._unit_rows(c)
    block = rng.integers(blocks, size=len(c))
    rows, ids, cos = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    for part in (block < blocks // 2, block >= blocks // 2):
        if part.any():
            rows, ids, cos, _ = cb.search(cb.make_wave(block[part], np.flatnonzero(part), uc[part]), ux, k, rows, ids, cos)
    place = np.arange(len(rows)) - np.searchsorted(rows, rows) + 1
    assert list(zip(rows.tolist(), place.tolist(), ids.tolist())) == brute(x, c, k)


@pytest.mark.parametrize("wave_bytes", [1, 4_000, 1 << 30])
def test_equal_to_brute_force(spark, wave_bytes):
    rng = np.random.default_rng(2)
    p, c = rng.normal(size=(50, 8)), rng.normal(size=(90, 8))
    c[40:60] = c[:20]  # ties between blocks
    blocks = cb.store_blocks(frame_of(spark, c, "client_id"), lists=7, block_rows=9)
    got = cb.top_similar_bounded(frame_of(spark, p, "vec_id"), blocks, 6, wave_bytes=wave_bytes)
    assert sorted((r.vec_id, r["rank"], r.client_id) for r in got.collect()) == sorted(brute(p, c, 6))


def test_fewer_products_than_brute_force(spark):
    """On clustered clients most blocks are never multiplied; the hot cluster holds a third of the prospects."""
    rng = np.random.default_rng(3)
    c = clustered(rng, 4_000, 40)
    p = np.concatenate([c[rng.integers(len(c), size=400)], np.repeat(c[:1], 200, axis=0) + 0.01 * rng.normal(size=(200, 16))])
    blocks = cb.store_blocks(frame_of(spark, c, "client_id"), lists=80)
    for wave_bytes in (1 << 30, 100_000):
        products = spark.sparkContext.accumulator(0)
        got = cb.top_similar_bounded(frame_of(spark, p, "vec_id").repartition(3), blocks, 5, wave_bytes=wave_bytes, products=products).collect()
        assert sorted((r.vec_id, r["rank"], r.client_id) for r in got) == sorted(brute(p, c, 5))
        assert products.value < 0.25 * len(p) * len(c)


def test_odd_rows(spark):
    c = spark.createDataFrame(
        [("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("z", [0.0, 0.0]), ("n", None), ("d", [0.0, 1.0])], "client_id string, embedding array<double>"
    )
    p = spark.createDataFrame([(1, [3.0, 0.0]), (1, [0.0, 2.0]), (2, [0.0, 0.0]), (3, None), (None, [1.0, 1.0])], "vec_id bigint, embedding array<float>")
    blocks = cb.store_blocks(c)
    got = cb.top_similar_bounded(p, blocks, 2, wave_bytes=16)
    assert sorted(((r.vec_id, r["rank"], r.client_id, r.similarity) for r in got.collect()), key=str) == sorted(
        [(1, 1, "a", 100.0), (1, 2, "b", 100.0), (1, 1, "d", 100.0), (1, 2, "a", 0.0), (None, 1, "a", 70.71), (None, 2, "b", 70.71)], key=str
    )
    assert cb.top_similar_bounded(p.limit(0), blocks, 2).count() == 0
    none = cb.store_blocks(c.filter("client_id = 'z'"))
    assert cb.top_similar_bounded(p, none, 2).count() == 0


def test_prospects_are_neither_shuffled_nor_copied(spark):
    rng = np.random.default_rng(4)
    blocks = cb.store_blocks(frame_of(spark, rng.normal(size=(200, 8)), "client_id"), lists=5)
    found = cb.top_similar_bounded(frame_of(spark, rng.normal(size=(20, 8)), "vec_id"), blocks, 3, wave_bytes=3_000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1  # steps of earlier waves are checkpointed, or each would keep a Python worker
    assert "Exchange" not in plan and "Join" not in plan and plan.count("Generate") == 1  # the winners, at the end


def test_waves_stay_few(spark):
    """Every wave reads and writes all prospects, so a small bound does not make one per block."""
    rng = np.random.default_rng(6)
    blocks = cb.store_blocks(frame_of(spark, rng.normal(size=(400, 8)), "client_id"), lists=40, block_rows=5)
    numbers = cb._waves(blocks, "client_id", 1)
    assert len(numbers) <= 2 * cb.WAVES
    held = [b for wave in numbers for b in wave]
    assert held == sorted(held) and len(set(held)) == len(held) == blocks.select("block").distinct().count() > 40
