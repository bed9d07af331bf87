"""Neighbour graphs: structure, recall against brute force, products, waves and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.operators import neighbour_graph as ng


def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def clustered(rng, n, groups, dim):
    centres = rng.normal(size=(groups, dim))
    return unit(centres[rng.integers(groups, size=n)] + 0.2 * rng.normal(size=(n, dim)))


def frame_of(spark, m, key):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], f"{key} bigint, embedding array<double>")


@pytest.mark.parametrize("groups", [1, 25])
def test_structure_and_recall(groups):
    rng = np.random.default_rng(groups)
    c = clustered(rng, 3_000, groups, 24)
    c[100:140] = c[:40]  # equal clients
    links = ng.layers(c, ng.LINKS, 3)
    assert len(links) == len(c) and max(map(len, links)) >= 2
    assert (ng._parts([own[0] for own in links]) == 0).all()  # one part, so every client can be reached
    for layer in range(max(map(len, links))):
        nodes = {i for i, own in enumerate(links) if len(own) > layer}
        assert all(j in nodes and j != i for i in nodes for j in links[i][layer])
    x = unit(np.concatenate([c[:200] + 0.05 * rng.normal(size=(200, 24)), rng.normal(size=(100, 24))]))
    rows, node, cos, products = ng.search(ng.make_graph(np.arange(len(c)), c, links), x, 10, ng.BEAM)
    best = np.sort(x @ c.T, axis=1)[:, -10:]
    hits = [int((cos[rows == i] >= best[i, 0] - 1e-12).sum()) for i in range(len(x))]
    assert sum(hits) >= 0.95 * 10 * len(x)
    assert products < 0.5 * len(x) * len(c)


def test_shards_and_waves_agree(spark):
    rng = np.random.default_rng(5)
    c, p = clustered(rng, 1_200, 10, 12), unit(rng.normal(size=(60, 12)))
    graphs = ng.store_graph(frame_of(spark, c, "client_id"), shard_rows=300)
    assert graphs.select("shard").distinct().count() >= 3
    found = []
    for wave_bytes in (1 << 30, 1):
        got = ng.similar_by_graph(frame_of(spark, p, "vec_id"), graphs, 5, wave_bytes=wave_bytes)
        found.append(sorted((r.vec_id, r["rank"], r.client_id) for r in got.collect()))
    assert found[0] == found[1]
    want = np.argsort(-(unit(p) @ unit(c).T), axis=1)[:, :5]
    hits = sum(j in want[i] for i, _, j in found[0])
    assert len(found[0]) == 300 and hits >= 0.95 * 300


def test_odd_rows(spark):
    c = spark.createDataFrame([("b", [1.0, 0.0]), ("z", [0.0, 0.0]), ("n", None), ("d", [0.0, 1.0])], "client_id string, embedding array<double>")
    p = spark.createDataFrame([(1, [3.0, 0.0]), (1, [0.0, 2.0]), (2, [0.0, 0.0]), (3, None)], "vec_id bigint, embedding array<float>")
    got = ng.similar_by_graph(p, ng.store_graph(c), 3).collect()
    assert sorted((r.vec_id, r["rank"], r.client_id, r.similarity) for r in got) == [
        (1, 1, "b", 100.0), (1, 1, "d", 100.0), (1, 2, "b", 0.0), (1, 2, "d", 0.0)
    ]
    one = ng.similar_by_graph(p, ng.store_graph(c.filter("client_id = 'b'")), 3)
    assert one.count() == 2
    assert ng.similar_by_graph(p, ng.store_graph(c.limit(0)), 3).count() == 0


def test_prospects_are_neither_shuffled_nor_copied(spark):
    rng = np.random.default_rng(6)
    graphs = ng.store_graph(frame_of(spark, rng.normal(size=(300, 8)), "client_id"), shard_rows=100)
    found = ng.similar_by_graph(frame_of(spark, rng.normal(size=(20, 8)), "vec_id"), graphs, 3, wave_bytes=1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan and plan.count("Generate") == 1


def test_shards_of_a_wave_are_one_graph(spark):
    """Products do not grow with the number of shards; prospects are no clients here, nor near any."""
    rng = np.random.default_rng(8)
    c, p = unit(rng.normal(size=(4_000, 12))), unit(rng.normal(size=(100, 12)))
    graphs = ng.store_graph(frame_of(spark, c, "client_id"), shard_rows=200).cache()
    assert graphs.select("shard").distinct().count() >= 15
    products = spark.sparkContext.accumulator(0)
    got = ng.similar_by_graph(frame_of(spark, p, "vec_id"), graphs, 10, products=products).collect()
    want = np.argsort(-(p @ c.T), axis=1)[:, :10]
    assert len(got) == 1_000 and sum(r.client_id in want[r.vec_id] for r in got) >= 950
    assert products.value < 0.5 * len(p) * len(c)


def test_prospects_in_one_partition_are_dealt_to_all_cores(spark):
    rng = np.random.default_rng(9)
    graphs = ng.store_graph(frame_of(spark, rng.normal(size=(50, 4)), "client_id"))
    one = frame_of(spark, rng.normal(size=(3_000, 4)), "vec_id").coalesce(1)
    found = ng.similar_by_graph(one, graphs, 1)
    assert found.rdd.getNumPartitions() > 1 and found.count() == 3_000


def test_vectors_in_single_precision_are_held_once(spark):
    """Vectors of any length, given in single precision: cosines are those of double, and half a million nodes are one wave."""
    rng = np.random.default_rng(10)
    c = (rng.normal(size=(2_000, 64)) * rng.uniform(0.1, 50, (2_000, 1))).astype(np.float32)
    u = unit(c.astype(np.float64))
    clients = frame_of(spark, c, "client_id").select("client_id", F.col("embedding").cast("array<float>"))
    graphs = ng.store_graph(clients, shard_rows=500)
    assert len(ng._waves(graphs, 600 * len(c))) == 1 and 600 * 600_000 < ng.WAVE_BYTES
    graph = ng._wave(graphs.orderBy("shard", "node"), "client_id")
    assert graph.near is graph.x and graph.x.dtype == np.float32
    assert sum(a.nbytes for a in (graph.ids, graph.x, graph.norm, graph.scale, *graph.links)) < 600 * len(c)
    met = np.zeros(100 * len(c), np.int16)
    for _ in range(2):  # what was noted in a search is gone in the next one
        rows, node, cos, _ = ng.search(graph, u[:100], 10, ng.BEAM, met)
        assert not met.any()
        best = np.sort(u[:100] @ u.T, axis=1)[:, :-11:-1]
        found = u[rows] * u[graph.ids[node]]
        assert np.abs(found.sum(axis=1) - cos).max() < 1e-14
        assert sum((cos[rows == i] >= best[i, -1] - 1e-12).sum() for i in range(100)) >= 950
