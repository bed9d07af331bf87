import numpy as np
import pytest
from conftest import values
from pyspark.sql import functions as F

from leadloom.operators import similarity
from leadloom.sources.fixtures import frame


def brute(p, c, k):
    a = p / np.linalg.norm(p, axis=1, keepdims=True)
    b = c / np.linalg.norm(c, axis=1, keepdims=True)
    s = a @ b.T
    return {i: sorted(range(len(c)), key=lambda j: (-s[i, j], j))[:k] for i in range(len(p))}


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    p, c = rng.normal(size=(40, 8)), rng.normal(size=(23, 8))

    def df(m, key):
        return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], f"{key} bigint, embedding array<double>")

    return p, c, df(p, "vec_id"), df(c, "client_id")


@pytest.mark.parametrize("options", [{}, {"matrix_max_bytes": 1, "chunk_bytes": 512}, {"matrix_max_bytes": 1}])
def test_exact_forms(vectors, options):
    p, c, dp, dc = vectors
    got = values(similarity.top_similar(dp, dc, 4, **options), "vec_id", "rank", "client_id")
    want = [(i, r + 1, j) for i, js in brute(p, c, 4).items() for r, j in enumerate(js)]
    assert sorted(got) == sorted(want)


def test_fewer_clients_than_k_and_odd_vectors(spark, vectors):
    _, _, _, dc = vectors
    two = dc.filter("client_id < 2")
    odd = spark.createDataFrame([(1, [0.0] * 8), (2, None), (3, [1.0] * 8)], "vec_id bigint, embedding array<double>")
    for options in ({}, {"matrix_max_bytes": 1}):
        got = similarity.top_similar(odd, two, 5, **options)
        assert sorted(values(got, "vec_id", "rank")) == [(3, 1), (3, 2)]
    assert similarity.top_similar(odd, dc.filter("false"), 5).count() == 0
    assert similarity.approx_similar(odd, dc.filter("false"), 5).count() == 0


def test_equal_clients_rank_by_key(spark):
    c = spark.createDataFrame([(5, [1.0, 0.0]), (2, [1.0, 0.0]), (9, [2.0, 0.0])], "client_id bigint, embedding array<double>")
    p = spark.createDataFrame([(1, [3.0, 0.0])], "vec_id bigint, embedding array<double>")
    for options in ({}, {"matrix_max_bytes": 1, "chunk_bytes": 16}):
        got = values(similarity.top_similar(p, c, 2, **options).orderBy("rank"), "client_id", "similarity")
        assert got == [(2, 100.0), (5, 100.0)]


def test_recall_of_the_approximate_form(spark, small):
    p, c = frame(spark, small, "brand_vectors"), frame(spark, small, "embeddings").select(
        F.col("vec_id").alias("client_id"), "embedding")
    exact = similarity.top_similar(p, c, 10).select("vec_id", "client_id")
    near = similarity.approx_similar(p, c, 10, probes=15).select("vec_id", "client_id")
    found = exact.join(near, ["vec_id", "client_id"]).count() / exact.count()
    assert found >= 0.9


def test_approximate_with_all_lists_is_exact(vectors):
    p, c, dp, dc = vectors
    want = [(i, r + 1, j) for i, js in brute(p, c, 4).items() for r, j in enumerate(js)]
    for options in ({}, {"matrix_max_bytes": 1, "chunk_bytes": 512}):
        near = similarity.approx_similar(dp, dc, 4, probes=99, **options)
        assert sorted(values(near, "vec_id", "rank", "client_id")) == sorted(want)


def test_both_approximate_forms_agree(vectors):
    _, _, dp, dc = vectors
    a = similarity.approx_similar(dp, dc, 3, probes=2)
    b = similarity.approx_similar(dp, dc, 3, probes=2, matrix_max_bytes=1, chunk_bytes=300)
    cols = ("vec_id", "rank", "client_id", "similarity")
    assert sorted(values(a, *cols)) == sorted(values(b, *cols))


def test_alternative_measures(spark, vectors):
    p, c, dp, dc = vectors
    tiers = dc.withColumn("tier", F.when(F.col("client_id") % 3 == 0, "high_value").otherwise("low_value"))
    got = similarity.alternative_similarity(dp, tiers, 4).orderBy("vec_id").collect()
    a = p / np.linalg.norm(p, axis=1, keepdims=True)
    b = c / np.linalg.norm(c, axis=1, keepdims=True)
    s, w = a @ b.T, np.where(np.arange(len(c)) % 3 == 0, 2.0, 1.0)
    m = c.mean(axis=0)
    for i, r in enumerate(got):
        assert r["top_mean"] == pytest.approx(np.sort(s[i])[-4:].mean() * 100)
        assert r["centroid_similarity"] == pytest.approx(a[i] @ m / np.linalg.norm(m) * 100)
        assert r["weighted_similarity"] == pytest.approx((s[i] * w).sum() / w.sum() * 100)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_approximate_form_of_few_clients(vectors, n):
    p, c, dp, dc = vectors
    got = values(similarity.approx_similar(dp, dc.filter(F.col("client_id") < n), 4, probes=9), "vec_id", "rank", "client_id")
    assert sorted(got) == sorted((i, r + 1, j) for i, js in brute(p, c[:n], 4).items() for r, j in enumerate(js))


@pytest.mark.parametrize("form", [similarity.top_similar, lambda *a, **o: similarity.approx_similar(*a, probes=999, **o)])
def test_small_chunks_do_not_multiply_copies(spark, monkeypatch, form):
    """Chunks and blocks of one row are asked for; a prospect still travels once per block, a client once per chunk."""
    rng = np.random.default_rng(3)
    p, c = rng.normal(size=(300, 8)), rng.normal(size=(200, 8))
    dp, dc = (
        spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], f"{key} bigint, embedding array<double>")
        for m, key in ((p, "vec_id"), (c, "client_id"))
    )
    seen = []
    by_blocks = similarity._by_blocks

    def counted(copies, dealt, chunks, *rest):
        seen.append((copies.count(), dealt.count(), chunks))
        return by_blocks(copies, dealt, chunks, *rest)

    monkeypatch.setattr(similarity, "_by_blocks", counted)
    got = values(form(dp, dc, 4, matrix_max_bytes=1, chunk_bytes=64), "vec_id", "rank", "client_id")
    assert sorted(got) == sorted((i, r + 1, j) for i, js in brute(p, c, 4).items() for r, j in enumerate(js))
    assert seen == [(300 * similarity.BLOCKS, 200, similarity.CHUNKS)]


def test_pieces_stay_bounded():
    assert similarity._pieces(100, 1 << 20, 4) == 1
    assert similarity._pieces(1 << 30, 1 << 10, 4) == 16  # none above CHUNK_BYTES
    assert similarity._pieces(1 << 20, 1 << 10, 4) == 4


@pytest.mark.parametrize("copies", [1, 7])
def test_top_k_of_many_columns(copies):
    rng = np.random.default_rng(copies)
    product = np.tile(rng.integers(0, 500, (20, 1_100)) / 500, copies)
    rows, cols, rank = similarity._top_k(product, 5)
    want = [(i, j, r + 1) for i in range(20) for r, j in enumerate(sorted(range(product.shape[1]), key=lambda j: (-product[i, j], j))[:5])]
    assert list(zip(rows.tolist(), cols.tolist(), rank.tolist())) == want
@pytest.mark.parametrize("probes", [1, 5, 40])
def test_winners_held_do_not_grow_with_the_lists(monkeypatch, probes):
    """Small whole numbers give ties between lists; the least member wins them."""
    rng = np.random.default_rng(probes)
    x, _ = similarity._unit_rows(rng.integers(1, 4, (50, 2)).astype(float))
    unit, _ = similarity._unit_rows(rng.integers(1, 4, (300, 2)).astype(float))
    lists = rng.integers(0, 40, 300)
    members = np.argsort(lists, kind="stable")
    starts = np.searchsorted(lists[members], np.arange(41))
    wanted = np.argsort(rng.random((50, 40)), axis=1) < probes
    monkeypatch.setattr(similarity, "HELD", 400)
    most, merge = [], similarity._best_of
    monkeypatch.setattr(similarity, "_best_of", lambda rows, *rest: most.append(len(rows)) or merge(rows, *rest))
    monkeypatch.setattr(similarity, "_top_k", lambda product, k, top=similarity._top_k: top(np.round(product, 12), k))
    got = {i: [] for i in range(50)}
    for rows, which, _, _ in similarity._rank_lists(x, wanted, members, starts, unit, 6):
        for r, w in zip(rows.tolist(), which.tolist()):
            got[r].append(w)
    for i in range(50):
        own = np.flatnonzero(wanted[i][lists])
        s = x[i] @ unit[own].T
        best = sorted(np.round(s, 9).tolist())[::-1][:6]
        assert np.round(x[i] @ unit[got[i]].T, 9).tolist() == best and set(got[i]) <= set(own.tolist())
    assert max(most) <= 400 + 2 * 50 * 6


@pytest.mark.parametrize("form", [similarity.top_similar, lambda *a: similarity.approx_similar(*a, probes=999)])
def test_prospects_in_one_partition_are_dealt_to_all_cores(spark, vectors, form):
    _, c, _, dc = vectors
    p = np.random.default_rng(4).normal(size=(3_000, 8))
    one = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(p)], "vec_id bigint, embedding array<double>").coalesce(1)
    found = form(one, dc, 2)
    assert found.rdd.getNumPartitions() > 1
    want = [(i, r + 1, j) for i, js in brute(p, c, 2).items() for r, j in enumerate(js)]
    assert sorted(values(found, "vec_id", "rank", "client_id")) == sorted(want)


@pytest.mark.parametrize("copies", [1, 40, 20_000])
def test_few_products_are_made_in_double(monkeypatch, copies):
    """Large groups of equal clients, and k of them: the least numbers win, whatever tiles they lie in."""
    rng = np.random.default_rng(copies)
    some, _ = similarity._unit_rows(rng.normal(size=(20_000 // copies, 16)))
    c = np.tile(some, (copies, 1))
    x, _ = similarity._unit_rows(np.concatenate([some[:1], rng.normal(size=(600, 16))]))
    cells, top = [], similarity._top_k
    monkeypatch.setattr(similarity, "_top_k", lambda product, k: cells.append(product.size) or top(np.round(product, 12), k))
    rows, ids, cos, rank = map(np.concatenate, zip(*similarity._rank_block(x, np.arange(len(c)), c, 10)))
    s = np.round(x @ c.T, 12)
    want = [(i, j, r + 1) for i in range(len(x)) for r, j in enumerate(np.lexsort((np.arange(len(c)), -s[i]))[:10].tolist())]
    assert list(zip(rows.tolist(), ids.tolist(), rank.tolist())) == want
    assert np.abs(cos - s[rows, ids]).max() < 1e-11
    if copies == 1:
        assert sum(cells) < 0.4 * s.size


@pytest.mark.parametrize("form", [similarity.top_similar, lambda *a, **o: similarity.approx_similar(*a, probes=999, lists=60, **o)])
def test_rows_that_travel_do_not_grow_with_the_lists(vectors, monkeypatch, form):
    """A prospect that wants all of many lists carries a bit for each."""
    p, c, dp, dc = vectors
    seen = []
    by_blocks = similarity._by_blocks

    def counted(copies, *rest):
        seen.append(copies.agg(F.max(F.octet_length("lists"))).first()[0])
        return by_blocks(copies, *rest)

    monkeypatch.setattr(similarity, "_by_blocks", counted)
    got = values(form(dp, dc, 4, matrix_max_bytes=1, chunk_bytes=512), "vec_id", "rank", "client_id")
    assert sorted(got) == sorted((i, r + 1, j) for i, js in brute(p, c, 4).items() for r, j in enumerate(js))
    assert len(seen) == 1 and 0 < seen[0] <= 8
