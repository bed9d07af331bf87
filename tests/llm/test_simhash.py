"""Fingerprints, bit-sliced comparison and components against plain versions."""

from collections import defaultdict

import numpy as np
import pytest
import xxhash

from leadloom.llm import components, simhash


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(
        str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    if not words:
        return 0
    n = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k:k + n]).encode(), 42) for k in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(items, linked):
    """Least member of each item's class, by exhaustive comparison."""
    root = {i: i for i in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in items:
        for b in items:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in items}


def test_fingerprints():
    for text in ("", " \t", "One", "one TWO", "a b c", "É é  x y", "a b a b a b a b", "z " * 70_000 + "q"):
        assert simhash.fingerprint(text) == plain_fingerprint(text), text[:20]


@pytest.mark.parametrize(("size", "buckets", "flips"), [(200, 30, 6), (300, 2, 3), (130, 1, 1), (1, 1, 1), (64, 1, 2)])
def test_bucket_labels(size, buckets, flips):
    rng = np.random.default_rng(size)
    fp = rng.integers(0, 2**63, 4, dtype=np.uint64)[rng.integers(0, 4, size)]
    for _ in range(flips):
        fp ^= (np.uint64(1) << rng.integers(0, 64, size).astype(np.uint64)) * (rng.random(size) < 0.3)
    bucket = np.sort(rng.integers(0, buckets, size))
    want = classes(range(size), lambda a, b: bucket[a] == bucket[b] and int(fp[a] ^ fp[b]).bit_count() <= 2)
    assert simhash.bucket_labels(fp, bucket).tolist() == [want[k] for k in range(size)]


def near_table(spark, rng, groups=12, members=30):
    """Fingerprints in dense and in chained groups."""
    fps = []
    for g in range(groups):
        base = int(rng.integers(0, 2**63))
        for m in range(members):
            base ^= 0 if g % 2 else (1 << int(rng.integers(0, 64)))
            fps.append(base ^ (1 << int(rng.integers(0, 64))))
    fps = sorted({f - 2**64 if f >> 63 else f for f in fps} | {0, 1, -1})
    return fps, spark.createDataFrame([(f,) for f in fps], "fp long")


@pytest.mark.parametrize("dense", [256, 3])
def test_links_lose_nothing(spark, dense):
    """Also when buckets are divided further."""
    fps, df = near_table(spark, np.random.default_rng(7))
    got = {r.node: r.root for r in components.components(simhash.links(df, dense=dense)).collect()}
    want = classes(fps, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2)
    assert {f: got.get(f, f) for f in fps} == want


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(900, 1000)] + [(5000, 5001), (5001, 5000), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = classes(sorted({n for pair in links for n in pair}), lambda a, b: (a, b) in set(links) or (b, a) in set(links))
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def documents(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10**6, None), (10**6 + 1, ""), (10**6 + 2, " \n"), (None, rows[0][1]), (10**6 + 3, rows[0][1].upper()), rows[3]]
    return rows


def test_near_duplicates(spark, small):
    rows = documents(spark, small)
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, fp int, component_id string")
    out = simhash.near_duplicates(df).collect()
    members = defaultdict(list)
    for i, t in rows:
        members[plain_fingerprint(t)].append(i)
    root = classes(sorted(members), lambda a, b: (a ^ b).bit_count() <= 2)
    least = defaultdict(lambda: 10**9)
    for f, ids in members.items():
        least[root[f]] = min([least[root[f]], *(i for i in ids if i is not None)])
    want = sorted((-1 if i is None else i, plain_fingerprint(t), least[root[plain_fingerprint(t)]]) for i, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in out) == want
    texts = {r.fp: r.h for r in spark.createDataFrame([(1,), (-1,), (0,)], "fp long").withColumn(
        "h", simhash.hex_fingerprint("fp")).collect()}
    assert texts == {1: "0" * 15 + "1", -1: "f" * 16, 0: "0" * 16}


def test_representatives_keep_whole_rows(spark, small):
    rows = documents(spark, small)
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, fp int")
    kept = simhash.representatives(df)
    assert kept.columns == df.columns
    named = {r.component_id for r in simhash.near_duplicates(df).collect()}
    got = kept.collect()
    assert sorted(r.doc_id for r in got) == sorted(named)
    assert all(rows[r.fp] == (r.doc_id, r.text) for r in got)


def test_no_documents(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
