"""Importance resampling: hashes, weights, quickselect and ranks against plain versions."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leadloom.llm import importance, quickselect, word_buckets

ODD = [
    None, "", "   ", "a", "A b", "Á é-é 日本 x1", "a\u0000b", "x" * 500 + " y " + "z" * 70, "one two " * 30_000, "Up UP up " * 10, "- - -",
    "😀 smile😀y ok", "tab\tnew\nline", "a b c d e f g h i j k l m n o p q r s t", "ß İ K " * 9,
]


def plain_features(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def plain_buckets(texts):
    counts = np.zeros(importance.BUCKETS, np.int64)
    for t in texts:
        for f in plain_features(t)[1]:
            counts[zlib.crc32(f.encode()) % importance.BUCKETS] += 1
    return counts


def plain_scores(rows, target):
    s, t = plain_buckets(r[1] for r in rows), plain_buckets(target)
    out = []
    for doc_id, text in rows:
        words, features = plain_features(text)
        gains = [
            math.floor(1000 * math.log((t[b] + 1.0) * (s.sum() + 10000.0) / ((s[b] + 1.0) * (t.sum() + 10000.0))))
            for b in (zlib.crc32(f.encode()) % importance.BUCKETS for f in features)
        ]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(words), len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("aB1 é日-\x00\n", max_size=30) | st.sampled_from([t for t in ODD if t]), max_size=5))
def test_buckets_of_texts(texts):
    words, owner, bucket = word_buckets.text_buckets(texts, 10_000)
    for k, t in enumerate(texts):
        own_words, features = plain_features(t)
        assert words[k] == len(own_words)
        assert sorted(bucket[owner == k]) == sorted(zlib.crc32(f.encode()) % 10_000 for f in features)


def test_crc_goes_on():
    data = np.frombuffer(bytes(range(256)) * 2, np.uint8)
    starts, lengths = np.array([0, 3, 100, 5, 7]), np.array([10, 0, 300, 64, 65])
    raw, before = data.tobytes(), np.array([0, 9, 2**32 - 1, 77, 5], np.uint32)
    assert word_buckets.crc32(data, starts, lengths).tolist() == [zlib.crc32(raw[a:a + n]) for a, n in zip(starts, lengths)]
    assert word_buckets.crc32(data, starts, lengths, before).tolist() == [
        zlib.crc32(raw[a:a + n], int(b)) for a, n, b in zip(starts, lengths, before)
    ]


def last_null(row):
    return tuple((v is None, 0 if v is None else v) for v in row)


@pytest.mark.parametrize("n", [1, 16, 17, 1000])
def test_kth(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b", "c d"]), rng.randint(0, 40)) for _ in range(n)]
    df = spark.createDataFrame(rows, "a long, b string, c int").repartition(7)
    want = sorted(rows, key=last_null)
    for k in {1, n // 3 + 1, n // 2 + 1, n}:
        got, less = quickselect.kth(df, ["a", "b", "c"], k)
        assert tuple(got) == want[k - 1]
        assert less == sum(last_null(r) < last_null(got) for r in rows)
    with pytest.raises(ValueError):
        quickselect.kth(df, ["a", "b", "c"], n + 1)


def test_rounds_are_few(spark, monkeypatch):
    """A round leaves about a 16th of the rows."""
    df, rounds = spark.range(0, 300_000, 1, 4).selectExpr("xxhash64(id) as x"), []
    jobs = quickselect.F.count_if
    monkeypatch.setattr(quickselect.F, "count_if", lambda c: (rounds.append(1), jobs(c))[1])
    got, less = quickselect.kth(df, ["x"], 75_000)
    assert less == 74_999 and df.filter(df.x < got.x).count() == 74_999
    assert len(rounds) / (2 * quickselect.PIVOTS) <= 12


def test_numbered(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(400)]), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(9)
    got = [tuple(r) for r in quickselect.numbered(df, ["a", "b"], "place").collect()]
    want = [(*r, k + 1) for k, r in enumerate(sorted(rows, key=last_null))]
    assert sorted(got, key=lambda r: r[2]) == want
    assert quickselect.numbered(df.limit(0), ["a", "b"], "place").count() == 0


def test_resample(spark):
    rng = random.Random(3)
    vocabulary = ["alpha", "beta", "gamma", "delta", "Ünï", "x1", "the", "of"]
    texts = [*ODD, *(" ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) for _ in range(150))]
    rows = [(k if k % 11 else None, t) for k, t in enumerate(texts)]
    rows += rows[20:60] + [(500, rows[30][1])] * 30
    target = [None, "", "alpha beta gamma the of", "x1 x1 Ünï"]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, _words string")
    made = importance.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), keep=["_words", "doc_id"])
    got = made.collect()
    assert made.columns == ["_words", "doc_id", "n_features", "weight", "score", "rank"]
    want = plain_scores(rows, target)
    assert sorted(map(str, ((r.doc_id, r.n_features, r.weight, r.score) for r in got))) == sorted(map(str, ((w[0], *w[2:]) for w in want)))
    fit = sorted(((-w[4], w[0] is None, w[0] or 0, w[2]) for w in want if w[1] >= 20))
    drawn = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, 25 * len(fit) // 100 + 1))
    assert [(-r.score, r.doc_id is None, r.doc_id or 0, r.n_features) for r in drawn] == fit[:len(drawn)]


def test_small_inputs(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    assert [(r.doc_id, r.n_features, r["rank"]) for r in importance.resample(docs, none).orderBy("doc_id").collect()] == [(1, 3, None), (2, 0, None)]
    assert importance.resample(docs.limit(0), docs).count() == 0
    with pytest.raises(ValueError):
        importance.resample(docs.withColumn("Weight", docs.doc_id), none, keep=["doc_id", "Weight"])
