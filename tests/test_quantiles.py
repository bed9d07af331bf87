"""Quantiles by selection against sorting, with nulls, ties, odd numbers, hot groups and many groups."""

import math
import random

import pytest
from pyspark.sql import functions as F

from leadloom.operators import clients, quantiles
from leadloom.sources.fixtures import frame

SHARES = {"low": 0.1, "mid": 0.5, "top": 1.0}


def plain(values, share):
    xs = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), v))
    if not xs:
        return None
    at = (len(xs) - 1) * share
    a, b = xs[math.floor(at)], xs[math.ceil(at)]
    return a if a == b or at == math.floor(at) else (1 - (at - math.floor(at))) * a + (at - math.floor(at)) * b


def check(spark, rows, kind):
    df = spark.createDataFrame(rows, f"a string, b int, v {kind}")
    groups = {}
    for a, b, v in rows:
        groups.setdefault((a, b), []).append(v)
    got = {(r.a, r.b): (r.low, r.mid, r.top) for r in quantiles.quantiles(df, ["a", "b"], "v", SHARES).collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        for x, share in zip(got[g], SHARES.values()):
            want = plain(vs, share)
            assert x == want or want is not None and math.isnan(want) and math.isnan(x), (g, x, want)


@pytest.mark.parametrize("kind", ["double", "long", "int"])
def test_against_sorting(spark, kind):
    rng = random.Random(kind)
    rows = []
    for k in range(2_000):
        v = rng.choice([0, 1, -1, 7, rng.randint(-10**9, 10**9)]) if kind != "double" else rng.choice(
            [0.0, -0.0, 1.5, -1e300, 1e-300, rng.uniform(-5, 5), rng.gauss(0, 1e12), math.inf, -math.inf])
        a = "hot" if k % 3 == 0 else rng.choice([None, "", "x", f"g{rng.randrange(150)}"])
        rows.append((a, rng.choice([None, 1]), None if rng.random() < 0.1 else v))
    rows += [("empty", 1, None), ("one", 1, 5 if kind != "double" else 5.25), ("same", 2, 3 if kind != "double" else 3.0)] + [("same", 2, 3 if kind != "double" else 3.0)] * 50
    check(spark, rows, kind)


def test_not_a_number_is_the_largest(spark):
    check(spark, [("x", 1, v) for v in (math.nan, 1.0, -math.inf, math.inf, math.nan)] + [("y", 1, math.nan)], "double")


def test_without_keys(spark):
    df = spark.createDataFrame([(v,) for v in (5, 1, None, 9, 3)], "v int")
    assert [tuple(r) for r in quantiles.quantiles(df, [], "v", {"m": 0.5, "q": 0.25}).collect()] == [(4.0, 2.5)]
    assert [tuple(r) for r in quantiles.quantiles(df.limit(0), [], "v", {"m": 0.5}).collect()] == [(None,)]
    assert quantiles.quantiles(df.limit(0).withColumn("k", F.lit(1)), ["k"], "v", {"m": 0.5}).count() == 0


def test_a_pass_sends_bounded_counts(spark, monkeypatch):
    """A million different values in one group: no pass counts more than 2 ** DIGIT digits per rank, in at most six passes."""
    sizes, plain_window = [], quantiles.Window.partitionBy
    monkeypatch.setattr(quantiles.Window, "partitionBy", lambda *c: (sizes.append(1), plain_window(*c))[1])
    df = spark.range(1_000_000).selectExpr("cast(pmod(id * 7919, 1000003) as double) / 7 - 500 as v")
    got = quantiles.quantiles(df, [], "v", {"m": 0.5}).first().m
    assert got == pytest.approx(df.agg(F.percentile("v", 0.5)).first()[0], abs=0)
    assert len(sizes) <= 6


def test_learned_limits_of_an_empty_base(spark, small):
    base = frame(spark, small, "clients")
    for c in (base, base.limit(0), base.withColumn("pvp_suits_eur", F.lit(0.0))):
        assert clients.threshold_row_by_selection(c).collect() == clients.threshold_row(c).collect()
