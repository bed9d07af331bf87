"""Substring search through postings: same rows as the scan, and only matching blocks read."""

import random

import pytest

from leadloom.operators import search, trigrams
from leadloom.operators.search import ProspectFilter
from leadloom.schemas import PROSPECTS

WORDS = ["Maison", "Brand", "élan", "ÉTOILE", "x_y", "100%", "back\\slash", "ab", "tailor", "日本語", "São Paulo", "İzmir"]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng, path = random.Random(6), str(tmp_path_factory.mktemp("trigrams"))
    rows = []
    for k in range(3_000):
        name = None if k % 50 == 0 else "hot name" if k % 3 == 0 else " ".join(rng.choices(WORDS, k=3)) + f" {k % 400}"
        rows.append({"id": f"i{k}", "domain": f"d{k}.com", "city": "x", "name": name, "country": rng.choice(["Spain", "France", None, ""]),
                     "most_similar_client": rng.choice(["Client #1", "Client #22", None]), "store_count": k % 9})
    df = spark.createDataFrame([tuple(r.get(f.name) for f in PROSPECTS.fields) for r in rows], PROSPECTS)
    trigrams.store_indexed(df, path, block_rows=100)
    return df, path


@pytest.mark.parametrize("criteria", [
    {}, {"search_name": "hot"}, {"search_name": "ison bra"}, {"search_name": "ÉTOILE"}, {"search_name": "étoile x_y"}, {"search_name": "0%"},
    {"search_name": "ab"}, {"search_name": "back\\slash"}, {"search_name": "日本語"}, {"search_name": "no such text"}, {"search_name": "tailor 39"},
    {"country": "ain", "similar_to_client": "#22"}, {"search_name": "maison", "country": "FRANCE", "similar_to_client": "client #1", "max_stores": 4},
    {"search_name": "zmir"}, {"search_name": "i̇zmir"}, {"country": "fr"},
])
def test_same_rows_as_the_scan(spark, stored, criteria):
    df, path = stored
    f = ProspectFilter(**criteria)
    got, want = trigrams.indexed_matching(spark, path, f), search.matching(df, f)
    assert set(got.columns) == set(want.columns)
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())


def test_only_matching_blocks(spark, stored):
    _, path = stored
    postings, rows = (spark.read.parquet(f"{path}/{t}") for t in ("postings", "rows"))
    every = {r.block for r in rows.select("block").distinct().collect()}
    for text in ("maison élan tailor 7", "tailor 399"):
        blocks = {r.block for r in trigrams.candidate_blocks(postings, "name", text).collect()}
        holding = {r.block for r in rows.filter(rows.name.contains(text.title())).select("block").distinct().collect()}
        assert holding <= blocks and len(blocks) < len(every) / 2
    assert trigrams.candidate_blocks(postings, "name", "no such text").isEmpty()
    assert trigrams.candidate_blocks(postings, "name", "a_b c") is None


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], PROSPECTS)
    trigrams.store_indexed(empty, str(tmp_path / "t"))
    assert trigrams.indexed_matching(spark, str(tmp_path / "t"), ProspectFilter(search_name="abc")).count() == 0
