"""Inputs that the derived fixtures do not hold: blank keys, damaged markup, extremes, empty tables."""

import pytest
from conftest import values
from pyspark.sql import functions as F

from leadloom.functions import text
from leadloom.operators import clients, content, geo, scoring, search, similarity
from leadloom.operators.search import ProspectFilter


def test_pages_without_a_target_get_no_foreign_text(spark):
    pages = spark.createDataFrame([(1, "p1", "https://a.com/x"), (2, "p2", None), (3, "p3", "  "), (4, "p4", "https://none.com")],
                                  "page_id int, content string, target_url string")
    second = spark.createDataFrame([("https://www.A.com/x/", "found"), ("https://", "junk"), (None, "junk"), ("", "junk"), ("http://a.com/x", "found too")],
                                   "url string, content string")
    got = dict(values(content.merge_secondary(pages, second), "page_id", "content"))
    assert got[1].startswith("p1\n\n===") and got[1].endswith("\nfound too")  # of one key the first address
    assert (got[2], got[3], got[4]) == ("p2", "p3", "p4")


@pytest.mark.parametrize(("html", "link"), [
    ('<a href="/suits">Our suits', "https://x.com/suits"), ('<a data-href="/suits">Suits</a>', None),
    ('<a href="/about">About<a href="/wedding">Wedding suits', "https://x.com/wedding"),
    ("<A\nclass=b HREF='/suits'>Suits</A>", "https://x.com/suits"), ("<abbr href='/suits'>Suits</abbr>", None),
    ('<a href="/suits">' * 20_000, "https://x.com/suits"),
])
def test_links(spark, html, link):
    df = spark.createDataFrame([("https://x.com/p", html)], "url string, html string")
    assert content.best_link(df).first()["link"] == link


def test_long_addresses_are_not_cut(spark):
    path = "/" + "d/" * 600_000
    df = spark.createDataFrame([(f"https://x.com{path}page", "next")], "url string, href string")
    assert df.select(F.length(content.resolve_url("url", F.col("href")))).first()[0] == len(f"https://x.com{path}next")


def test_store_counts_beyond_an_integer(spark):
    df = spark.createDataFrame([("99999999999",), ("12",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(scoring.lenient_stores("s")).collect()] == [2**31 - 1, 12, 0, 0]


def test_limits_of_an_empty_client_base(spark):
    schema = "pvp_suits_eur double, store_count int, years_as_client int, wool_percentage string, made_to_measure boolean, brand_type string, tier string"
    assert clients.learned_thresholds(spark.createDataFrame([], schema)) == scoring.Thresholds()
    one = spark.createDataFrame([(700.0, 3, 1, "100%", True, "own_brand", "high_value")], schema)
    learned = clients.learned_thresholds(one)
    assert (learned.min_price, learned.max_stores, learned.ideal_price, learned.ideal_stores) == (700.0, 3, 700, 3)


@pytest.mark.parametrize(("words", "points"), [
    ("Fato 100% Lã, feito à medida", 45), ("super 170s cloth", 10), ("super120", 10), ("super 110s", 0), ("", 0), (None, 0),
])
def test_documented_words(spark, words, points):
    df = spark.createDataFrame([(words,)], "t string")
    assert df.select(text.quality_bonus("t")).first()[0] == points


def test_backslash_in_a_search(spark):
    df = spark.createDataFrame([("a", "x.com", r"C:\suits", 1), ("b", "y.com", "C suits", 2)], "id string, domain string, name string, final_score int")
    assert values(search.matching(df, ProspectFilter(search_name="c:\\s")), "id") == [("a",)]


def test_streets_of_rows_that_share_an_id(spark):
    pages = spark.createDataFrame([(1, "x", "at long road"), (1, "x", "nothing"), (None, "x", "at long road"), (2, None, "at long road")],
                                  "page_id int, city string, content string")
    streets = spark.createDataFrame([("X ", 0, "road", 2), ("x", 0, "long road", 1), ("x", 1, None, 3)], "city string, pos int, street string, tier int")
    for small in (True, False, None):
        found = geo.detect_street(pages, streets, small=small)
        assert sorted(values(found, "page_id", "content", "street"), key=str) == sorted(
            [(1, "at long road", "long road"), (1, "nothing", None), (None, "at long road", "long road"), (2, "at long road", None)], key=str)


def test_rankings_of_rows_that_share_a_key(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    base = spark.createDataFrame([(7, [1.0, 0.1]), (8, [0.1, 1.0])], "client_id long, embedding array<float>")
    for bound in (1 << 20, 1):
        got = similarity.top_similar(rows, base, 1, matrix_max_bytes=bound)
        assert sorted(values(got, "vec_id", "client_id")) == [(1, 7), (1, 8), (1, 8)]


@pytest.mark.parametrize("order", ["desc", "asc"])
@pytest.mark.parametrize("column", ["final_score", "avg_suit_price_eur"])
def test_pages_by_key_equal_pages_by_offset(spark, order, column):
    rows = [(str(k), f"d{k % 40:02}.com", k * 7 % 5, None if k % 6 == 0 else float(k % 4)) for k in range(90)]
    df = spark.createDataFrame(rows, f"id string, domain string, {'final_score int, avg_suit_price_eur double'}")
    last, got = None, []
    for page in range(5):
        f = ProspectFilter(sort_by=column, sort_order=order, limit=9, offset=9 * page)
        want = values(search.search(df, f), "domain", column)
        own = want if last is None else values(search.search_after(df, f, last[1], last[0]), "domain", column)
        assert own == want
        got += own
        last = own[-1]
    assert len(got) == 40
