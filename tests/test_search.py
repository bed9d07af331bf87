import pytest
from conftest import values
from pyspark.sql import functions as F

from leadloom.operators import discovery, search, writes
from leadloom.operators.search import ProspectFilter
from leadloom.sources.fixtures import frame

SCHEMA = ("id string, domain string, name string, city string, store_count int, avg_suit_price_eur double,"
          " final_score int, made_to_measure boolean, status string")


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [
            ("1", "a.com", "Acme 100%", "x", 1, None, 50, True, "new"),
            ("2", "a.com", "Acme_B", "x", 2, 900.0, 50, False, "new"),
            ("3", "b.com", "Bolt", "x", 3, 0.0, 70, None, "contacted"),
            ("4", "c.com", "Cord", "y", None, 300.0, 70, True, "rejected"),
            ("5", "d.com", "Dune", "y", 9, None, 10, None, "new"),
        ],
        SCHEMA,
    )


def ids(df):
    return [r["id"] for r in df.select("id").collect()]


def test_nulls_sort_as_largest(rows):
    f = ProspectFilter(sort_by="avg_suit_price_eur", sort_order="desc")
    assert ids(search.search(rows, f)) == ["1", "5", "4", "3"]
    f = ProspectFilter(sort_by="avg_suit_price_eur", sort_order="asc")
    assert ids(search.search(rows, f)) == ["3", "4", "2", "5"]


def test_filter_runs_before_the_choice_per_domain(rows):
    assert ids(search.search(rows, ProspectFilter(min_price=100))) == ["4", "2"]


def test_listing_is_in_domain_order(rows):
    assert ids(search.listing(rows, 3)) == ["1", "3", "4"]
    assert ids(search.listing(rows, 5, " Y")) == ["4", "5"]


def test_pages_and_info(rows):
    assert ids(search.search(rows, ProspectFilter(limit=2))) == ["3", "4"]
    assert ids(search.search(rows, ProspectFilter(limit=2, offset=2))) == ["1", "5"]
    assert ids(search.search(rows, ProspectFilter(limit=2, offset=9))) == []
    assert search.page_info(rows, ProspectFilter(limit=2)).first() == (4, 2, 2, 0, True)
    assert search.page_info(rows, ProspectFilter(limit=2, offset=2)).first() == (4, 2, 2, 2, False)
    assert search.page_info(rows, ProspectFilter(limit=2, offset=9)).first() == (4, 0, 2, 9, False)


def test_text_wildcards_and_empty_filters(rows):
    assert ids(search.matching(rows, ProspectFilter(search_name="E_b"))) == ["2"]
    assert ids(search.matching(rows, ProspectFilter(search_name="0%"))) == ["1"]
    assert len(ids(search.matching(rows, ProspectFilter(search_name="", city="", status="", made_to_measure="unknown")))) == 5
    assert ids(search.matching(rows, ProspectFilter(made_to_measure="FALSE"))) == ["2"]
    assert ids(search.matching(rows, ProspectFilter(status="new", statuses=("rejected",)))) == ["1", "2", "5"]
    assert ids(search.matching(rows, ProspectFilter(statuses=("rejected", "contacted")))) == ["3", "4"]


@pytest.mark.parametrize("bad", [
    {"limit": 0}, {"limit": 101}, {"offset": -1}, {"min_score": 101}, {"min_price": -1}, {"status": "gone"},
])
def test_bounds(bad):
    with pytest.raises(ValueError):
        ProspectFilter(**bad)


def test_pages_concatenate_to_the_whole(spark, small):
    prospects = frame(spark, small, "prospects")
    whole = ids(search.best_per_domain(prospects).orderBy(F.desc("final_score"), "domain"))
    pages = []
    for offset in range(0, len(whole), 60):
        pages += ids(search.search(prospects, ProspectFilter(limit=60, offset=offset)))
    assert pages == whole


def test_first_wins_does_not_depend_on_row_order(spark, small):
    hits = frame(spark, small, "search_results")
    suppression = frame(spark, small, "suppression")
    a = discovery.dedupe_domains(hits, suppression)
    b = discovery.dedupe_domains(hits.orderBy(F.rand(3)), suppression)
    cols = ["city", "rank", "url"]
    assert sorted(values(a, *cols)) == sorted(values(b, *cols))


def test_suppressed_domain_does_not_hide_others(spark):
    hits = spark.createDataFrame(
        [("x", 0, 0, "https://bad.com/a"), ("x", 0, 1, "https://www.good.com/"), ("x", 0, 2, "http://GOOD.com"),
         ("x", 1, 0, "no-scheme.com"), ("x", 1, 1, None), ("x", 1, 2, "")],
        "city string, query_index int, rank int, url string")
    listed = spark.createDataFrame([("BAD.com ",)], "domain string")
    got = discovery.dedupe_domains(hits, listed).orderBy("query_index", "rank")
    # GOOD.com is another domain (case kept) with the same URL key; no-scheme.com has the empty domain
    assert [r["url"] for r in got.collect()] == ["https://www.good.com/", "no-scheme.com"]


def test_upsert_and_status(spark):
    table = spark.createDataFrame([("1", "a", "x"), ("2", "b", "y")], "id string, name string, city string")
    new = spark.createDataFrame([("2", "B", "z"), ("3", "c", "w")], "id string, name string, city string")
    got = sorted(values(writes.upsert(table, new, "id", ["name"]), "id", "name", "city"))
    assert got == [("1", "a", "x"), ("2", "B", "y"), ("3", "c", "w")]
    stored = spark.createDataFrame([("1", "new", "n"), ("2", "new", "n")], "id string, status string, notes string")
    changes = spark.createDataFrame(
        [("1", 1, "contacted", "hi"), ("1", 2, "converted", None), ("1", 3, "archived", "no"), ("9", 1, "new", "")],
        "id string, change_no int, status string, notes string")
    got = sorted(values(writes.update_status(stored, changes), "id", "status", "notes"))
    assert got == [("1", "converted", None), ("2", "new", "n")]
    assert values(writes.rejected_changes(changes), "id", "status") == [("1", "archived")]


def test_refresh_clients(spark):
    cols = ("id string, name string, country string, city string, store_count int, profile_text string,"
            " brand_type string, pvp_suits_eur double")
    source = spark.createDataFrame([("1", "A", "c", "t", 1, "", "own", 1.0), ("2", "B", "c", "t", 1, "", "own", 1.0)], cols)
    full = spark.createDataFrame([("1", "x", "c", "t", 5, "old", "own", 1.0), ("9", "y", "c", "t", 5, "old", "own", 1.0)], cols)
    part = full.filter("id = '1'")
    assert sorted(values(writes.refresh_clients(full, source), "id", "name")) == [("1", "x"), ("9", "y")]
    assert sorted(values(writes.refresh_clients(part, source), "id", "name", "store_count")) == [("1", "A", 5), ("2", "B", 1)]
    assert sorted(values(writes.refresh_clients(full, source, force=True), "id", "name")) == [("1", "A"), ("2", "B")]
