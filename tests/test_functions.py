"""Boundary values of the column expressions."""

import pytest
from conftest import values
from pyspark.sql import functions as F

from leadloom.functions import keys, text
from leadloom.operators import content, geo
from leadloom.sources import records


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("url", "discovery", "store"),
    [
        ("https://www.a.com/", "a.com", "a.com"),
        ("a.com/?x", "a.com/", "a.com/"),
        ("a.com/?x/", "a.com/", "a.com/"),
        ("http://b.com/www.c", "b.com/www.c", "b.com/c"),
        (" HTTPS://A.com// ", "a.com", "a.com"),
        ("https://x.com/#top", "x.com/", "x.com/"),
        ("", "", ""),
        ("https://", "", ""),
        ("\thttp://Q.com ", "q.com", "q.com"),
        ("www.http://z.com", "http://z.com", "z.com"),
    ],
)
def test_url_keys(spark, url, discovery, store):
    assert one(spark, keys.discovery_url_key("u"), u=url) == discovery
    assert one(spark, keys.store_url_key("u"), u=url) == store


def test_null_url_has_an_empty_key(spark):
    df = spark.sql("select cast(null as string) u")
    assert df.select(keys.discovery_url_key("u"), keys.store_url_key("u")).first() == ("", "")
    assert df.select(keys.discovery_domain("u")).first()[0] == ""


@pytest.mark.parametrize(
    ("url", "domain", "contact"),
    [
        ("https://www.Ex.com:80/a", "Ex.com:80", "ex.com"),
        ("ex.com/a", "", ""),
        ("  https://a.b/c?d ", "a.b", "a.b"),
        ("//cdn.x.org", "cdn.x.org", "cdn.x.org"),
        ("https://WWW.Big.com/", "WWW.Big.com", "big.com"),
        ("https://user:pw@www.shop.com:8443/x", "user:pw@www.shop.com:8443", "shop.com"),
        ("http://a.www.b.com", "a.www.b.com", "a.b.com"),
    ],
)
def test_domains(spark, url, domain, contact):
    assert one(spark, keys.discovery_domain("u"), u=url) == domain
    assert one(spark, keys.contact_host("u"), u=url) == contact


def test_prospect_id(spark):
    import hashlib

    want = hashlib.md5(b"shop.com/a_london").hexdigest()[:16]
    assert one(spark, keys.prospect_id(F.lit("shop.com/a"), F.lit("london"))) == want
    assert one(spark, keys.store_domain("u"), u="http://www.Shop.com/a/b") == "shop.com"
    assert one(spark, keys.city_key("c"), c="  São Paulo\n") == "são paulo"


@pytest.mark.parametrize(
    ("body", "price"),
    [
        ("€1.299,00", 1299), ("$1,299", 1299), ("$999.00", 0), ("€1500", 0), ("€2500", 250),
        ("2500€", 500), ("12,99€", 1299), ("€500 EUR", 500), ("", 0), ("no price", 0),
        ("€151 and €150 and €5999 and €6000", 575), ("£ 800", 800), ("€ 800", 800),
        ("suits 900 EUR, shirts 300EUR", 600),
    ],
)
def test_average_price(spark, body, price):
    want = {"€151 and €150 and €5999 and €6000": (151 + 599 + 600) / 3}.get(body, price)
    got = one(spark, text.average_price("c"), c=body)
    assert got == pytest.approx(want)


def test_price_counts_twice_when_marked_twice(spark):
    assert one(spark, text.price_values("c"), c="€500 EUR") == [500.0, 500.0]


def test_average_price_of_null(spark):
    assert spark.sql("select cast(null as string) c").select(text.average_price("c")).first()[0] == 0


@pytest.mark.parametrize(
    ("body", "found"),
    [
        ("from 300", True), ("PREIS: 9", True), ("starting  at €5", True), ("a partir de 10", True),
        ("5 €", True), ("$ 5", True), ("€", False), ("price on request", False), ("", False),
        ("Prix = £12", True),
    ],
)
def test_price_presence(spark, body, found):
    assert one(spark, text.mentions_price("c"), c=body) is found


def test_relevance_window_and_words(spark):
    def score(c, **kw):
        return one(spark, text.relevance_score("c", **kw), c=c)

    assert score("suitable") == 4  # one word, strong
    assert score("moda") == 1
    assert score("x" * 4996 + "suit") == 4
    assert score("x" * 4997 + "suit") == 0
    assert score("x" * 4997 + "suit", window=None) == 4
    assert one(spark, text.is_directory_url("u"), u="https://x.com/LISTing") is True
    assert one(spark, text.is_directory_url("u"), u="https://x.com/a") is False


def test_title_and_truncation(spark):
    assert one(spark, text.heading_title("c"), c="a\n##no\n# Hello \n# Two") == "Hello"
    assert one(spark, text.heading_title("c"), c="none") == ""
    cut = one(spark, text.truncated("c", 5), c="123456")
    assert cut == "12345" + text.TRUNCATION_MARK
    assert one(spark, text.truncated("c", 6), c="123456") == "123456"


def test_quality_bonus_caps(spark):
    rich = ("100% wool made to measure Loro Piana Holland & Sherry Super 130s canvassed customizable")
    assert one(spark, text.quality_bonus("c"), c=rich) == 100
    assert one(spark, text.quality_bonus("c"), c="bespoke, canvassed") == 30
    assert one(spark, text.quality_bonus("c"), c="") == 0


@pytest.mark.parametrize(
    ("base", "href", "want"),
    [
        ("https://a.com/x/y", "/suits", "https://a.com/suits"),
        ("https://a.com/x/y", "z", "https://a.com/x/z"),
        ("https://a.com", "z", "https://a.com/z"),
        ("https://a.com/x/y?q=1", "?p=2", "https://a.com/x/y?p=2"),
        ("https://a.com/x/y", "//b.com/c", "https://b.com/c"),
        ("https://a.com/x/y", "http://c.com", "http://c.com"),
        ("https://a.com/x/y/z", "../k", "https://a.com/x/k"),
        ("https://a.com/x/y", "./k?a=1&amp;b=2", "https://a.com/x/k?a=1&b=2"),
        ("https://a.com/x", "../../k/", "https://a.com/k/"),
    ],
)
def test_resolve_url(spark, base, href, want):
    assert one(spark, content.resolve_url("b", F.col("h")), b=base, h=href) == want


def test_link_scoring(spark):
    def best(*links, **kw):
        html = "<body>" + "".join(links) + "</body>"
        df = spark.createDataFrame([(1, "https://a.com/", html)], "page_id int, url string, html string")
        return content.best_link(df, **kw).select("link", "link_score").first()

    assert best('<a href="/s1">Suits</a>', '<a href="/s2">Suits</a>') == ("https://a.com/s1", 10)
    assert best('<a href="/cart">shop</a>')[0] is None
    assert best('<a href="#x">suits</a>', '<a href="javascript:void(0)">suits</a>') == (None, None)
    assert best("<a class=k href='/shop'><b>Our</b> store</a>") == ("https://a.com/shop", 3)
    assert best('<a href=/store>x</a>') == (None, 1)
    assert best('<a href="https://b.com/suits">The <i>suit</i></a>') == ("https://b.com/suits", 15)
    assert best("no links") == (None, None)


def test_streets_take_the_first_listed(spark):
    streets = spark.createDataFrame(
        [("london", 0, "new bond street", 1), ("london", 1, "regent street", 2)],
        "city string, pos int, street string, tier int",
    )
    pages = spark.createDataFrame(
        [
            (1, " London", "On Bond Street"), (2, "London", "Regent Street and New Bond Street"),
            (3, "Paris", "New Bond Street"), (4, "London", None),
        ],
        "page_id int, city string, content string",
    )
    want = [(1, None, 0, "standard"), (2, "new bond street", 10, "premium"), (3, None, 0, "standard"),
            (4, None, 0, "standard")]
    for small in (True, False):
        found = geo.with_location(geo.detect_street(pages, streets, ["page_id"], small=small))
        cols = ("page_id", "street", "location_score", "location_quality")
        assert sorted(values(found, *cols)) == want


def test_lenient_import(spark):
    for raw, want in ((" 7 ", 7), ("many", 0), ("12.0", 0), ("", 0), ("-3", -3)):
        assert one(spark, records.lenient_int("x"), x=raw) == want
    for raw, want in (('["a","b"]', ["a", "b"]), ("bad", []), ("{}", []), ("[]", [])):
        assert one(spark, records.json_list("x"), x=raw) == want
