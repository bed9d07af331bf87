import pytest
from conftest import values
from pyspark.sql import functions as F

from leadloom.operators import analytics, clients, content, scoring, similarity
from leadloom.operators.scoring import Thresholds


@pytest.mark.parametrize(
    ("price", "points", "reason"),
    [
        (None, 15, None), (0.0, 15, None), (374.99, 0, "price_too_low"), (375.0, 10, None),
        (499.99, 10, None), (500.0, 20, None), (799.99, 20, None), (800.0, 30, None),
    ],
)
def test_price_points(spark, price, points, reason):
    df = spark.createDataFrame([(price, 1)], "avg_suit_price_eur double, store_count int")
    assert df.select(scoring.price_points(), scoring.rejection_reason()).first() == (points, reason)


@pytest.mark.parametrize(
    ("stores", "points", "reason", "category"),
    [
        (0, 25, None, "ideal boutique"), (1, 30, None, "ideal boutique"), (4, 30, None, "ideal boutique"),
        (5, 20, None, "small chain"), (10, 20, None, "small chain"), (11, 10, None, "medium chain"),
        (20, 10, None, "medium chain"), (21, 5, None, "large chain"), (30, 5, None, "large chain"),
        (31, 0, "too_many_stores", "large chain"),
    ],
)
def test_size_points(spark, stores, points, reason, category):
    df = spark.createDataFrame([(500.0, stores)], "avg_suit_price_eur double, store_count int")
    got = df.select(scoring.size_points(), scoring.rejection_reason(), scoring.size_category()).first()
    assert got == (points, reason, category)


def test_wool_and_mtm_points(spark):
    df = spark.createDataFrame(
        [("100%",), ("Super 100s",), ("Wool blend",), ("LÃ",), ("Unknown",), (None,)], "w string"
    )
    assert [r[0] for r in df.select(scoring.wool_points("w")).collect()] == [15, 15, 5, 5, 0, 0]
    df = spark.createDataFrame([(True,), (False,), (None,)], "m boolean")
    assert [r[0] for r in df.select(scoring.mtm_points("m")).collect()] == [15, 5, 8]


def test_recommendation_and_bands(spark):
    df = spark.createDataFrame([(s,) for s in (49, 50, 64, 65, 79, 80)], "s int")
    labels = [r[0].split(" ")[1] for r in df.select(scoring.recommendation("s")).collect()]
    assert labels == ["LOW", "CONSIDER", "CONSIDER", "RECOMMENDED", "RECOMMENDED", "HIGHLY"]
    bands = [r[0] for r in df.select(analytics.score_band(F.col("s"))).collect()]
    assert bands == ["low", "average", "average", "good", "good", "excellent"]


def test_similarity_and_market_points(spark):
    df = spark.createDataFrame([(None, None), (87.65, 20.0), (100.0, 90.0)], "similarity double, share double")
    got = values(df, similarity.similarity_points(F.col("similarity")), scoring.market_points("share"))
    assert got == [(5.0, 0.0), (pytest.approx(8.765), 4.0), (10.0, 10.0)]


def prospect(spark, **over):
    row = {"avg_suit_price_eur": 750.0, "store_count": 3, "wool_percentage": "100%", "made_to_measure": True,
           "similarity": 90.0, "market_share": 44.4} | over
    schema = ("avg_suit_price_eur double, store_count int, wool_percentage string, made_to_measure boolean,"
              " similarity double, market_share double")
    return spark.createDataFrame([tuple(row.values())], schema)


def test_final_score(spark):
    s = scoring.score(prospect(spark)).first()
    assert (s["final_score"], s["passes_hard_filters"]) == (pytest.approx(20 + 30 + 15 + 15 + 9 + 8.88), True)
    capped = scoring.score(prospect(spark, store_count=31)).first()
    assert (capped["final_score"], capped["rejection_reason"]) == (40.0, "too_many_stores")
    alone = scoring.score(prospect(spark, similarity=None, market_share=None)).first()
    assert alone["final_score"] == 85.0
    strict = scoring.score(prospect(spark), Thresholds(ideal_price=700)).first()
    assert strict["price_score"] == 30


def test_score_texts(spark):
    rows = scoring.with_texts(prospect(spark, avg_suit_price_eur=2.5, store_count=0, wool_percentage=None))
    assert values(rows, "price_text", "size_text", "wool_text", "mtm_text") == [
        ("€2", "0 stores → ideal boutique", "Unknown", "Yes")
    ]


def test_half_even_city_mean(spark):
    rows = [("x", 66)] * 131 + [("x", 67)] * 69  # sum 13269 over 200 rows, mean 66.345
    df = spark.createDataFrame(rows, "city string, final_score int")
    r = analytics.city_stats(df, " X ").first()
    assert (r["total_prospects"], r["avg_score"], r["top_score"]) == (200, 66.34, 67)


def test_brackets(spark):
    df = spark.createDataFrame(
        [(float(p), 50) for p in (0, 0.01, 499.99, 500, 999.99, 1000, 1999.99, 2000)],
        "avg_suit_price_eur double, final_score int",
    )
    assert values(analytics.price_distribution(df), "bracket", "count") == [
        ("< 500€", 2), ("500€ - 1000€", 2), ("1000€ - 2000€", 2), ("> 2000€", 1)
    ]
    df = spark.createDataFrame([(s, 50) for s in (0, 1, 5, 6, 20, 21)], "store_count int, final_score int")
    assert values(analytics.store_distribution(df), "bracket", "count") == [
        ("Boutique (1-5)", 2), ("Medium (6-20)", 2), ("Retailer (20+)", 1)
    ]


def test_empty_inputs(spark):
    df = spark.createDataFrame([], "avg_suit_price_eur double, store_count int, final_score int, status string, city string")
    assert analytics.facet_ranges(df).first() == (0.0, 5000.0, 0, 100, 0, 100)
    assert values(analytics.dashboard(df), "section", "count") == [("total", 0)]
    assert analytics.mean_listed_score(df).first()[0] == 0
    assert analytics.city_stats(df).count() == 0


def test_empty_client_base(spark, small):
    from leadloom.sources.fixtures import frame

    none = frame(spark, small, "clients").limit(0)
    row = clients.base_profile(none).first()
    assert (row["clients"], row["median_price"], row["wool_share"]) == (0, None, None)
    assert clients.market_strength(none).count() == 0
    assert clients.profile_summary(none).first()["avg_price"] == 0
    texts = spark.createDataFrame([], "url string, content string")
    assert content.extraction_rate(texts).first() == (0, 0, None)


def test_profile_text(spark):
    df = spark.createDataFrame(
        [("A", "Spain", "Madrid", 3, 800.0, "own_brand"), ("B", "Spain", "Spain", 21, None, "unknown"),
         ("C", None, "", 6, 0.0, None)],
        "name string, country string, city string, store_count int, pvp_suits_eur double, brand_type string",
    )
    assert [r[0] for r in df.select(clients.profile_text()).collect()] == [
        "A is a menswear brand from Madrid, Spain. They are a small boutique selling suits priced at €800."
        " Business type: own_brand.",
        "B is a menswear brand from Spain. They are a large chain selling price not public.",
        "C is a menswear brand from Unknown. They are a medium chain selling price not public.",
    ]


def test_explanation(spark):
    schema = ("store_count int, wool_percentage string, made_to_measure boolean, brand_style string,"
              " client_store_count int, client_wool_percentage string, client_made_to_measure boolean,"
              " client_brand_style string, client_name string, similarity double")
    df = spark.createDataFrame(
        [(3, "100%", True, "Premium", 8, "100%", True, "Premium", "Acme", 88.88),
         (3, "blend", None, "Luxury", 20, "100%", True, "Premium", "Acme", 88.88)], schema)
    got = [r[0] for r in df.select(similarity.explanation(F.col("similarity"))).collect()]
    assert got == [
        "Similar to Acme because both have: similar boutique size (3 vs 8 stores), 100% wool suits,"
        " made-to-measure services, Premium positioning.",
        "Similar to Acme (88.9% match) based on overall brand profile and positioning.",
    ]


def test_confidence_and_weights(spark):
    schema = ("avg_suit_price_eur double, store_count int, wool_percentage string, made_to_measure boolean,"
              " brand_style string, business_model string")
    df = spark.createDataFrame(
        [(800.0, 2, "100%", True, "Luxury", "Retail"), (800.0, 2, "unknown", None, "Luxury", "Retail"),
         (800.0, 0, "unknown", None, "Luxury", "Retail"), (0.0, 0, "100%", True, "Luxury", "Retail")], schema)
    assert [r[0] for r in df.select(scoring.data_confidence()).collect()] == [100, 70, 40, 20]
    w = scoring.weighted_score(F.lit(80), F.lit(60), F.lit(40), F.lit(100))
    assert df.select(w).first()[0] == 69.0


def test_price_fill(spark):
    df = spark.createDataFrame(
        [(0.0, 100.0), (108.0, None), (0.0, None), (50.0, 70.0), (0.0, 0.0)],
        "average_suit_price_usd double, avg_suit_price_eur double")
    got = values(content.fill_prices(df), "average_suit_price_usd", "avg_suit_price_eur")
    assert got == [(108.0, 100.0), (108.0, pytest.approx(100.0)), (0.0, None), (50.0, 70.0), (0.0, 0.0)]


def test_learned_thresholds(spark, small):
    from leadloom.sources.fixtures import frame

    t = clients.learned_thresholds(frame(spark, small, "clients"))
    assert t.min_price >= 375 and t.max_stores <= 30 and t.ideal_stores >= 1
