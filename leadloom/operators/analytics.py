"""Statistics over stored prospects. Every job is one scan with map-side partial aggregates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.exprs import BLANKS, falsy_to

# Labels and limits of the distributions.
PRICE_BRACKETS = ("< 500€", "500€ - 1000€", "1000€ - 2000€", "> 2000€")
STORE_BRACKETS = ("Boutique (1-5)", "Medium (6-20)", "Retailer (20+)")
SCORE_BANDS = (("excellent", 80), ("good", 65), ("average", 50), ("low", None))

# Assumed prices (per 1000 tokens) and token use per search, as published.
PRICING = {
    "gpt-5.1": (0.005, 0.015),
    "gpt-4": (0.03, 0.06),
    "gpt-4-turbo": (0.01, 0.03),
    "gpt-35-turbo": (0.0015, 0.002),
}
DEFAULT_MODEL = "gpt-35-turbo"
EMBEDDING_PRICE_PER_MILLION = 0.02
CALLS_PER_SEARCH = {
    "query_generation": (800, 100),
    "selection_agent": (4000, 500),
    "final_selection": (15000, 2000),
}
CALLS_PER_PROSPECT = {"similarity_explanation": (600, 100)}
EMBEDDING_TOKENS = 150


def facets(prospects: DataFrame) -> DataFrame:
    """Distinct values per filter list, long form (facet, value).

    One scan and one shuffle of distinct values for all lists.
    """

    def entry(facet: str, value: Column) -> Column:
        return F.struct(F.lit(facet).alias("facet"), value.alias("value"))

    entries = F.array(
        entry("status", F.col("status")),
        entry("brand_style", F.when(F.col("brand_style") != "unknown", F.col("brand_style"))),
        entry("country", F.when(F.col("country") != "Unknown", F.col("country"))),
        entry("city", F.col("city")),
    )
    return (
        prospects.select(F.inline(entries))
        .filter("value is not null")
        .distinct()
    )


def facet_ranges(prospects: DataFrame) -> DataFrame:
    bounds = {
        "price": ("avg_suit_price_eur", 0.0, 5000.0),
        "stores": ("store_count", 0, 100),
        "score": ("final_score", 0, 100),
    }
    raw = [
        f(c).alias(f"{side}_{name}")
        for name, (c, _, _) in bounds.items()
        for side, f in (("min", F.min), ("max", F.max))
    ]
    return prospects.agg(*raw).select(
        *[
            falsy_to(f"{side}_{name}", default).alias(f"{side}_{name}")
            for name, (_, low, high) in bounds.items()
            for side, default in (("min", low), ("max", high))
        ]
    )


def price_bracket(price: Column) -> Column:
    return (
        F.when(price < 500, PRICE_BRACKETS[0])
        .when(price < 1000, PRICE_BRACKETS[1])
        .when(price < 2000, PRICE_BRACKETS[2])
        .otherwise(PRICE_BRACKETS[3])
    )


def store_bracket(stores: Column) -> Column:
    return (
        F.when(stores <= 5, STORE_BRACKETS[0])
        .when(stores <= 20, STORE_BRACKETS[1])
        .otherwise(STORE_BRACKETS[2])
    )


def _distribution(prospects: DataFrame, column: str, bracket: Column) -> DataFrame:
    return (
        prospects.filter(F.col(column) > 0)
        .groupBy(bracket.alias("bracket"))
        .agg(
            F.count("*").alias("count"),
            F.avg("final_score").alias("avg_score"),
            F.min(column).alias("_low"),
        )
        .orderBy("_low")
        .drop("_low")
    )


def price_distribution(prospects: DataFrame) -> DataFrame:
    c = "avg_suit_price_eur"
    return _distribution(prospects, c, price_bracket(F.col(c)))


def store_distribution(prospects: DataFrame) -> DataFrame:
    return _distribution(prospects, "store_count", store_bracket(F.col("store_count")))


def price_stats(prospects: DataFrame) -> DataFrame:
    p = F.col("avg_suit_price_eur")
    return prospects.filter(p > 0).agg(
        F.min(p).alias("min_price"), F.max(p).alias("max_price"), F.avg(p).alias("avg_price")
    )


def score_band(score: Column) -> Column:
    band = None
    for name, low in SCORE_BANDS:
        if low is None:
            return band.otherwise(name)
        band = F.when(score >= low, name) if band is None else band.when(score >= low, name)
    return band


def dashboard(prospects: DataFrame, top_cities: int = 10) -> DataFrame:
    """Total, counts by status and score band, and the largest cities, long form (section, key, count).

    All sections start from one small pre-aggregate (status, city, band), whose shuffle Spark reuses, so
    the table is read once.
    """
    cube = prospects.groupBy(
        "status", "city", score_band(F.col("final_score")).alias("band")
    ).agg(F.count("*").alias("n"))
    return dashboard_of(cube, top_cities)


def dashboard_of(cube: DataFrame, top_cities: int = 10) -> DataFrame:
    """The same from rows counted per (status, city, band) as ``n``."""

    def section(name: str, key: str) -> DataFrame:
        return cube.groupBy(F.col(key).alias("key")).agg(F.sum("n").alias("count")).select(
            F.lit(name).alias("section"), "key", "count"
        )

    total = cube.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count")).select(
        F.lit("total").alias("section"), F.lit("prospects").alias("key"), "count"
    )
    cities = section("city", "city").orderBy(F.desc("count"), "key").limit(top_cities)
    return total.union(section("status", "status")).union(section("score", "band")).union(cities)


def _exact_mean(column: str) -> Column:
    """Mean of an integer column as a decimal."""
    return F.sum(column).cast("decimal(20,0)") / F.count(column).cast("decimal(20,0)")


def city_stats(prospects: DataFrame, city: str | None = None) -> DataFrame:
    """Count, mean score (two places, halves to even) and top score, per city or for one city."""
    rows = prospects.filter(F.col("city") == city.lower().strip(BLANKS)) if city else prospects
    return rows.groupBy("city").agg(
        F.count("*").alias("total_prospects"),
        F.bround(_exact_mean("final_score"), 2).cast("double").alias("avg_score"),
        F.max("final_score").alias("top_score"),
    )


def city_rollup(prospects: DataFrame) -> DataFrame:
    s = F.col("status")
    return (
        prospects.groupBy("city")
        .agg(
            F.count("*").alias("total_prospects"),
            F.avg("final_score").alias("avg_score"),
            F.max("final_score").alias("top_score"),
            F.count_if(s == "new").alias("new_count"),
            F.count_if(s == "contacted").alias("contacted_count"),
            F.count_if(s == "converted").alias("converted_count"),
        )
        .orderBy(F.desc("total_prospects"), "city")
    )


def mean_listed_score(listed: DataFrame) -> DataFrame:
    """Mean score of the rows shown, one decimal, 0 for an empty list."""
    mean = F.round(F.sum("final_score").cast("decimal(20,0)") / F.count("final_score"), 1)
    return listed.agg(F.coalesce(mean.cast("double"), F.lit(0.0)).alias("mean_score"))


def search_costs(
    prospects: DataFrame,
    models: tuple[str, ...] = tuple(PRICING),
    pricing: Mapping[str, tuple[float, float]] = PRICING,
    default_model: str = DEFAULT_MODEL,
) -> DataFrame:
    """Cost of a search per city and model: fixed calls plus calls per prospect found.

    The price book is a parameter; an unknown model takes the default row. Models multiply the small
    per-city counts in a projection.
    """

    def cost(tokens: tuple[int, int], price: tuple[float, float]) -> float:
        return tokens[0] / 1000 * price[0] + tokens[1] / 1000 * price[1]

    embedding = EMBEDDING_TOKENS / 1_000_000 * EMBEDDING_PRICE_PER_MILLION
    rows = []
    for model in models:
        price = pricing.get(model, pricing[default_model])
        fixed = sum(cost(t, price) for t in CALLS_PER_SEARCH.values())
        each = embedding + sum(cost(t, price) for t in CALLS_PER_PROSPECT.values())
        rows.append(
            F.struct(F.lit(model).alias("model"), F.lit(fixed).alias("fixed"), F.lit(each).alias("each"))
        )
    return (
        prospects.groupBy("city")
        .agg(F.count("*").alias("n_prospects"))
        .select("city", "n_prospects", F.inline(F.array(*rows)))
        .select(
            "city", "model", "n_prospects",
            (F.col("fixed") + F.col("each") * F.col("n_prospects")).alias("total_cost"),
        )
    )
