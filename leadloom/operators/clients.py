"""The base of known good clients: profiles, selections, learned thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.exprs import falsy_to
from leadloom.operators.quantiles import quantiles
from leadloom.operators.scoring import Thresholds

# Tiers in order of priority.
TIERS = ("high_value", "medium_value", "low_value")


def _plain_number(c: Column) -> Column:
    """A whole number without decimals, any other number as is."""
    return F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(c.cast("string"))


# The wording of the sentence below.
def profile_text(price: str = "pvp_suits_eur", brand_type: str | None = "brand_type") -> Column:
    """One sentence on a client or prospect, the text that gets embedded."""
    city, country = F.col("city"), F.coalesce("country", F.lit("Unknown"))
    has_city = F.coalesce((city != "") & (city != country), F.lit(False))
    place = F.when(has_city, F.concat(city, F.lit(", "), country)).otherwise(country)
    p = F.col(price)
    prices = F.when(
        F.coalesce(p != 0, F.lit(False)), F.concat(F.lit("suits priced at €"), _plain_number(p))
    ).otherwise("price not public")
    stores = F.coalesce("store_count", F.lit(0))
    size = F.when(stores <= 5, "small boutique").when(stores <= 20, "medium chain").otherwise("large chain")
    text = F.concat(
        F.coalesce("name", F.lit("Unknown")), F.lit(" is a menswear brand from "), place,
        F.lit(". They are a "), size, F.lit(" selling "), prices, F.lit("."),
    )
    if brand_type is None:
        return text
    kind = F.coalesce(brand_type, F.lit("unknown"))
    return F.concat(
        text,
        F.when(kind != "unknown", F.concat(F.lit(" Business type: "), kind, F.lit("."))).otherwise(""),
    )


def ideal_clients(clients: DataFrame, max_stores: int = 10) -> DataFrame:
    stores = F.coalesce("store_count", F.lit(0))
    quality = (F.col("wool_percentage") == "100%") | F.col("made_to_measure")
    return clients.filter((stores >= 0) & (stores <= max_stores) & F.coalesce(quality, F.lit(False)))


def select_clients(
    clients: DataFrame, tier: str | None = None, country_code: str | None = None,
    brand_type: str | None = None, min_years: int | None = None,
) -> DataFrame:
    out = clients
    for column, value in (("tier", tier), ("country_code", country_code), ("brand_type", brand_type)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    if min_years is not None:
        out = out.filter(F.coalesce("years_as_client", F.lit(0)) >= min_years)
    return out


def top_clients(clients: DataFrame, n: int = 10) -> DataFrame:
    years = F.coalesce("years_as_client", F.lit(0))
    return clients.orderBy(years.desc(), "client_id").limit(n)


def example_clients(clients: DataFrame, n: int = 5) -> DataFrame:
    """Best examples by tier, then loyalty, with a line of text each."""
    tier_rank = F.when(F.col("tier") == TIERS[0], 0).when(F.col("tier") == TIERS[1], 1).otherwise(2)
    years = F.coalesce("years_as_client", F.lit(0))
    price = F.col("pvp_suits_eur")
    price_text = F.when(
        F.coalesce(price != 0, F.lit(False)), F.concat(F.lit("€"), _plain_number(price))
    ).otherwise("N/A")
    line = F.concat(
        F.col("name"), F.lit(" ("), F.col("country"), F.lit(") | "),
        F.coalesce(F.col("store_count").cast("string"), F.lit("unknown")), F.lit(" | "), price_text,
        F.lit(" | "), F.when(F.col("made_to_measure"), "Sim").otherwise("Não"),
    )
    return (
        clients.withColumn("tier_rank", tier_rank)
        .withColumn("example", line)
        .orderBy("tier_rank", years.desc(), "client_id")
        .limit(n)
    )


def market_strength(clients: DataFrame) -> DataFrame:
    """Share of clients per country, in percent; the total is a scalar subquery."""
    total = clients.agg(F.count("*")).scalar()
    return (
        clients.groupBy("country_code")
        .agg(F.count("*").alias("clients"))
        .withColumn("share", F.col("clients") / total * 100)
    )


def base_profile(clients: DataFrame) -> DataFrame:
    """Distribution figures of the client base in one row; medians are exact.

    ``percentile`` keeps one counter per distinct value and merges counters map-side.
    """
    price, stores, years = falsy_to("pvp_suits_eur", None), F.col("store_count"), F.col("years_as_client")
    n = F.count("*")

    def share(flag: Column) -> Column:
        return F.try_divide(F.count_if(flag), n) * 100

    return clients.agg(
        n.alias("clients"),
        F.count(price).alias("with_price"),
        F.min(price).alias("min_price"), F.max(price).alias("max_price"),
        F.avg(price).alias("mean_price"), F.percentile(price, 0.5).alias("median_price"),
        F.min(stores).alias("min_stores"), F.max(stores).alias("max_stores"),
        F.avg(stores).alias("mean_stores"), F.percentile(stores, 0.5).alias("median_stores"),
        F.count_if(stores < 5).alias("stores_below_5"),
        F.count_if((stores >= 5) & (stores <= 10)).alias("stores_5_10"),
        F.count_if((stores >= 11) & (stores <= 20)).alias("stores_11_20"),
        F.count_if(stores > 20).alias("stores_above_20"),
        share(F.col("wool_percentage") == "100%").alias("wool_share"),
        share(F.col("made_to_measure")).alias("mtm_share"),
        share(~F.col("made_to_measure")).alias("no_mtm_share"),
        share(F.col("brand_type") == "own_brand").alias("own_brand_share"),
        share(F.col("brand_type") == "multibrand").alias("multibrand_share"),
        *[F.count_if(F.col("tier") == t).alias(t) for t in TIERS],
        F.min(years).alias("min_years"), F.max(years).alias("max_years"),
        F.avg(years).alias("mean_years"),
    )


def clients_per_country(clients: DataFrame) -> DataFrame:
    return clients.groupBy("country_code").agg(F.count("*").alias("clients"))


def threshold_row(clients: DataFrame) -> DataFrame:
    """Scoring limits of the client base as one row; what an empty base does not tell takes the default."""
    t = Thresholds()
    learned = {
        "min_price": (F.col("min_price"), t.min_price), "max_stores": (F.col("max_stores"), t.max_stores),
        "ideal_price": (F.floor("median_price"), t.ideal_price), "ideal_stores": (F.floor("median_stores"), t.ideal_stores),
    }
    return base_profile(clients).select(*[F.coalesce(c, F.lit(d).cast(_kind(n))).alias(n) for n, (c, d) in learned.items()])


def threshold_row_by_selection(clients: DataFrame) -> DataFrame:
    """The same row for a base of any size: medians by distributed selection, in bounded memory."""
    t = Thresholds()
    known = clients.select(falsy_to("pvp_suits_eur", None).alias("price"), F.col("store_count").alias("stores"))
    price = quantiles(known, [], "price", {"median_price": 0.5})
    stores = quantiles(known, [], "stores", {"median_stores": 0.5})
    limits = known.agg(F.min("price").alias("min_price"), F.max("stores").alias("max_stores"))
    row = limits.select("*", price.select("median_price").scalar().alias("median_price"), stores.select("median_stores").scalar().alias("median_stores"))
    learned = {
        "min_price": (F.col("min_price"), t.min_price), "max_stores": (F.col("max_stores"), t.max_stores),
        "ideal_price": (F.floor("median_price"), t.ideal_price), "ideal_stores": (F.floor("median_stores"), t.ideal_stores),
    }
    return row.select(*[F.coalesce(c, F.lit(d).cast(_kind(n))).alias(n) for n, (c, d) in learned.items()])


def _kind(name: str) -> str:
    return {"min_price": "double", "max_stores": "int"}.get(name, "bigint")


def learned_thresholds(clients: DataFrame) -> Thresholds:
    """Scoring limits taken from the client base: one aggregate row."""
    r = threshold_row(clients).first()
    return Thresholds(r["min_price"], r["max_stores"], r["ideal_price"], r["ideal_stores"])


def profile_summary(clients: DataFrame) -> DataFrame:
    """Ranges and means that skip unknown (0 or missing) values."""
    stores, price = falsy_to("store_count", None), falsy_to("pvp_suits_eur", None)
    years = falsy_to("years_as_client", None)

    def or_zero(c: Column) -> Column:
        return F.coalesce(c, F.lit(0))

    return clients.agg(
        F.count("*").alias("total"),
        or_zero(F.min(stores)).alias("min_stores"), or_zero(F.max(stores)).alias("max_stores"),
        or_zero(F.avg(stores)).alias("avg_stores"),
        or_zero(F.min(price)).alias("min_price"), or_zero(F.max(price)).alias("max_price"),
        or_zero(F.avg(price)).alias("avg_price"),
        F.count_if(F.col("made_to_measure")).alias("mtm_count"),
        F.count_if(F.col("wool_percentage") == "100%").alias("wool_100_count"),
        or_zero(F.avg(years)).alias("avg_years"),
    )


def portfolio_counts(clients: DataFrame, loyal_years: int = 5) -> DataFrame:
    return clients.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("tier") == t).alias(t) for t in TIERS],
        F.count_if(F.col("brand_type") == "own_brand").alias("own_brand"),
        F.count_if(F.col("brand_type") == "multibrand").alias("multibrand"),
        F.count_if(F.coalesce("years_as_client", F.lit(0)) >= loyal_years).alias("long_term"),
    )
