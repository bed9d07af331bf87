"""Scores of a prospect: points per feature, hard filters, final score, texts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.exprs import as_col, round_half_up, whole_number_text
from leadloom.operators.similarity import similarity_points
from leadloom.sizing import bounded_broadcast


@dataclass(frozen=True)
class Thresholds:
    """Limits learned from the client base; see ``clients.learned_thresholds``."""

    min_price: float = 375
    max_stores: int = 30
    ideal_price: float = 800
    ideal_stores: int = 4
    capped_score: float = 40


@dataclass(frozen=True)
class Weights:
    """Weights of the documented weighted score."""

    similarity: float = 0.40
    quality: float = 0.35
    market: float = 0.15
    confidence: float = 0.10
    size: float = 0.0


# The second documented weight set.
SIZE_WEIGHTS = Weights(similarity=0.30, quality=0.30, market=0.15, confidence=0.0, size=0.25)

# Steps of points, recommendations and their limits.
GOOD_PRICE = 500
STORE_STEPS = ((10, 20), (20, 10))
RECOMMENDATIONS = (
    (80, "⭐ HIGHLY RECOMMENDED - Ideal boutique partner"),
    (65, "✅ RECOMMENDED - Good potential partner"),
    (50, "⚠️ CONSIDER - Review manually"),
)
LOW_PRIORITY = "❌ LOW PRIORITY - May be too large or not aligned"

STORES, PRICE = "store_count", "avg_suit_price_eur"


def lenient_stores(c: Column | str) -> Column:
    """A store count that may be text: digits only, else 0; a count beyond an integer is the largest one."""
    s = as_col(c).cast("string")
    most = F.lit(2**31 - 1)
    return F.when(s.rlike(r"^[0-9]+$"), F.coalesce(s.try_cast("int"), most)).otherwise(F.lit(0))


def lenient_price(c: Column | str) -> Column:
    """A price that may be text: digits and dots only and a valid number, else 0."""
    s = as_col(c).cast("string")
    number = F.when(s.rlike(r"^[0-9.]*[0-9][0-9.]*$"), s.try_cast("double"))
    return F.coalesce(number, F.lit(0.0))


def rejection_reason(t: Thresholds = Thresholds()) -> Column:
    price, stores = F.col(PRICE), F.coalesce(STORES, F.lit(0))
    return F.when((price > 0) & (price < t.min_price), "price_too_low").when(
        stores > t.max_stores, "too_many_stores"
    )


def price_points(t: Thresholds = Thresholds()) -> Column:
    p = F.col(PRICE)
    return (
        F.when(p.isNull() | (p == 0), 15)
        .when(p >= t.ideal_price, 30)
        .when(p >= GOOD_PRICE, 20)
        .when(p >= t.min_price, 10)
        .otherwise(0)
    )


def size_points(t: Thresholds = Thresholds()) -> Column:
    s = F.coalesce(STORES, F.lit(0))
    points = F.when(s == 0, 25).when(s <= t.ideal_stores, 30)
    for limit, p in STORE_STEPS:
        points = points.when(s <= limit, p)
    return points.when(s <= t.max_stores, 5).otherwise(0)


def wool_points(c: Column | str = "wool_percentage") -> Column:
    w = F.lower(as_col(c))
    return (
        F.when(F.contains(w, F.lit("100")), 15)
        .when(F.contains(w, F.lit("wool")) | F.contains(w, F.lit("lã")), 5)
        .otherwise(0)
    )


def mtm_points(c: Column | str = "made_to_measure") -> Column:
    m = as_col(c)
    return F.when(m.isNull(), 8).when(m, 15).otherwise(5)


def market_points(share: Column | str) -> Column:
    return F.least(F.coalesce(as_col(share), F.lit(0.0)) * F.lit(0.2), F.lit(10.0))


def with_market(prospects: DataFrame, market: DataFrame) -> DataFrame:
    """Look up the country's share of the client base (one row per country)."""
    shares = market.select("country_code", F.col("share").alias("market_share"))
    return prospects.join(bounded_broadcast(shares), "country_code", "left")


def with_similarity(prospects: DataFrame, best: DataFrame, key: str = "domain") -> DataFrame:
    """Attach each prospect's best similarity; ``best`` has one row per ``key``."""
    return prospects.join(best.select(key, "similarity"), key, "left")


def score(prospects: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """All points and the final score as one narrow projection.

    Reads ``similarity`` (percent, null without clients) and ``market_share``.
    """
    sim, market = similarity_points(F.col("similarity")), market_points("market_share")
    base = price_points(t) + size_points(t) + wool_points() + mtm_points()
    total = base + sim + market
    reason = rejection_reason(t)
    return prospects.withColumns(
        {
            "price_score": price_points(t),
            "size_score": size_points(t),
            "wool_score": wool_points(),
            "mtm_score": mtm_points(),
            "similarity_points": round_half_up(sim, 2),
            "market_score": round_half_up(market, 2),
            "rejection_reason": reason,
            "passes_hard_filters": reason.isNull(),
            "final_score": round_half_up(
                F.when(reason.isNull(), total).otherwise(F.least(total, F.lit(t.capped_score))), 2
            ),
        }
    )


def size_category(t: Thresholds = Thresholds()) -> Column:
    s = F.coalesce(STORES, F.lit(0))
    return (
        F.when(s <= t.ideal_stores, "ideal boutique")
        .when(s <= 10, "small chain")
        .when(s <= 20, "medium chain")
        .otherwise("large chain")
    )


def with_texts(prospects: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Wording of the score parts."""
    price, stores = F.col(PRICE), F.coalesce(STORES, F.lit(0))
    return prospects.withColumns(
        {
            "price_text": F.when(
                price > 0, F.concat(F.lit("€"), whole_number_text(price))
            ).otherwise("Unknown"),
            "size_text": F.concat(stores.cast("string"), F.lit(" stores → "), size_category(t)),
            "wool_text": F.coalesce("wool_percentage", F.lit("Unknown")),
            "mtm_text": F.when(F.col("made_to_measure"), "Yes").otherwise("No/Unknown"),
        }
    )


def recommendation(final_score: Column | str) -> Column:
    s = as_col(final_score)
    label = None
    for limit, text in RECOMMENDATIONS:
        label = F.when(s >= limit, text) if label is None else label.when(s >= limit, text)
    return label.otherwise(LOW_PRIORITY)


def match_report(scored: DataFrame, ranked: DataFrame, clients: DataFrame, key: str = "domain") -> DataFrame:
    """Score, recommendation and the best clients of each prospect as an ordered list.

    The list holds at most the ``k`` of the ranking per key.
    """
    who = bounded_broadcast(clients.select("client_id", F.col("name").alias("client")))
    named = ranked.join(who, "client_id")
    lists = named.groupBy(key).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "client", "similarity"))),
            lambda s: F.struct(s["client"].alias("client"), s["similarity"].alias("similarity")),
        ).alias("similar_clients")
    )
    return (
        scored.join(lists, key, "left")
        .withColumn("recommendation", recommendation("final_score"))
    )


# ---------------------------------------------------------------- documented variants


def constraint_reason(min_price: float, max_stores: int, sells_suits: Column) -> Column:
    """User limits: the first one a prospect misses, null when it meets all."""
    return (
        F.when(F.coalesce(F.col(PRICE), F.lit(0.0)) < min_price, "price_below_minimum")
        .when(F.coalesce(F.col(STORES), F.lit(0)) > max_stores, "too_many_stores")
        .when(~F.coalesce(sells_suits, F.lit(False)), "no_suits")
    )


def data_confidence(
    fields: Sequence[str] = ("wool_percentage", "made_to_measure", "brand_style", "business_model"),
) -> Column:
    """Points for completeness; null, 0 price, 0 stores and ``unknown`` count as missing."""

    def missing(c: str) -> Column:
        return F.col(c).isNull() | F.coalesce(F.lower(F.col(c).cast("string")) == "unknown", F.lit(False))

    no_price = F.col(PRICE).isNull() | (F.col(PRICE) == 0)
    no_stores = F.col(STORES).isNull() | (F.col(STORES) == 0)
    count = no_price.cast("int") + no_stores.cast("int")
    for f in fields:
        count = count + missing(f).cast("int")
    return (
        F.when(no_price & no_stores, 20).when(count == 0, 100).when(count <= 2, 70).otherwise(40)
    )


def weighted_score(
    similarity: Column, quality: Column, market: Column, confidence: Column, size: Column | None = None,
    w: Weights = Weights(),
) -> Column:
    total = (
        similarity * w.similarity + quality * w.quality + market * w.market + confidence * w.confidence
    )
    if size is not None:
        total = total + size * w.size
    return round_half_up(total, 2)
