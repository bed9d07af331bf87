"""Filtered, sorted and paged listings of prospects, one row per domain."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.exprs import BLANKS
from leadloom.operators.common import pg_order, top_per_key
from leadloom.schemas import STATUSES

# Columns that may be sorted by, named ranges, presets.
SORTABLE = (
    "final_score", "store_count", "avg_suit_price_eur", "discovered_at", "name", "quality_score",
    "similarity_score",
)
STORE_SIZES = {"all": (None, None), "boutique": (1, 5), "medium": (6, 20), "large": (21, None)}
PRICE_RANGES = {
    "all": (None, None),
    "under_500": (0.01, 499.99),
    "500_1000": (500, 999.99),
    "1000_2000": (1000, 1999.99),
    "over_2000": (2000, None),
}
EUR_USD = 1.08


def _text(value: str | None) -> str | None:
    """An empty filter is no filter."""
    return value or None


@dataclass(frozen=True)
class ProspectFilter:
    """Optional criteria (all must hold), order and page."""

    city: str | None = None
    country: str | None = None
    country_code: str | None = None
    min_stores: int | None = None
    max_stores: int | None = None
    min_price: float | None = None
    max_price: float | None = None
    min_score: float | None = None
    max_score: float | None = None
    min_quality_score: float | None = None
    min_similarity_score: float | None = None
    status: str | None = None
    statuses: Sequence[str] = field(default_factory=tuple)
    brand_style: str | None = None
    brand_styles: Sequence[str] = field(default_factory=tuple)
    business_model: str | None = None
    made_to_measure: str | None = None
    search_name: str | None = None
    similar_to_client: str | None = None
    sort_by: str = "final_score"
    sort_order: str = "desc"
    limit: int = 25
    offset: int = 0

    def __post_init__(self) -> None:
        for name in ("min_stores", "max_stores", "min_price", "max_price"):
            v = getattr(self, name)
            if v is not None and v < 0:
                raise ValueError(f"{name} must not be negative")
        for name in ("min_score", "max_score", "min_quality_score", "min_similarity_score"):
            v = getattr(self, name)
            if v is not None and not 0 <= v <= 100:
                raise ValueError(f"{name} must lie in 0..100")
        if not 1 <= self.limit <= 100:
            raise ValueError("limit must lie in 1..100")
        if self.offset < 0:
            raise ValueError("offset must not be negative")
        for s in (self.status, *self.statuses):
            if s and s not in STATUSES:
                raise ValueError(f"unknown status {s!r}")

    @property
    def sort_column(self) -> str:
        return self.sort_by if self.sort_by in SORTABLE else "final_score"

    @property
    def descending(self) -> bool:
        return self.sort_order.lower() == "desc"

    def predicates(self) -> list[Column]:
        """The criteria as columns; plain comparisons reach the Parquet scan."""
        out: list[Column] = []

        def equal(column: str, value: str | None) -> None:
            if _text(value):
                out.append(F.col(column) == value)

        def between(column: str, low, high) -> None:
            if low is not None:
                out.append(F.col(column) >= low)
            if high is not None:
                out.append(F.col(column) <= high)

        def like(column: str, value: str | None) -> None:
            if _text(value):
                literal = value.lower().replace("\\", "\\\\")  # a backslash is no escape here
                out.append(F.lower(F.col(column)).like(f"%{literal}%"))

        def one_of(column: str, value: str | None, values: Sequence[str]) -> None:
            if _text(value):
                out.append(F.col(column) == value)
            elif values:
                out.append(F.col(column).isin(list(values)))

        equal("city", self.city.lower().strip(BLANKS) if self.city else None)
        like("country", self.country)
        equal("country_code", self.country_code.upper() if self.country_code else None)
        between("store_count", self.min_stores, self.max_stores)
        between("avg_suit_price_eur", self.min_price, self.max_price)
        between("final_score", self.min_score, self.max_score)
        between("quality_score", self.min_quality_score, None)
        between("similarity_score", self.min_similarity_score, None)
        one_of("status", self.status, self.statuses)
        one_of("brand_style", self.brand_style, self.brand_styles)
        flag = (self.made_to_measure or "").lower()
        if flag in ("true", "false"):
            out.append(F.col("made_to_measure") == F.lit(flag == "true"))
        like("name", self.search_name)
        equal("business_model", self.business_model)
        like("most_similar_client", self.similar_to_client)
        return out

    def with_store_size(self, name: str) -> "ProspectFilter":
        low, high = STORE_SIZES[name]
        return replace(self, min_stores=low, max_stores=high)

    def with_price_range(self, name: str) -> "ProspectFilter":
        low, high = PRICE_RANGES[name]
        return replace(self, min_price=low, max_price=high)


# Canned searches.
PRESETS = {
    "ideal_boutiques": ProspectFilter(max_stores=5, min_score=70),
    "luxury_only": ProspectFilter(min_price=2000),
}


def matching(prospects: DataFrame, f: ProspectFilter) -> DataFrame:
    ps = f.predicates()
    return prospects.filter(reduce(lambda a, b: a & b, ps)) if ps else prospects


def best_per_domain(prospects: DataFrame, f: ProspectFilter = ProspectFilter()) -> DataFrame:
    """The row of each domain that sorts first; the id breaks ties."""
    order = [pg_order(f.sort_column, f.descending), F.col("id")]
    return top_per_key(matching(prospects, f), ["domain"], order)


def search(prospects: DataFrame, f: ProspectFilter = ProspectFilter()) -> DataFrame:
    """One page: filter, one row per domain, sort (the domain breaks ties), offset and limit.

    The filter runs before the choice per domain; the page is a top-n per task merged on the driver's
    side (``TakeOrderedAndProject``), never a full sort. Deep pages are better asked for with
    :func:`search_after`, as ``offset + limit`` rows are kept per task here.
    """
    order = [pg_order(f.sort_column, f.descending), F.col("domain")]
    return best_per_domain(prospects, f).orderBy(*order).offset(f.offset).limit(f.limit)


def search_after(prospects: DataFrame, f: ProspectFilter, last_value, last_domain: str) -> DataFrame:
    """The page that follows a row with this sort value and domain, for pages however deep.

    The rows before it are filtered away instead of being kept and skipped, so a task holds one page only; the
    filter's own offset does not count. Nulls are the largest value, as in :func:`search`.
    """
    value, domain = F.col(f.sort_column), F.col("domain")
    if last_value is None:
        after = value.isNull() & (domain > last_domain)
        after = after | value.isNotNull() if f.descending else after
    else:
        beyond = (value < last_value) if f.descending else ((value > last_value) | value.isNull())
        after = beyond | ((value == last_value) & (domain > last_domain))
    order = [pg_order(f.sort_column, f.descending), domain]
    return best_per_domain(prospects, f).filter(F.coalesce(after, F.lit(False))).orderBy(*order).limit(f.limit)


def page_info(prospects: DataFrame, f: ProspectFilter = ProspectFilter()) -> DataFrame:
    """Number of matching domains and what the page shows of them, as one row."""
    total = matching(prospects, f).agg(F.count_distinct("domain").alias("total_count"))
    left = F.greatest(F.col("total_count") - f.offset, F.lit(0))
    return total.select(
        "total_count",
        F.least(left, F.lit(f.limit)).alias("returned_count"),
        F.lit(f.limit).alias("limit"),
        F.lit(f.offset).alias("offset"),
        (F.lit(f.offset) + F.least(left, F.lit(f.limit)) < F.col("total_count")).alias("has_more"),
    )


def listing(prospects: DataFrame, limit: int, city: str | None = None) -> DataFrame:
    """The first ``limit`` domains *in domain order*, each with its best scored row."""
    rows = prospects.filter(F.col("city") == city.lower().strip(BLANKS)) if city else prospects
    best = top_per_key(rows, ["domain"], [pg_order("final_score", True), F.col("id")])
    return best.orderBy("domain").limit(limit)


def by_id(prospects: DataFrame, prospect_id: str | Column) -> DataFrame:
    return prospects.filter(F.col("id") == prospect_id)


def preset(prospects: DataFrame, name: str, **page) -> DataFrame:
    return search(prospects, replace(PRESETS[name], **page))


def currency_filter(
    records: DataFrame, min_stores: int | None = None, max_stores: int | None = None,
    min_price_eur: float | None = None, max_price_eur: float | None = None, rate: float = EUR_USD,
) -> DataFrame:
    """Euro bounds against dollar prices; an unknown price never meets a price bound."""
    out = records
    stores = F.coalesce("store_count", F.lit(0))
    price = F.coalesce("average_suit_price_usd", F.lit(0.0))
    if min_stores is not None:
        out = out.filter(stores >= min_stores)
    if max_stores is not None:
        out = out.filter(stores <= max_stores)
    if min_price_eur is not None or max_price_eur is not None:
        out = out.filter(price != 0)
    if min_price_eur is not None:
        out = out.filter(price >= F.lit(min_price_eur) * F.lit(rate))
    if max_price_eur is not None:
        out = out.filter(price <= F.lit(max_price_eur) * F.lit(rate))
    return out


def size_totals(prospects: DataFrame, small: int = 5, medium: int = 20) -> DataFrame:
    """Distinct domains in all, with a small shop, with a medium one.

    Reduced to one flag row per domain first: one shuffle and no row expansion per distinct count.
    """
    s = F.col("store_count")
    per_domain = prospects.groupBy("domain").agg(
        F.bool_or(s <= small).alias("is_small"),
        F.bool_or((s > small) & (s <= medium)).alias("is_medium"),
    )
    return per_domain.agg(
        F.count("domain").alias("total"),
        F.count_if(F.col("is_small") & F.col("domain").isNotNull()).alias("boutique"),
        F.count_if(F.col("is_medium") & F.col("domain").isNotNull()).alias("medium"),
    )
