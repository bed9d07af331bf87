"""From search orders to one candidate URL per domain."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import keys
from leadloom.functions.exprs import as_col
from leadloom.operators.common import top_per_key
from leadloom.sizing import bounded_broadcast

# The default country and the city names that point to another one, checked in this order.
DEFAULT_COUNTRY = "USA"
CITY_COUNTRY = (
    ("UK", ("london", "manchester", "birmingham")),
    ("France", ("paris", "lyon", "marseille")),
    ("Germany", ("berlin", "munich", "hamburg", "frankfurt")),
    ("Italy", ("milan", "rome", "florence", "naples")),
    ("Spain", ("madrid", "barcelona")),
    ("Portugal", ("lisbon", "porto")),
)

# Search templates, excluded marketplaces, unwanted URL parts.
QUERY_TEMPLATES = (
    "%s luxury menswear boutique premium suits",
    "%s bespoke tailor custom suits high end",
    "%s designer men suits store independent",
)
EXCLUDED_DOMAINS = (
    "amazon.com", "ebay.com", "walmart.com", "target.com", "nordstrom.com", "yelp.com",
)
BAD_URL_PARTS = (
    "/blog", "/news", "/press", "/article", "/about", "/about-us", "/our-story",
    "/contact", "/locations", "/find-us", "facebook.com", "instagram.com", "yelp.com",
)

QUERIES_RUN = 3
CACHE_MIN, CACHE_MAX = 10, 100


def infer_country(city: Column | str, country: Column | str) -> Column:
    """The first rule whose city name occurs in the request; only for the default country."""
    name = F.lower(as_col(city))
    by_city = None
    for label, names in CITY_COUNTRY:
        hit = reduce(lambda a, b: a | b, [F.contains(name, F.lit(n)) for n in names])
        by_city = F.when(hit, label) if by_city is None else by_city.when(hit, label)
    given = as_col(country)
    return F.when(given == DEFAULT_COUNTRY, F.coalesce(by_city, given)).otherwise(given)


def with_country(requests: DataFrame) -> DataFrame:
    return requests.withColumn("country", infer_country("city", "country"))


def generate_queries(requests: DataFrame, templates: Sequence[str] = QUERY_TEMPLATES) -> DataFrame:
    """One row per request and template; a narrow projection, no shuffle."""
    texts = F.array(*[F.format_string(t, F.col("city")) for t in templates])
    return requests.select("*", F.posexplode(texts).alias("query_index", "query"))


def apply_query_edits(queries: DataFrame, edits: DataFrame) -> DataFrame:
    """A reviewer's text replaces the generated one."""
    e = edits.select("request_id", "query_index", "edited")
    return (
        queries.join(e, ["request_id", "query_index"], "left")
        .withColumn("query", F.coalesce("edited", "query"))
        .drop("edited")
    )


def first_queries(results: DataFrame, n: int = QUERIES_RUN) -> DataFrame:
    return results.filter(F.col("query_index") < n)


def drop_excluded(
    results: DataFrame, domains: Sequence[str] = EXCLUDED_DOMAINS, url: str = "url"
) -> DataFrame:
    """Drop a listed site and all its subdomains; the list is a short parameter, so a plain filter."""
    h = keys.host(url)
    bad = reduce(lambda a, b: a | b, [(h == d) | h.endswith("." + d) for d in domains])
    return results.filter(~F.coalesce(bad, F.lit(False)))


def not_blank(url: Column | str) -> Column:
    u = as_col(url)
    return u.isNotNull() & (u != "")


def dedupe_urls(results: DataFrame) -> DataFrame:
    """First hit per city and normalized URL, in (query, rank) order; blank URLs go."""
    keyed = results.filter(not_blank("url")).withColumn("url_key", keys.discovery_url_key("url"))
    return top_per_key(keyed, ["city", "url_key"], ["query_index", "rank"])


def drop_suppressed(results: DataFrame, suppression: DataFrame, domain: str = "domain") -> DataFrame:
    """Anti join on the suppression list; broadcast only while the list is measured to be small."""
    listed = bounded_broadcast(suppression.select(keys.domain_key("domain").alias("listed")).distinct())
    return results.join(listed, keys.domain_key(domain) == F.col("listed"), "left_anti")


def dedupe_domains(results: DataFrame, suppression: DataFrame | None = None) -> DataFrame:
    """One URL per city and domain, suppressed domains left out, then one per normalized URL.

    A domain is suppressed as a whole, so the anti join may run on the first pass's output (one row per
    domain) instead of on all hits. The second pass is needed because the domain keeps its letter case
    while the URL key does not.
    """
    order = ["query_index", "rank"]
    keyed = results.filter(not_blank("url")).withColumn("domain", keys.discovery_domain("url"))
    one = top_per_key(keyed, ["city", "domain"], order)
    if suppression is not None:
        one = drop_suppressed(one, suppression)
    return top_per_key(
        one.withColumn("url_key", keys.discovery_url_key("url")), ["city", "url_key"], order
    )


def discovery_summary(results: DataFrame) -> DataFrame:
    """Hits per query (as delivered) and distinct URLs per city.

    Both sides of the join are aggregates with at most one row per query of a city.
    """
    per_query = results.groupBy("city", "query_index").agg(F.count("*").alias("n_results"))
    per_city = (
        results.filter(not_blank("url"))
        .groupBy("city")
        .agg(F.count_distinct(keys.discovery_url_key("url")).alias("unique_urls"))
    )
    return per_query.join(per_city, "city", "left").select(
        "city", "query_index", "n_results", F.coalesce("unique_urls", F.lit(0)).alias("unique_urls")
    )


def cache_admission(
    wanted: DataFrame, prospects: DataFrame, minimum: int = CACHE_MIN, listing: int = CACHE_MAX,
    force_refresh: bool = False,
) -> DataFrame:
    """Per wanted city: does the store hold enough brands (rule 1), does it hold any (rule 2)."""
    stored = prospects.groupBy("city").agg(F.count_distinct("domain").alias("n"))
    listed = F.least(F.coalesce("n", F.lit(0)), F.lit(listing))
    return (
        wanted.select(keys.city_key("city").alias("city"))
        .distinct()
        .join(stored, "city", "left")
        .select(
            "city",
            listed.alias("listed"),
            (listed >= minimum).alias("enough_stored"),
            (F.col("n").isNotNull() & F.lit(not force_refresh)).alias("served_from_store"),
        )
    )


def approved_only(brands: DataFrame, decisions: DataFrame) -> DataFrame:
    """Keep what a reviewer approved."""
    yes = decisions.filter("approved").select("city", "domain")
    return brands.join(yes, ["city", "domain"], "left_semi")


def best_per_query(
    results: DataFrame, bad_parts: Sequence[str] = BAD_URL_PARTS, k: int = 5
) -> DataFrame:
    """Drop editorial, social and contact pages, then keep the best ranked hits per query."""
    u = F.lower("url")
    bad = reduce(lambda a, b: a | b, [F.contains(u, F.lit(p)) for p in bad_parts])
    return top_per_key(
        results.filter(not_blank("url") & ~bad), ["city", "query_index"], ["rank"], k
    )
