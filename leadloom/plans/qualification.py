"""The whole chain: search hits -> candidates -> page texts -> finalists -> leads -> saved prospects.

Page text crosses the network once, to meet its address. Second pages are fetched only for the keys that some
page asks for; relevance, price and street are read from the text in its own row, and from there on only narrow
rows travel. Nothing is fixed on the way: store count, price, wool, tailoring and country come from the lead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.operators import content, discovery, finalists, geo
from leadloom.operators.scoring import Thresholds, score, with_market
from leadloom.operators.writes import qualify_batch
from leadloom.schemas import LEAD
from leadloom.sizing import bounded_broadcast


def candidate_urls(hits: DataFrame, suppression: DataFrame) -> DataFrame:
    """Discovery part: first queries, no marketplaces, one URL per domain, no opted-out site."""
    return discovery.dedupe_domains(
        discovery.dedupe_urls(discovery.drop_excluded(discovery.first_queries(hits))), suppression
    )


def page_texts(candidates: DataFrame, fetched: DataFrame, targets: DataFrame) -> DataFrame:
    """The text of every candidate from its best source, with the text of its second page appended."""
    chosen = content.extracted(content.choose_source(fetched)).select("url", "content")
    pages = candidates.join(chosen, "url").join(targets.select("page_id", "target_url"), "page_id", "left")
    return content.merge_secondary(pages, chosen).drop("target_url")


def qualify_pages(
    texts: DataFrame, streets: DataFrame, similarity: DataFrame, k: int = content.FINALISTS
) -> DataFrame:
    """Content part: relevance, price and street on the text, then the finalists per city in score order."""
    kept = content.with_average_price(content.relevant(texts))
    located = geo.detect_street(kept, streets).drop("content")
    rated = located.join(similarity, "page_id", "left").withColumn("pos", F.col("rank"))
    return content.select_finalists(rated, k, place="place")


def as_leads(finalist_rows: DataFrame, leads: DataFrame, countries: DataFrame) -> DataFrame:
    """Finalists with what the selection step says of them, in the shape of prospects.

    The price found on the page counts; where there is none, the lead's dollar price is converted.
    """
    said = content.normalize_leads(content.parse_leads(leads, LEAD), keep=("page_id",)).drop("location_quality", "website_url")
    joined = finalist_rows.join(said, "page_id").withColumn(
        "avg_suit_price_eur", F.when(F.col("avg_price") > 0, F.col("avg_price"))
    )
    codes = bounded_broadcast(countries.select(F.col("country").alias("origin_country"), "country_code"))
    known = content.fill_prices(joined).join(codes, "origin_country", "left")
    return geo.with_location(known).select(
        "page_id", "place", "city", "name", F.col("url").alias("website_url"), F.col("origin_country").alias("country"),
        F.coalesce("country_code", F.lit("XX")).alias("country_code"), "store_count", "avg_suit_price_eur",
        "wool_percentage", "made_to_measure", "brand_style", "business_model", "company_overview", "location_score",
        "location_quality", "similarity",
    )


def qualify_cities(
    hits: DataFrame, fetched: DataFrame, targets: DataFrame, leads: DataFrame, countries: DataFrame,
    similarity: DataFrame, suppression: DataFrame, streets: DataFrame, market: DataFrame, existing: DataFrame,
    t: Thresholds = Thresholds(), k: int = content.FINALISTS, order: tuple[str | Column, ...] = ("place",),
) -> DataFrame:
    """From search hits to scored new prospects."""
    texts = page_texts(candidate_urls(hits, suppression), fetched, targets)
    found = as_leads(qualify_pages(texts, streets, similarity, k), leads, countries)
    unique = finalists.dedupe_finalists(found, "place", short_lists=True)
    return qualify_batch(unique, existing, lambda df: score(with_market(df, market), t), list(order))
