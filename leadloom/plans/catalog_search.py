"""Registered listings (Q) and statistics (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.operators import analytics, clients, search, trigrams
from leadloom.operators.quantiles import quantiles
from leadloom.operators.search import ProspectFilter
from leadloom.plans.registry import Inputs, query
from leadloom.sizing import work_folder

ROW = ["id", "domain", "city", "name", "store_count", "avg_suit_price_eur", "final_score", "status"]
COLS = ", ".join(ROW)


def _page(where: str, sort: str, inner: str, limit: int, offset: int = 0, view: str = "{prospects}") -> str:
    return f"""SELECT {COLS} FROM (
 SELECT *, row_number() OVER (PARTITION BY domain ORDER BY {inner}, id) AS rn FROM {view} WHERE {where}) WHERE rn = 1
ORDER BY {sort}, domain LIMIT {limit} OFFSET {offset}"""


@query("q1_by_city", f"""SELECT {COLS} FROM (
 SELECT *, row_number() OVER (PARTITION BY domain ORDER BY final_score DESC NULLS FIRST, id) AS rn
 FROM {{prospects}} WHERE city = 'nation_7') WHERE rn = 1 ORDER BY domain LIMIT 25""")
def _(v: Inputs):
    return search.listing(v.prospects, 25, " Nation_7 ").select(ROW)


@query("q2_all", f"""SELECT {COLS} FROM (
 SELECT *, row_number() OVER (PARTITION BY domain ORDER BY final_score DESC NULLS FIRST, id) AS rn
 FROM {{prospects}}) WHERE rn = 1 ORDER BY domain LIMIT 100""")
def _(v: Inputs):
    return search.listing(v.prospects, 100).select(ROW)


FILTER = ProspectFilter(
    country="nation_1", min_stores=1, max_stores=20, min_price=200, max_price=2400, min_score=10,
    max_score=95, statuses=("new", "contacted"), made_to_measure="true", limit=50, offset=20,
)
WHERE = """lower(country) LIKE '%nation_1%' AND store_count >= 1 AND store_count <= 20
 AND avg_suit_price_eur >= 200 AND avg_suit_price_eur <= 2400 AND final_score >= 10 AND final_score <= 95
 AND status IN ('new','contacted') AND made_to_measure"""


@query("q3_search", _page(WHERE, "final_score DESC NULLS FIRST", "final_score DESC NULLS FIRST", 50, 20))
def _(v: Inputs):
    return search.search(v.prospects, FILTER).select(ROW)


@query("q3_best_per_domain", f"""SELECT {COLS} FROM (
 SELECT *, row_number() OVER (PARTITION BY domain ORDER BY final_score DESC NULLS FIRST, id) AS rn FROM {{prospects}}) WHERE rn = 1""")
def _(v: Inputs):
    return search.best_per_domain(v.prospects).select(ROW)


PRICE_SORT = ProspectFilter(sort_by="avg_suit_price_eur", sort_order="desc", limit=100, offset=30)


@query("q3_sort_price_desc", _page(
    "true", "avg_suit_price_eur DESC NULLS FIRST", "avg_suit_price_eur DESC NULLS FIRST", 100, 30))
def _(v: Inputs):
    return search.search(v.prospects, PRICE_SORT).select(ROW)


@query("q3_sort_price_asc", _page(
    "true", "avg_suit_price_eur ASC NULLS LAST", "avg_suit_price_eur ASC NULLS LAST", 100))
def _(v: Inputs):
    f = ProspectFilter(sort_by="avg_suit_price_eur", sort_order="asc", limit=100)
    return search.search(v.prospects, f).select(ROW)


@query("q4_text_predicates", f"""SELECT {COLS}, similarity_score FROM {{stored_rows}}
WHERE country_code = 'ES' AND lower(name) LIKE '%brand _2%' AND lower(most_similar_client) LIKE '%#1%'
 AND brand_style IN ('machinery','automobile') AND business_model = 'Retail' AND quality_score >= 20 AND similarity_score >= 2
 AND NOT made_to_measure""")
def _(v: Inputs):
    f = ProspectFilter(
        country_code="es", search_name="Brand _2", similar_to_client="#1", status="",
        brand_styles=("machinery", "automobile"), business_model="Retail", min_quality_score=20,
        min_similarity_score=2, made_to_measure="False",
    )
    return search.matching(v.stored_rows, f).select(*ROW, "similarity_score")


def _indexed(v: Inputs, f: ProspectFilter):
    path = work_folder(v.spark, "trigrams")
    trigrams.store_indexed(v.stored_rows, path, block_rows=2_000)
    return trigrams.indexed_matching(v.spark, path, f).select(*ROW, "most_similar_client")


@query("q4_trigram_name", f"""SELECT {COLS}, most_similar_client FROM {{stored_rows}}
WHERE lower(name) LIKE '%rand 12%' AND lower(most_similar_client) LIKE '%#1%'""")
def _(v: Inputs):
    return _indexed(v, ProspectFilter(search_name="RAND 12", similar_to_client="#1"))


@query("q4_trigram_fallback", f"""SELECT {COLS}, most_similar_client FROM {{stored_rows}}
WHERE lower(name) LIKE '%brand _2%' AND store_count >= 3""")
def _(v: Inputs):
    return _indexed(v, ProspectFilter(search_name="Brand _2", min_stores=3))


@query("q5_sort_unknown", _page("true", "final_score ASC NULLS LAST", "final_score ASC NULLS LAST", 40))
def _(v: Inputs):
    f = ProspectFilter(sort_by="drop table", sort_order="up", limit=40)
    return search.search(v.prospects, f).select(ROW)


@query("q5_sort_name", _page("true", "name DESC NULLS FIRST", "name DESC NULLS FIRST", 40))
def _(v: Inputs):
    return search.search(v.prospects, ProspectFilter(sort_by="name", limit=40)).select(ROW)


@query("q6_page_info", f"""SELECT n AS total_count, greatest(least(n - 20, 50), 0) AS returned_count,
 50 AS "limit", 20 AS "offset", 20 + greatest(least(n - 20, 50), 0) < n AS has_more
FROM (SELECT count(DISTINCT domain) AS n FROM {{prospects}} WHERE {WHERE})""")
def _(v: Inputs):
    return search.page_info(v.prospects, FILTER)


@query("q7_by_id", f"SELECT {COLS} FROM {{prospects}} WHERE id = (SELECT max(id) FROM {{prospects}})")
def _(v: Inputs):
    return search.by_id(v.prospects, v.prospects.agg(F.max("id")).scalar()).select(ROW)


@query("q8_ideal_boutiques", _page(
    "store_count <= 5 AND final_score >= 70", "final_score DESC NULLS FIRST", "final_score DESC NULLS FIRST", 25))
def _(v: Inputs):
    return search.preset(v.prospects, "ideal_boutiques").select(ROW)


@query("q8_luxury_only", _page(
    "avg_suit_price_eur >= 2000", "final_score DESC NULLS FIRST", "final_score DESC NULLS FIRST", 100))
def _(v: Inputs):
    return search.preset(v.prospects, "luxury_only", limit=100).select(ROW)


@query("q9_buckets", f"""SELECT {COLS} FROM {{prospects}}
WHERE store_count >= 6 AND store_count <= 20 AND avg_suit_price_eur >= 500 AND avg_suit_price_eur <= 999.99""")
def _(v: Inputs):
    f = ProspectFilter().with_store_size("medium").with_price_range("500_1000")
    return search.matching(v.prospects, f).select(ROW)


@query("q10_currency_filter", """SELECT id, store_count, coalesce(avg_suit_price_eur, 0) * 1.08::DOUBLE AS average_suit_price_usd
FROM {prospects} WHERE store_count >= 2 AND store_count <= 12 AND coalesce(avg_suit_price_eur, 0) <> 0
 AND coalesce(avg_suit_price_eur, 0) * 1.08::DOUBLE >= 400 * 1.08::DOUBLE AND coalesce(avg_suit_price_eur, 0) * 1.08::DOUBLE <= 1500 * 1.08::DOUBLE""")
def _(v: Inputs):
    rows = v.prospects.select(
        "id", "store_count",
        (F.coalesce("avg_suit_price_eur", F.lit(0.0)) * 1.08).alias("average_suit_price_usd"),
    )
    return search.currency_filter(rows, 2, 12, 400, 1500)


@query("q11_size_totals", """SELECT count(DISTINCT domain) AS total,
 count(DISTINCT CASE WHEN store_count <= 5 THEN domain END) AS boutique,
 count(DISTINCT CASE WHEN store_count >= 6 AND store_count <= 20 THEN domain END) AS medium FROM {prospects}""")
def _(v: Inputs):
    return search.size_totals(v.prospects)


CLIENT = "client_id, name, country_code, tier, years_as_client"


@query("q12_client_selection", f"""SELECT {CLIENT} FROM {{clients}}
WHERE tier = 'high_value' AND country_code = 'GB' AND brand_type = 'own_brand' AND years_as_client >= 5""")
def _(v: Inputs):
    return clients.select_clients(v.clients, "high_value", "GB", "own_brand", 5).select(*CLIENT.split(", "))


@query("q13_top_clients", f"SELECT {CLIENT} FROM {{clients}} ORDER BY years_as_client DESC, client_id LIMIT 10")
def _(v: Inputs):
    return clients.top_clients(v.clients, 10).select(*CLIENT.split(", "))


@query("q14_example_clients", """SELECT client_id, CAST(CASE tier WHEN 'high_value' THEN 0 WHEN 'medium_value' THEN 1 ELSE 2 END AS INTEGER) AS tier_rank,
 name || ' (' || country || ') | ' || store_count || ' | '
 || CASE WHEN coalesce(pvp_suits_eur, 0) <> 0 THEN '€' || CAST(CAST(pvp_suits_eur AS BIGINT) AS VARCHAR) ELSE 'N/A' END
 || ' | ' || CASE WHEN made_to_measure THEN 'Sim' ELSE 'Não' END AS example
FROM {clients} ORDER BY tier_rank, years_as_client DESC, client_id LIMIT 20""")
def _(v: Inputs):
    return clients.example_clients(v.clients, 20).select("client_id", "tier_rank", "example")


# ---------------------------------------------------------------- statistics


@query("a1_facets", """SELECT DISTINCT 'status' AS facet, status AS "value" FROM {prospects} WHERE status IS NOT NULL
UNION ALL SELECT DISTINCT 'brand_style', brand_style FROM {prospects} WHERE brand_style <> 'unknown'
UNION ALL SELECT DISTINCT 'country', country FROM {prospects} WHERE country <> 'Unknown'
UNION ALL SELECT DISTINCT 'city', city FROM {prospects}""")
def _(v: Inputs):
    return analytics.facets(v.prospects)


@query("a2_facet_ranges", """SELECT coalesce(nullif(min(avg_suit_price_eur), 0), 0) AS min_price,
 coalesce(nullif(max(avg_suit_price_eur), 0), 5000) AS max_price,
 coalesce(nullif(min(store_count), 0), 0) AS min_stores, coalesce(nullif(max(store_count), 0), 100) AS max_stores,
 coalesce(nullif(min(final_score), 0), 0) AS min_score, coalesce(nullif(max(final_score), 0), 100) AS max_score
FROM {prospects}""")
def _(v: Inputs):
    return analytics.facet_ranges(v.prospects)


# Lower bounds and labels of the price and size brackets.
_PRICE_BRACKETS = "VALUES (0, '< 500€'), (500, '500€ - 1000€'), (1000, '1000€ - 2000€'), (2000, '> 2000€')"
_SIZE_BRACKETS = "VALUES (1, 'Boutique (1-5)'), (6, 'Medium (6-20)'), (21, 'Retailer (20+)')"


def _bracketed(column: str, brackets: str) -> str:
    """Rows with a positive value, each under the bracket with the largest lower bound that it reaches."""
    return f"""SELECT label AS bracket, count(*) AS "count", avg(final_score) AS avg_score
FROM (SELECT {column} AS x, final_score FROM {{prospects}} WHERE {column} > 0) rows
ASOF JOIN ({brackets}) brackets(low, label) ON rows.x >= brackets.low GROUP BY label"""


@query("a3_price_distribution", _bracketed("avg_suit_price_eur", _PRICE_BRACKETS))
def _(v: Inputs):
    return analytics.price_distribution(v.prospects)


@query("a4_price_stats", """SELECT list_min(known) AS min_price, list_max(known) AS max_price, list_avg(known) AS avg_price
FROM (SELECT list_filter(list(avg_suit_price_eur), lambda p: p > 0) AS known FROM {prospects})""")
def _(v: Inputs):
    return analytics.price_stats(v.prospects)


@query("a5_store_distribution", _bracketed("store_count", _SIZE_BRACKETS))
def _(v: Inputs):
    return analytics.store_distribution(v.prospects)


@query("a6_dashboard", """SELECT 'total' AS section, 'prospects' AS "key", count(*) AS "count" FROM {prospects}
UNION ALL SELECT 'status', status, count(*) FROM {prospects} GROUP BY status
UNION ALL SELECT 'score', CASE WHEN final_score >= 80 THEN 'excellent' WHEN final_score >= 65 THEN 'good'
 WHEN final_score >= 50 THEN 'average' ELSE 'low' END, count(*) FROM {prospects} GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'city', city, count(*) AS n FROM {prospects} GROUP BY city ORDER BY n DESC, city LIMIT 10)""")
def _(v: Inputs):
    return analytics.dashboard(v.prospects)


@query("a7_city_stats", """SELECT city, n AS total_prospects,
 CAST(CASE WHEN 2 * r > n THEN q + 1 WHEN 2 * r = n THEN q + q % 2 ELSE q END AS DOUBLE) / 100 AS avg_score, top_score
FROM (SELECT city, count(*) AS n, CAST((sum(final_score) * 100) // count(*) AS BIGINT) AS q,
 CAST((sum(final_score) * 100) % count(*) AS BIGINT) AS r, max(final_score) AS top_score FROM {prospects} GROUP BY city)""")
def _(v: Inputs):
    return analytics.city_stats(v.prospects)


@query("a8_city_rollup", """SELECT city, count(*) AS total_prospects, avg(final_score) AS avg_score, max(final_score) AS top_score,
 count(*) FILTER (status = 'new') AS new_count, count(*) FILTER (status = 'contacted') AS contacted_count,
 count(*) FILTER (status = 'converted') AS converted_count FROM {prospects} GROUP BY city ORDER BY 2 DESC, 1""")
def _(v: Inputs):
    return analytics.city_rollup(v.prospects)


@query("a9_market_strength", "SELECT country_code, clients, share FROM {o_market}")
def _(v: Inputs):
    return clients.market_strength(v.clients)


_PROFILE = """count(*) AS clients, count(nullif(pvp_suits_eur, 0)) AS with_price,
 min(nullif(pvp_suits_eur, 0)) AS min_price, max(nullif(pvp_suits_eur, 0)) AS max_price,
 avg(nullif(pvp_suits_eur, 0)) AS mean_price, quantile_cont(nullif(pvp_suits_eur, 0), 0.5) AS median_price,
 min(store_count) AS min_stores, max(store_count) AS max_stores, avg(store_count) AS mean_stores,
 CAST(quantile_cont(store_count, 0.5) AS DOUBLE) AS median_stores"""


@query("a10_base_profile", f"""SELECT {_PROFILE},
 count(*) FILTER (store_count < 5) AS stores_below_5, count(*) FILTER (store_count BETWEEN 5 AND 10) AS stores_5_10,
 count(*) FILTER (store_count BETWEEN 11 AND 20) AS stores_11_20, count(*) FILTER (store_count > 20) AS stores_above_20,
 count(*) FILTER (wool_percentage = '100%')::DOUBLE / count(*) * 100 AS wool_share,
 count(*) FILTER (made_to_measure)::DOUBLE / count(*) * 100 AS mtm_share,
 count(*) FILTER (NOT made_to_measure)::DOUBLE / count(*) * 100 AS no_mtm_share,
 count(*) FILTER (brand_type = 'own_brand')::DOUBLE / count(*) * 100 AS own_brand_share,
 count(*) FILTER (brand_type = 'multibrand')::DOUBLE / count(*) * 100 AS multibrand_share,
 count(*) FILTER (tier = 'high_value') AS high_value, count(*) FILTER (tier = 'medium_value') AS medium_value,
 count(*) FILTER (tier = 'low_value') AS low_value,
 min(years_as_client) AS min_years, max(years_as_client) AS max_years, avg(years_as_client) AS mean_years
FROM {{clients}}""")
def _(v: Inputs):
    return clients.base_profile(v.clients)


@query("a10_clients_per_country", "SELECT country_code, clients FROM {o_market}")
def _(v: Inputs):
    return clients.clients_per_country(v.clients)


@query("a11_learned_thresholds", f"""SELECT min_price, max_stores, CAST(floor(median_price) AS BIGINT) AS ideal_price,
 CAST(floor(median_stores) AS BIGINT) AS ideal_stores FROM (SELECT {_PROFILE} FROM {{clients}})""")
def _(v: Inputs):
    return clients.threshold_row(v.clients)


@query("a11_thresholds_by_selection", f"""SELECT min_price, max_stores, CAST(floor(median_price) AS BIGINT) AS ideal_price,
 CAST(floor(median_stores) AS BIGINT) AS ideal_stores FROM (SELECT {_PROFILE} FROM {{clients}})""")
def _(v: Inputs):
    return clients.threshold_row_by_selection(v.clients)


@query("a10_price_quantiles_per_city", """SELECT city, quantile_cont(avg_suit_price_eur, 0.25) AS lower_quartile,
 quantile_cont(avg_suit_price_eur, 0.5) AS median_price, quantile_cont(avg_suit_price_eur, 0.75) AS upper_quartile
FROM {prospects} GROUP BY city""")
def _(v: Inputs):
    return quantiles(v.prospects, ["city"], "avg_suit_price_eur", {"lower_quartile": 0.25, "median_price": 0.5, "upper_quartile": 0.75})


@query("a10_median_order_price_per_status", """SELECT o_orderstatus, quantile_cont(CAST(o_totalprice AS DOUBLE), 0.5) AS median_price,
 quantile_cont(CAST(o_custkey AS DOUBLE), 0.5) AS median_customer FROM orders GROUP BY o_orderstatus""")
def _(v: Inputs):
    price = quantiles(v.orders, ["o_orderstatus"], "o_totalprice", {"median_price": 0.5})
    return price.join(quantiles(v.orders, ["o_orderstatus"], "o_custkey", {"median_customer": 0.5}), "o_orderstatus")


@query("a12_profile_summary", """SELECT count(*) AS total, coalesce(min(nullif(store_count, 0)), 0) AS min_stores,
 coalesce(max(nullif(store_count, 0)), 0) AS max_stores, coalesce(avg(nullif(store_count, 0)), 0) AS avg_stores,
 coalesce(min(nullif(pvp_suits_eur, 0)), 0) AS min_price, coalesce(max(nullif(pvp_suits_eur, 0)), 0) AS max_price,
 coalesce(avg(nullif(pvp_suits_eur, 0)), 0) AS avg_price, count(*) FILTER (made_to_measure) AS mtm_count,
 count(*) FILTER (wool_percentage = '100%') AS wool_100_count, coalesce(avg(nullif(years_as_client, 0)), 0) AS avg_years
FROM {clients}""")
def _(v: Inputs):
    return clients.profile_summary(v.clients)


@query("a13_portfolio_counts", """SELECT count(*) AS total, count(*) FILTER (tier = 'high_value') AS high_value,
 count(*) FILTER (tier = 'medium_value') AS medium_value, count(*) FILTER (tier = 'low_value') AS low_value,
 count(*) FILTER (brand_type = 'own_brand') AS own_brand, count(*) FILTER (brand_type = 'multibrand') AS multibrand,
 count(*) FILTER (years_as_client >= 5) AS long_term FROM {clients}""")
def _(v: Inputs):
    return clients.portfolio_counts(v.clients)


@query("a14_search_costs", """SELECT city, model, n AS n_prospects,
 round(19800 / 1000.0::DOUBLE * i + 2600 / 1000.0::DOUBLE * o + n * (150 / 1000000.0::DOUBLE * 0.02::DOUBLE + 0.6::DOUBLE * i + 0.1::DOUBLE * o), 6) AS total_cost
FROM (SELECT city, count(*) AS n FROM {prospects} GROUP BY city),
 (VALUES ('gpt-5.1', 0.005::DOUBLE, 0.015::DOUBLE), ('gpt-4', 0.03, 0.06), ('gpt-4-turbo', 0.01, 0.03), ('gpt-35-turbo', 0.0015, 0.002),
  ('other', 0.0015, 0.002)) AS p(model, i, o)""")
def _(v: Inputs):
    costs = analytics.search_costs(v.prospects, (*analytics.PRICING, "other"))
    return costs.withColumn("total_cost", F.round("total_cost", 6))


@query("a15_mean_listed_score", """SELECT CAST(round(CAST(sum(final_score) AS DECIMAL(20,8)) / count(*), 1) AS DOUBLE) AS mean_score
FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY final_score DESC NULLS FIRST, id) AS rn FROM {prospects} WHERE city = 'nation_4') WHERE rn = 1""")
def _(v: Inputs):
    return analytics.mean_listed_score(
        search.best_per_domain(v.prospects, ProspectFilter(city="nation_4"))
    )
