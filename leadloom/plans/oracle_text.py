"""SQL fragments shared by the oracles. Independent of the Spark expressions they check."""

from __future__ import annotations

from leadloom.sources.fixtures import ORACLE_VIEWS


def half_up(x: str, places: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(18,8)), {places}) AS DOUBLE)"


def k1(u: str) -> str:
    s = f"regexp_replace(regexp_replace(trim(lower({u})), '^https?://', ''), '^www\\.', '')"
    return f"split_part(split_part(rtrim({s}, '/'), '?', 1), '#', 1)"


def k2(u: str) -> str:
    s = f"replace(replace(replace(trim(lower({u})), 'https://', ''), 'http://', ''), 'www.', '')"
    return f"split_part(split_part(rtrim({s}, '/'), '?', 1), '#', 1)"


def k3(u: str) -> str:
    a = f"regexp_extract(trim({u}), '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1)"
    return f"regexp_replace({a}, '^www\\.', '')"


def k4(u: str) -> str:
    return f"split_part({k2(u)}, '/', 1)"


def first_per(view: str, keys: str, order: str, where: str = "true", extra: str = "") -> str:
    return (
        f"SELECT * FROM (SELECT *{extra}, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn "
        f"FROM {view} WHERE {where}) WHERE rn = 1"
    )


PRICE_POINTS = """CASE WHEN avg_suit_price_eur IS NULL OR avg_suit_price_eur = 0 THEN 15
 WHEN avg_suit_price_eur >= 800 THEN 30 WHEN avg_suit_price_eur >= 500 THEN 20
 WHEN avg_suit_price_eur >= 375 THEN 10 ELSE 0 END"""
SIZE_POINTS = """CASE WHEN store_count = 0 THEN 25 WHEN store_count <= 4 THEN 30 WHEN store_count <= 10 THEN 20
 WHEN store_count <= 20 THEN 10 WHEN store_count <= 30 THEN 5 ELSE 0 END"""
WOOL_POINTS = """CASE WHEN wool_percentage LIKE '%100%' THEN 15
 WHEN lower(wool_percentage) LIKE '%wool%' OR lower(wool_percentage) LIKE '%lã%' THEN 5 ELSE 0 END"""
MTM_POINTS = "CASE WHEN made_to_measure IS NULL THEN 8 WHEN made_to_measure THEN 15 ELSE 5 END"
REASON = """CASE WHEN avg_suit_price_eur > 0 AND avg_suit_price_eur < 375 THEN 'price_too_low'
 WHEN store_count > 30 THEN 'too_many_stores' END"""
SIM_POINTS = "CASE WHEN similarity IS NULL THEN 5.0::DOUBLE ELSE least(similarity * 0.1::DOUBLE, 10.0::DOUBLE) END"
MARKET_POINTS = "least(coalesce(share, 0.0::DOUBLE) * 0.2::DOUBLE, 10.0::DOUBLE)"
RECOMMENDATION = """CASE WHEN final_score >= 80 THEN '⭐ HIGHLY RECOMMENDED - Ideal boutique partner'
 WHEN final_score >= 65 THEN '✅ RECOMMENDED - Good potential partner'
 WHEN final_score >= 50 THEN '⚠️ CONSIDER - Review manually'
 ELSE '❌ LOW PRIORITY - May be too large or not aligned' END"""

TOTAL = f"({PRICE_POINTS} + {SIZE_POINTS} + {WOOL_POINTS} + {MTM_POINTS}) + {SIM_POINTS} + {MARKET_POINTS}"


def scored(view: str) -> str:
    """Scored rows of a prospect-like view, via best similarity per domain and share per country."""
    return f"""SELECT p.* EXCLUDE (final_score), similarity, share,
 {PRICE_POINTS} AS price_score, {SIZE_POINTS} AS size_score, {WOOL_POINTS} AS wool_score,
 {MTM_POINTS} AS mtm_score, {half_up(SIM_POINTS, 2)} AS similarity_points,
 {half_up(MARKET_POINTS, 2)} AS market_score, {REASON} AS rejection_reason,
 {REASON} IS NULL AS passes_hard_filters,
 {half_up(f"CASE WHEN {REASON} IS NULL THEN {TOTAL} ELSE least({TOTAL}, 40.0::DOUBLE) END", 2)} AS final_score
FROM {view} p LEFT JOIN (SELECT domain, similarity FROM {{o_ranked}} JOIN {{brand_vectors}} USING (vec_id) WHERE rank = 1) b USING (domain)
LEFT JOIN (SELECT country_code, share FROM {{o_market}}) m USING (country_code)"""


ORACLE_VIEWS.update(
    {
        "o_market": """
SELECT country_code, count(*) AS clients,
 CAST(count(*) AS DOUBLE) / CAST((SELECT count(*) FROM {clients}) AS DOUBLE) * 100 AS share
FROM {clients} GROUP BY country_code""",
        "o_pairs": """
SELECT vec_id, client_id,
 list_cosine_similarity(CAST(b.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS cosine
FROM {brand_vectors} b CROSS JOIN {client_vectors} c""",
        "o_ranked": """
SELECT * FROM (SELECT vec_id, client_id, cosine, round(cosine * 100, 2) AS similarity,
 CAST(row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, client_id) AS INTEGER) AS rank
 FROM {o_pairs}) WHERE rank <= 10""",
        "o_scored": scored("{prospects}"),
        "o_scored_candidates": scored("{candidates}"),
        "o_new_candidates": f"""
SELECT s.* FROM ({first_per("{o_scored_candidates}", "city, domain", "seq")}) s
ANTI JOIN {{prospects}} e ON s.city = e.city AND s.domain = e.domain""",
    }
)
