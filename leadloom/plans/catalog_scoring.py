"""Registered scoring (G) and enrichment joins (E)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from leadloom.functions import keys, text
from leadloom.functions.exprs import round_half_up
from leadloom.operators import client_blocks, clients, geo, neighbour_graph, scoring, similarity, writes
from leadloom.plans import oracle_text as o
from leadloom.plans.registry import Inputs, query

POINTS = ["id", "price_score", "size_score", "wool_score", "mtm_score", "similarity_points", "market_score",
          "rejection_reason", "passes_hard_filters", "final_score"]


def ranked(v: Inputs, k: int = 10):
    return similarity.top_similar(v.brand_vectors, v.client_vectors, k)


def best_by_domain(v: Inputs):
    best = ranked(v, 1).select("vec_id", "similarity")
    return best.join(v.brand_vectors.select("vec_id", "domain"), "vec_id").select("domain", "similarity")


def scored(v: Inputs, rows):
    """Prospect rows with similarity of their brand, market share and all scores."""
    with_all = scoring.with_market(
        scoring.with_similarity(rows, best_by_domain(v)), clients.market_strength(v.clients)
    )
    return scoring.score(with_all)


@query("g1_hard_filters", f"SELECT id, {o.REASON} AS rejection_reason, {o.REASON} IS NULL AS passes FROM {{prospects}}")
def _(v: Inputs):
    reason = scoring.rejection_reason()
    return v.prospects.select("id", reason.alias("rejection_reason"), reason.isNull().alias("passes"))


@query("g2_g5_points", f"""SELECT id, {o.PRICE_POINTS} AS price_score, {o.SIZE_POINTS} AS size_score,
 {o.WOOL_POINTS} AS wool_score, {o.MTM_POINTS} AS mtm_score FROM {{prospects}}""")
def _(v: Inputs):
    return v.prospects.select(
        "id", scoring.price_points().alias("price_score"), scoring.size_points().alias("size_score"),
        scoring.wool_points().alias("wool_score"), scoring.mtm_points().alias("mtm_score"),
    )


@query("g6_final_score", f"SELECT {', '.join(POINTS)} FROM {{o_scored}}")
def _(v: Inputs):
    return scored(v, v.prospects).select(POINTS)


@query("g6_learned_thresholds", """SELECT id, CASE WHEN avg_suit_price_eur > 0 AND avg_suit_price_eur < lo THEN 'price_too_low'
 WHEN store_count > hi THEN 'too_many_stores' END AS rejection_reason,
 CASE WHEN avg_suit_price_eur IS NULL OR avg_suit_price_eur = 0 THEN 15 WHEN avg_suit_price_eur >= mid THEN 30
  WHEN avg_suit_price_eur >= 500 THEN 20 WHEN avg_suit_price_eur >= lo THEN 10 ELSE 0 END AS price_score,
 CASE WHEN store_count = 0 THEN 25 WHEN store_count <= med THEN 30 WHEN store_count <= 10 THEN 20
  WHEN store_count <= 20 THEN 10 WHEN store_count <= hi THEN 5 ELSE 0 END AS size_score
FROM {prospects}, (SELECT min(pvp_suits_eur) AS lo, max(store_count) AS hi, floor(quantile_cont(pvp_suits_eur, 0.5)) AS mid,
 floor(quantile_cont(store_count, 0.5)) AS med FROM {clients})""")
def _(v: Inputs):
    t = clients.learned_thresholds(v.clients)
    return v.prospects.select(
        "id", scoring.rejection_reason(t).alias("rejection_reason"),
        scoring.price_points(t).alias("price_score"), scoring.size_points(t).alias("size_score"),
    )


@query("g7_score_texts", """SELECT id, CASE WHEN avg_suit_price_eur > 0 THEN '€' || CAST(CAST(avg_suit_price_eur AS BIGINT) AS VARCHAR) ELSE 'Unknown' END AS price_text,
 store_count || ' stores → ' || CASE WHEN store_count <= 4 THEN 'ideal boutique' WHEN store_count <= 10 THEN 'small chain'
  WHEN store_count <= 20 THEN 'medium chain' ELSE 'large chain' END AS size_text,
 coalesce(wool_percentage, 'Unknown') AS wool_text, CASE WHEN made_to_measure THEN 'Yes' ELSE 'No/Unknown' END AS mtm_text
FROM {prospects}""")
def _(v: Inputs):
    return scoring.with_texts(v.prospects).select("id", "price_text", "size_text", "wool_text", "mtm_text")


@query("g8_recommendation", f"SELECT id, {o.RECOMMENDATION} AS recommendation FROM {{o_scored}}")
def _(v: Inputs):
    return scored(v, v.prospects).select("id", scoring.recommendation("final_score").alias("recommendation"))


@query("g9_lenient_numbers", """SELECT id, store_count AS stores_text, price_text,
 CASE WHEN regexp_full_match(store_count, '[0-9]+') THEN CAST(store_count AS INTEGER) ELSE 0 END AS stores,
 coalesce(CASE WHEN regexp_full_match(price_text, '[0-9.]*[0-9][0-9.]*') THEN TRY_CAST(price_text AS DOUBLE) END, 0) AS price
FROM (SELECT id, store_count, CASE WHEN store_count = 'many' THEN '1.2.3' WHEN store_count = '' THEN '€5' ELSE store_count || '.5' END AS price_text FROM {legacy_rows})""")
def _(v: Inputs):
    price = F.expr(
        "CASE WHEN store_count = 'many' THEN '1.2.3' WHEN store_count = '' THEN '€5' ELSE store_count || '.5' END"
    )
    return v.legacy_rows.select("id", F.col("store_count").alias("stores_text"), price.alias("price_text")).select(
        "*", scoring.lenient_stores("stores_text").alias("stores"),
        scoring.lenient_price("price_text").alias("price"),
    )


@query("g10_client_profile_text", """SELECT client_id, name || ' is a menswear brand from '
 || CASE WHEN city <> '' AND city <> country THEN city || ', ' || country ELSE country END || '. They are a '
 || CASE WHEN store_count <= 5 THEN 'small boutique' WHEN store_count <= 20 THEN 'medium chain' ELSE 'large chain' END
 || ' selling ' || CASE WHEN coalesce(pvp_suits_eur, 0) <> 0 THEN 'suits priced at €' || CAST(CAST(pvp_suits_eur AS BIGINT) AS VARCHAR) ELSE 'price not public' END
 || '.' || CASE WHEN brand_type <> 'unknown' THEN ' Business type: ' || brand_type || '.' ELSE '' END AS profile_text
FROM {clients}""")
def _(v: Inputs):
    return v.clients.select("client_id", clients.profile_text().alias("profile_text"))


@query("g10_prospect_profile_text", """SELECT id, name || ' is a menswear brand from ' || city || ', ' || country || '. They are a '
 || CASE WHEN store_count <= 5 THEN 'small boutique' WHEN store_count <= 20 THEN 'medium chain' ELSE 'large chain' END
 || ' selling ' || CASE WHEN coalesce(avg_suit_price_eur, 0) <> 0 THEN 'suits priced at €' || CAST(CAST(avg_suit_price_eur AS BIGINT) AS VARCHAR) ELSE 'price not public' END
 || '.' AS profile_text FROM {prospects}""")
def _(v: Inputs):
    return v.prospects.select("id", clients.profile_text("avg_suit_price_eur", None).alias("profile_text"))


@query("g11_ideal_clients", """SELECT client_id, name FROM {clients}
WHERE store_count BETWEEN 0 AND 10 AND (wool_percentage = '100%' OR made_to_measure)""")
def _(v: Inputs):
    return clients.ideal_clients(v.clients).select("client_id", "name")


@query("g12_constraints", """SELECT id, CASE WHEN coalesce(avg_suit_price_eur, 0) < 500 THEN 'price_below_minimum'
 WHEN store_count > 20 THEN 'too_many_stores' WHEN brand_style = 'unknown' THEN 'no_suits' END AS reason FROM {prospects}""")
def _(v: Inputs):
    suits = F.col("brand_style") != "unknown"
    return v.prospects.select("id", scoring.constraint_reason(500, 20, suits).alias("reason"))


G13_RULES = (
    ("wool", 25, ("bespoke",)), ("mtm", 20, ("tailor",)), ("italian", 15, ("sartorial",)),
    ("british", 15, ("bond street",)), ("super", 10, ("€1", "£1")), ("canvas", 10, ("blazer",)),
    ("custom", 5, ("jacket", "traje")),
)


@query("g13_quality_bonus", """SELECT page_id, CAST(least(100,
 CASE WHEN contains(t, 'bespoke') THEN 25 ELSE 0 END + CASE WHEN contains(t, 'tailor') THEN 20 ELSE 0 END
 + CASE WHEN contains(t, 'sartorial') THEN 15 ELSE 0 END + CASE WHEN contains(t, 'bond street') THEN 15 ELSE 0 END
 + CASE WHEN contains(t, '€1') OR contains(t, '£1') THEN 10 ELSE 0 END + CASE WHEN contains(t, 'blazer') THEN 10 ELSE 0 END
 + CASE WHEN contains(t, 'jacket') OR contains(t, 'traje') THEN 5 ELSE 0 END) AS INTEGER) AS bonus
FROM (SELECT page_id, lower(content) AS t FROM {contents})""")
def _(v: Inputs):
    return v.contents.select("page_id", text.quality_bonus("content", G13_RULES).alias("bonus"))


def _documented_bonus(t: str) -> str:
    """The documented rules over lower-case text."""

    def found(words) -> str:
        if isinstance(words, re.Pattern):
            return f"regexp_matches({t}, '{words.pattern}')"
        return " OR ".join(f"contains({t}, '{w}')" for w in words)

    parts = " + ".join(f"CASE WHEN {found(words)} THEN {p} ELSE 0 END" for _, p, words in text.QUALITY_BONUS)
    return f"CAST(least(100, {parts}) AS INTEGER)"


@query("g13_documented_words", f"SELECT page_id, {_documented_bonus('lower(content)')} AS bonus FROM {{praised}}")
def _(v: Inputs):
    return v.praised.select("page_id", text.quality_bonus("content").alias("bonus"))


_MISSING = """(CASE WHEN no_price THEN 1 ELSE 0 END + CASE WHEN no_stores THEN 1 ELSE 0 END
 + CASE WHEN wool_percentage IS NULL OR lower(wool_percentage) = 'unknown' THEN 1 ELSE 0 END
 + CASE WHEN made_to_measure IS NULL THEN 1 ELSE 0 END + CASE WHEN brand_style = 'unknown' THEN 1 ELSE 0 END)"""


@query("g14_data_confidence", f"""SELECT id, CASE WHEN no_price AND no_stores THEN 20 WHEN {_MISSING} = 0 THEN 100
 WHEN {_MISSING} <= 2 THEN 70 ELSE 40 END AS confidence
FROM (SELECT *, coalesce(avg_suit_price_eur, 0) = 0 AS no_price, store_count = 0 AS no_stores FROM {{prospects}})""")
def _(v: Inputs):
    return v.prospects.select("id", scoring.data_confidence().alias("confidence"))


@query("g15_weighted_score", f"""SELECT id,
 {o.half_up("coalesce(similarity, 0) * 0.4::DOUBLE + quality_score * 0.35::DOUBLE + coalesce(share, 0) * 0.15::DOUBLE + confidence * 0.1::DOUBLE", 2)} AS score_a,
 {o.half_up("coalesce(similarity, 0) * 0.3::DOUBLE + quality_score * 0.3::DOUBLE + coalesce(share, 0) * 0.15::DOUBLE + confidence * 0.0::DOUBLE + size_score * 0.25::DOUBLE", 2)} AS score_b
FROM (SELECT *, CASE WHEN no_price AND no_stores THEN 20 WHEN {_MISSING} = 0 THEN 100 WHEN {_MISSING} <= 2 THEN 70 ELSE 40 END AS confidence
 FROM (SELECT *, coalesce(avg_suit_price_eur, 0) = 0 AS no_price, store_count = 0 AS no_stores FROM {{o_scored}}))""")
def _(v: Inputs):
    rows = scored(v, v.prospects)
    sim, market = F.coalesce("similarity", F.lit(0.0)), F.coalesce("market_share", F.lit(0.0))
    quality, conf = F.col("quality_score"), scoring.data_confidence()
    return rows.select(
        "id",
        scoring.weighted_score(sim, quality, market, conf).alias("score_a"),
        scoring.weighted_score(sim, quality, market, conf, F.col("size_score"), scoring.SIZE_WEIGHTS).alias("score_b"),
    )


@query("g16_alternative_similarity", f"""WITH dims AS (
 SELECT client_id, tier, CAST(embedding AS DOUBLE[]) AS e, generate_subscripts(embedding, 1) AS d FROM {{client_vectors}}),
 centroid AS (SELECT list(m ORDER BY d) AS c FROM (SELECT d, avg(e[d]) AS m FROM dims GROUP BY d))
SELECT vec_id, round(avg(similarity_10) , 6) AS top_mean, round(max(cs) * 100, 6) AS centroid_similarity, round(max(ws) * 100, 6) AS weighted_similarity
FROM (SELECT p.vec_id, CASE WHEN r.rank IS NOT NULL THEN p.cosine * 100 END AS similarity_10,
  list_cosine_similarity(CAST(b.embedding AS DOUBLE[]), (SELECT c FROM centroid)) AS cs,
  sum(p.cosine * CASE WHEN cv.tier = 'high_value' THEN 2 ELSE 1 END) OVER (PARTITION BY p.vec_id)
   / sum(CASE WHEN cv.tier = 'high_value' THEN 2 ELSE 1 END) OVER (PARTITION BY p.vec_id) AS ws
 FROM {{o_pairs}} p JOIN {{brand_vectors}} b ON b.vec_id = p.vec_id JOIN {{client_vectors}} cv ON cv.client_id = p.client_id
 LEFT JOIN {{o_ranked}} r ON r.vec_id = p.vec_id AND r.client_id = p.client_id) GROUP BY vec_id""")
def _(v: Inputs):
    out = similarity.alternative_similarity(v.brand_vectors, v.client_vectors, 10)
    return out.select("vec_id", *[F.round(c, 6).alias(c) for c in ("top_mean", "centroid_similarity", "weighted_similarity")])


# ---------------------------------------------------------------- joins and enrichment


@query("e1_existence_check", """SELECT id, domain, city FROM {candidates} c
WHERE EXISTS (SELECT 1 FROM {prospects} p WHERE p.domain = c.domain AND p.city = c.city)""")
def _(v: Inputs):
    return writes.exists_in_store(v.candidates, v.prospects).select("id", "domain", "city")


@query("e2_stored_domains", "SELECT DISTINCT city, domain FROM {prospects}")
def _(v: Inputs):
    return writes.stored_domains(v.prospects)


@query("e3_top_similar_clients", "SELECT vec_id, client_id, similarity, rank FROM {o_ranked}")
def _(v: Inputs):
    return ranked(v).select("vec_id", "client_id", "similarity", "rank")


@query("e3_top_similar_blocked", "SELECT vec_id, client_id, similarity, rank FROM {o_ranked} WHERE rank <= 5")
def _(v: Inputs):
    out = similarity.top_similar(
        v.brand_vectors, v.client_vectors, 5, matrix_max_bytes=1 << 10, chunk_bytes=32 << 10
    )
    return out.select("vec_id", "client_id", "similarity", "rank")


@query("e3_top_similar_bounded", "SELECT vec_id, client_id, similarity, rank FROM {o_ranked} WHERE rank <= 5")
def _(v: Inputs):
    blocks = client_blocks.store_blocks(v.client_vectors)
    out = client_blocks.top_similar_bounded(v.brand_vectors, blocks, 5, wave_bytes=32 << 10)
    return out.select("vec_id", "client_id", "similarity", "rank")


REPEATED = "SELECT vec_id % 7 AS brand_group, client_id, similarity, rank FROM {o_ranked} WHERE rank <= 5"


def _grouped_vectors(v: Inputs):
    """Rows whose key repeats."""
    return v.brand_vectors.withColumn("brand_group", F.col("vec_id") % 7)


@query("e3_repeated_keys", REPEATED)
def _(v: Inputs):
    out = similarity.top_similar(_grouped_vectors(v), v.client_vectors, 5, key="brand_group")
    return out.select("brand_group", "client_id", "similarity", "rank")


@query("e3_repeated_keys_blocked", REPEATED)
def _(v: Inputs):
    out = similarity.top_similar(
        _grouped_vectors(v), v.client_vectors, 5, key="brand_group", matrix_max_bytes=1 << 10, chunk_bytes=32 << 10
    )
    return out.select("brand_group", "client_id", "similarity", "rank")


@query("e4_all_lists", "SELECT vec_id, client_id, similarity, rank FROM {o_ranked} WHERE rank <= 10")
def _(v: Inputs):
    return similarity.approx_similar(v.brand_vectors, v.client_vectors, 10, probes=1 << 20).select(
        "vec_id", "client_id", "similarity", "rank"
    )


@query("e4_all_lists_blocked", "SELECT vec_id, client_id, similarity, rank FROM {o_ranked} WHERE rank <= 10")
def _(v: Inputs):
    out = similarity.approx_similar(
        v.brand_vectors, v.client_vectors, 10, probes=1 << 20, matrix_max_bytes=1 << 10, chunk_bytes=32 << 10
    )
    return out.select("vec_id", "client_id", "similarity", "rank")


@query("e4_approximate_top_k")
def _(v: Inputs):
    return similarity.approx_similar(v.brand_vectors, v.client_vectors, 10).select(
        "vec_id", "client_id", "similarity", "rank"
    )


def _by_graph(v: Inputs, k: int = 10):
    graphs = neighbour_graph.store_graph(v.embeddings.withColumnRenamed("vec_id", "client_id"), shard_rows=4_096)
    return neighbour_graph.similar_by_graph(v.brand_vectors, graphs, k)


@query("e4_neighbour_graph")
def _(v: Inputs):
    return _by_graph(v).select("vec_id", "client_id", "similarity", "rank")


@query("e4_graph_recall", "SELECT count(*) AS prospects, true AS enough FROM {brand_vectors} WHERE embedding IS NOT NULL")
def _(v: Inputs):
    """Of the ten most similar of all vectors, for every prospect, at least nine tenths must be found."""
    exact = similarity.top_similar(v.brand_vectors, v.embeddings.withColumnRenamed("vec_id", "client_id"), 10)
    hits = exact.select("vec_id", "client_id").join(_by_graph(v).select("vec_id", "client_id", F.lit(1).alias("hit")), ["vec_id", "client_id"], "left")
    return hits.agg(F.count_distinct("vec_id").alias("prospects"), (F.count("hit") >= 0.9 * F.count("*")).alias("enough"))


@query("e5_similarity_points", f"""SELECT id, similarity, {o.half_up(o.SIM_POINTS, 2)} AS points FROM {{o_scored}}""")
def _(v: Inputs):
    rows = scoring.with_similarity(v.prospects, best_by_domain(v))
    points = similarity.similarity_points(F.col("similarity"))
    return rows.select("id", "similarity", round_half_up(points, 2).alias("points"))


@query("e6_market_points", f"SELECT id, {o.half_up(o.MARKET_POINTS, 4)} AS points FROM {{prospects}} LEFT JOIN {{o_market}} USING (country_code)")
def _(v: Inputs):
    rows = scoring.with_market(v.prospects, clients.market_strength(v.clients))
    return rows.select("id", round_half_up(scoring.market_points("market_share"), 4).alias("points"))


_STREETS = """SELECT page_id, street, tier FROM (SELECT c.page_id, s.street, s.tier,
 row_number() OVER (PARTITION BY c.page_id ORDER BY s.pos) AS rn
 FROM {contents} c LEFT JOIN {streets} s ON s.city = c.city AND contains(lower(c.content), s.street)) WHERE rn = 1"""


@query("e7_premium_street", _STREETS)
def _(v: Inputs):
    return geo.detect_street(v.contents, v.streets, ["page_id"]).select("page_id", "street", "tier")


@query("e7_premium_street_joined", _STREETS)
def _(v: Inputs):
    return geo.detect_street(v.contents, v.streets, ["page_id"], small=False).select("page_id", "street", "tier")


@query("e7_premium_street_automaton", _STREETS)
def _(v: Inputs):
    return geo.detect_street_long_lists(v.contents, v.streets).select("page_id", "street", "tier")


@query("e8_location", f"""SELECT page_id, CASE tier WHEN 1 THEN 10 WHEN 2 THEN 7 WHEN 3 THEN 4 ELSE 0 END AS location_score,
 CASE WHEN street IS NOT NULL THEN 'premium' ELSE 'standard' END AS location_quality FROM ({_STREETS})""")
def _(v: Inputs):
    found = geo.detect_street(v.contents, v.streets, ["page_id"])
    return geo.with_location(found).select("page_id", "location_score", "location_quality")


@query("e9_similarity_explanation", """SELECT id, CASE WHEN parts <> '' THEN 'Similar to ' || cname || ' because both have: ' || parts || '.'
 ELSE 'Similar to ' || cname || ' (' || CAST(CAST(round(CAST(similarity AS DECIMAL(18,8)), 1) AS DECIMAL(10,1)) AS VARCHAR)
  || '% match) based on overall brand profile and positioning.' END AS explanation
FROM (SELECT p.id, c.name AS cname, r.similarity, concat_ws(', ',
  CASE WHEN abs(p.store_count - c.store_count) <= 5 THEN 'similar boutique size (' || p.store_count || ' vs ' || c.store_count || ' stores)' END,
  CASE WHEN coalesce(p.wool_percentage, 'unknown') = c.wool_percentage THEN '100% wool suits' END,
  CASE WHEN p.made_to_measure = c.made_to_measure THEN 'made-to-measure services' END,
  CASE WHEN p.brand_style = c.brand_style THEN p.brand_style || ' positioning' END) AS parts
 FROM {prospects} p JOIN {brand_vectors} b USING (domain) JOIN {o_ranked} r ON r.vec_id = b.vec_id AND r.rank = 1
 JOIN {clients} c ON c.client_id = r.client_id)""")
def _(v: Inputs):
    best = similarity.best_match(ranked(v, 1), v.clients).join(
        v.brand_vectors.select("vec_id", "domain"), "vec_id"
    )
    rows = v.prospects.join(best, "domain")
    return rows.select("id", similarity.explanation(F.col("similarity")).alias("explanation"))


@query("e10_match_report", f"""SELECT id, final_score, {o.RECOMMENDATION} AS recommendation, similar_list
FROM {{o_scored}} LEFT JOIN (SELECT b.domain, string_agg(c.name || '=' || CAST(CAST(r.similarity AS DECIMAL(10,2)) AS VARCHAR), '|' ORDER BY r.rank) AS similar_list
 FROM {{o_ranked}} r JOIN {{brand_vectors}} b USING (vec_id) JOIN {{clients}} c USING (client_id) WHERE r.rank <= 5 GROUP BY b.domain) USING (domain)""")
def _(v: Inputs):
    by_domain = ranked(v, 5).join(v.brand_vectors.select("vec_id", "domain"), "vec_id")
    best = by_domain.filter("rank = 1").select("domain", "similarity")
    rows = scoring.score(scoring.with_market(
        scoring.with_similarity(v.prospects, best), clients.market_strength(v.clients)))
    out = scoring.match_report(rows, by_domain, v.clients)
    line = F.array_join(F.transform("similar_clients", lambda s: F.concat(
        s["client"], F.lit("="), s["similarity"].cast("decimal(10,2)").cast("string"))), "|")
    return out.select("id", "final_score", "recommendation", line.alias("similar_list"))


@query("e11_supported_cities", "SELECT DISTINCT city FROM {streets}")
def _(v: Inputs):
    return geo.supported_cities(v.streets)


@query("e11_in_supported_city", "SELECT page_id, city FROM {contents} WHERE city IN (SELECT city FROM {streets})")
def _(v: Inputs):
    return geo.in_supported_city(v.contents, v.streets).select("page_id", "city")


@query("k1_k7_keys", f"""SELECT call_no, {o.k1("u")} AS k1, {o.k2("u")} AS k2, {o.k3("u")} AS k3, {o.k4("u")} AS k4,
 lower(trim(city)) AS k5, substring(md5({o.k2("u")} || '_' || lower(trim(city))), 1, 16) AS k6,
 replace(lower(regexp_replace(regexp_replace(regexp_extract(trim(u), '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')), 'www.', '') AS k7
FROM (SELECT city, rank AS call_no, ' ' || url || ' ' AS u FROM {{search_results}}
 UNION ALL SELECT 'PAGE ', -1 - page_id, url FROM {{pages}})""")
def _(v: Inputs):
    urls = v.search_results.select("city", F.col("rank").alias("call_no"), F.concat(F.lit(" "), "url", F.lit(" ")).alias("u"))
    pages = v.pages.select(F.lit("PAGE ").alias("city"), (-1 - F.col("page_id")).alias("call_no"), F.col("url").alias("u"))
    k2, k5 = keys.store_url_key("u"), keys.city_key("city")
    return urls.unionByName(pages).select(
        "call_no", keys.discovery_url_key("u").alias("k1"), k2.alias("k2"),
        keys.discovery_domain("u").alias("k3"), keys.store_domain("u").alias("k4"), k5.alias("k5"),
        keys.prospect_id(k2, k5).alias("k6"), keys.contact_host("u").alias("k7"),
    )
