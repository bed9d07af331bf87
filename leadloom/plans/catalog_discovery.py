"""Registered discovery (D) and content (C) operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.functions import text
from leadloom.functions.exprs import round_half_up
from leadloom.operators import content, discovery, finalists
from leadloom.plans import oracle_text as o
from leadloom.plans.catalog_scoring import ranked
from leadloom.plans.registry import Inputs, query
from leadloom.schemas import LEAD

HIT = ["city", "query_index", "rank", "url"]
H = ", ".join(HIT)

_COUNTRY = """CASE WHEN country <> 'USA' THEN country
 WHEN regexp_matches(lower(city), 'london|manchester|birmingham') THEN 'UK'
 WHEN regexp_matches(lower(city), 'paris|lyon|marseille') THEN 'France'
 WHEN regexp_matches(lower(city), 'berlin|munich|hamburg|frankfurt') THEN 'Germany'
 WHEN regexp_matches(lower(city), 'milan|rome|florence|naples') THEN 'Italy'
 WHEN regexp_matches(lower(city), 'madrid|barcelona') THEN 'Spain'
 WHEN regexp_matches(lower(city), 'lisbon|porto') THEN 'Portugal' ELSE country END"""


@query("d1_country_inference", f"SELECT request_id, city, {_COUNTRY} AS country FROM {{city_requests}}")
def _(v: Inputs):
    return discovery.with_country(v.city_requests)


_QUERIES = """SELECT request_id, CAST(query_index AS INTEGER) AS query_index, city || tail AS query FROM {city_requests},
 (VALUES (0, ' luxury menswear boutique premium suits'), (1, ' bespoke tailor custom suits high end'),
  (2, ' designer men suits store independent')) t(query_index, tail)"""


@query("d2_query_generation", _QUERIES)
def _(v: Inputs):
    return discovery.generate_queries(v.city_requests).select("request_id", "query_index", "query")


@query("d3_first_queries", f"SELECT {H} FROM {{search_results}} WHERE query_index < 3")
def _(v: Inputs):
    return discovery.first_queries(v.search_results).select(HIT)


@query("d4_excluded_domains", """SELECT page_id, url FROM {pages}
WHERE NOT regexp_matches(url, '^https?://([^/?#]*\\.)?(example\\.net|amazon\\.com|yelp\\.com)([/?#:]|$)')""")
def _(v: Inputs):
    return discovery.drop_excluded(v.pages, ("example.net", "amazon.com", "yelp.com")).select("page_id", "url")


_D5 = o.first_per(
    f"(SELECT *, {o.k1('url')} AS url_key FROM {{search_results}} WHERE url <> '')", "city, url_key", "query_index, rank")


@query("d5_url_dedupe", f"SELECT {H}, url_key FROM ({_D5})")
def _(v: Inputs):
    return discovery.dedupe_urls(v.search_results).select(*HIT, "url_key")


def _domains(suppressed: str) -> str:
    one = o.first_per(
        f"(SELECT *, {o.k3('url')} AS domain FROM {{search_results}} WHERE url <> '')", "city, domain", "query_index, rank",
        suppressed)
    two = o.first_per(f"(SELECT * EXCLUDE (rn), {o.k1('url')} AS url_key FROM ({one}))", "city, url_key", "query_index, rank")
    return f"SELECT {H}, domain FROM ({two})"


@query("d6_domain_dedupe", _domains("true"))
def _(v: Inputs):
    return discovery.dedupe_domains(v.search_results).select(*HIT, "domain")


@query("d7_suppression", _domains("lower(trim(domain)) NOT IN (SELECT domain FROM {suppression})"))
def _(v: Inputs):
    return discovery.dedupe_domains(v.search_results, v.suppression).select(*HIT, "domain")


@query("d8_discovery_summary", f"""SELECT * FROM (SELECT city, query_index, count(*) AS n_results FROM {{search_results}} GROUP BY ALL)
JOIN (SELECT city, count(DISTINCT {o.k1("url")}) AS unique_urls FROM {{search_results}} WHERE url <> '' GROUP BY city) USING (city)""")
def _(v: Inputs):
    return discovery.discovery_summary(v.search_results)


@query("d9_cache_admission", """SELECT w.city, least(coalesce(n, 0), 100) AS listed, coalesce(n, 0) >= 10 AS enough_stored, n IS NOT NULL AS served_from_store
FROM {wanted_cities} w LEFT JOIN (SELECT city, count(DISTINCT domain) AS n FROM {prospects} GROUP BY city) p ON p.city = w.city""")
def _(v: Inputs):
    return discovery.cache_admission(v.wanted_cities, v.prospects)


@query("d10_approved_brands", """SELECT id, city, domain FROM {prospects} p
WHERE EXISTS (SELECT 1 FROM {decisions} d WHERE d.city = p.city AND d.domain = p.domain AND d.approved)""")
def _(v: Inputs):
    return discovery.approved_only(v.prospects, v.decisions).select("id", "city", "domain")


@query("d10_query_edits", f"""SELECT q.request_id, q.query_index, coalesce(e.edited, q.query) AS query FROM ({_QUERIES}) q
LEFT JOIN {{query_edits}} e ON e.request_id = q.request_id AND e.query_index = q.query_index""")
def _(v: Inputs):
    made = discovery.generate_queries(v.city_requests).select("request_id", "query_index", "query")
    return discovery.apply_query_edits(made, v.query_edits)


@query("d11_best_per_query", f"""SELECT {H} FROM (SELECT *, row_number() OVER (PARTITION BY city, query_index ORDER BY rank) AS rn
 FROM {{page_hits}} WHERE NOT regexp_matches(lower(url), '/blog|/news|/press|/article|/about|/our-story|/contact|/locations|/find-us|facebook\\.com|instagram\\.com|yelp\\.com')) WHERE rn <= 5""")
def _(v: Inputs):
    return discovery.best_per_query(v.page_hits).select(HIT)


# ---------------------------------------------------------------- content


@query("c1_source_fallback", """SELECT url, CASE WHEN length(c1) >= 500 THEN c1 WHEN length(c2) > 500 THEN substring(c2, 1, 12000)
 WHEN s3 THEN substring(c3, 1, 12000) ELSE c1 END AS content,
 CAST(CASE WHEN length(c1) >= 500 THEN 1 WHEN length(c2) > 500 THEN 2 WHEN s3 AND c3 IS NOT NULL THEN 3 WHEN c1 IS NOT NULL THEN 1 END AS INTEGER) AS source
FROM (SELECT url, max(content) FILTER (source = 1) AS c1, max(content) FILTER (source = 2) AS c2,
 max(content) FILTER (source = 3) AS c3, bool_or(success) FILTER (source = 3) AS s3 FROM {fetched} GROUP BY url)""")
def _(v: Inputs):
    return content.choose_source(v.fetched)


@query("c1_whole_texts", """SELECT url, CASE WHEN length(c1) >= 500 THEN c1 WHEN length(c2) > 500 THEN c2 WHEN s3 THEN c3 ELSE c1 END AS content
FROM (SELECT url, max(content) FILTER (source = 1) AS c1, max(content) FILTER (source = 2) AS c2,
 max(content) FILTER (source = 3) AS c3, bool_or(success) FILTER (source = 3) AS s3 FROM {fetched} GROUP BY url)""")
def _(v: Inputs):
    return content.choose_source(v.fetched, cut=None).select("url", "content")


@query("c2_two_source_fallback", """SELECT p.url, CASE WHEN length(p.content) < 500 AND length(s.content) > length(p.content) THEN s.content ELSE p.content END AS content,
 CASE WHEN length(p.content) < 500 AND length(s.content) > length(p.content) THEN 'secondary' ELSE 'primary' END AS source,
 length(p.content) > 0 OR coalesce(length(s.content), 0) > 0 AS success,
 length(p.content) < 500 AS used_fallback,
 length(p.content) < 500 AND NOT coalesce(length(s.content), 0) > length(p.content) AS fallback_failed
FROM (SELECT * FROM {fetched} WHERE source = 1) p LEFT JOIN (SELECT * FROM {fetched} WHERE source = 3 AND success) s ON s.url = p.url""")
def _(v: Inputs):
    f = v.fetched
    return content.choose_of_two(
        f.filter("source = 1").select("url", "content"),
        f.filter("source = 3").select("url", "success", "content"),
    )


@query("c3_truncation_title", """SELECT doc_id, content, trim(regexp_extract(content, '(?:^|\\n)# ([^\\n]*)', 1)) AS title
FROM (SELECT doc_id, CASE WHEN length(content) > 15000 THEN substring(content, 1, 15000) || chr(10) || chr(10) || '[Content truncated...]' ELSE content END AS content FROM {reader_pages})""")
def _(v: Inputs):
    return content.with_title(v.reader_pages).select("doc_id", "content", "title")


@query("c3_whole_texts", "SELECT doc_id, content, trim(regexp_extract(content, '(?:^|\\n)# ([^\\n]*)', 1)) AS title FROM {reader_pages}")
def _(v: Inputs):
    return content.with_title(v.reader_pages, limit=None).select("doc_id", "content", "title")


@query("c4_extraction_rate", """SELECT source, count(*) AS total, count(*) FILTER (content <> '') AS extracted,
 CAST(count(*) FILTER (content <> '') AS DOUBLE) / count(*) AS rate
FROM (SELECT source, CASE WHEN success THEN content ELSE '' END AS content FROM {fetched}) GROUP BY source""")
def _(v: Inputs):
    seen = v.fetched.select("source", F.when(F.col("success"), F.col("content")).otherwise("").alias("content"))
    return content.extraction_rate(seen, "source")


@query("c4_extracted", "SELECT url, source FROM {fetched} WHERE success AND content <> ''")
def _(v: Inputs):
    return content.extracted(
        v.fetched.withColumn("content", F.when(F.col("success"), F.col("content")))
    ).select("url", "source")


def _hits(words: tuple[str, ...], t: str = "t") -> str:
    return " + ".join(f"CAST(contains({t}, '{w}') AS INTEGER)" for w in words)


def _relevance(words, strong) -> str:
    any_strong = " OR ".join(f"contains(t, '{w}')" for w in strong)
    return f"CAST({_hits(words)} + CASE WHEN {any_strong} THEN 3 ELSE 0 END AS INTEGER)"


@query("c5_keyword_relevance", f"""SELECT * FROM (SELECT page_id, {_relevance(text.RELEVANT_WORDS, text.STRONG_WORDS)} AS relevance
 FROM (SELECT page_id, url, substring(lower(content), 1, 5000) AS t FROM {{contents}})
 WHERE NOT regexp_matches(lower(url), '{"|".join(text.DIRECTORY_WORDS)}')) WHERE relevance >= 2""")
def _(v: Inputs):
    return content.relevant(v.contents).select("page_id", "relevance")


DOC_WORDS = ("the", "und", "que", "les", "para", "ing", "tion", "ment", "ungen", "ción")
DOC_STRONG = ("und", "que")


@query("c5_whole_documents", f"""SELECT * FROM (SELECT doc_id, {_relevance(DOC_WORDS, DOC_STRONG)} AS relevance
 FROM (SELECT doc_id, lower(text) AS t FROM {{documents}} WHERE NOT contains(source, 'src1'))) WHERE relevance >= 2""")
def _(v: Inputs):
    docs = v.documents.select("doc_id", F.col("text").alias("content"), F.col("source").alias("url"))
    kept = content.relevant(docs, DOC_WORDS, DOC_STRONG, directory=("src1",), window=None)
    return kept.select("doc_id", "relevance")


# The long form of the price pattern, matched as a whole by the oracle.
LONG_PRICE = (
    r"(?i)(?:[$€£]\s?\d{1,3}(?:[,.\s]?\d{3})*(?:[.,]\d{2})?|\d{1,3}(?:[,.\s]?\d{3})*(?:[.,]\d{2})?\s?[$€£]"
    r"|(?:price|prix|preço|preis|precio|from|starting\s+at|a\s+partir\s+de)\s*[:=]?\s*[$€£]?\d+(?:[.,]\d{2})?)"
)
_LONG_PRICE = LONG_PRICE.replace("{", "{{").replace("}", "}}")


@query("c6_price_presence", f"""SELECT 'page' AS kind, CAST(page_id AS BIGINT) AS id, regexp_matches(content, '{_LONG_PRICE}') AS mentions_price FROM {{contents}}
UNION ALL SELECT 'doc', doc_id, regexp_matches(text, '{_LONG_PRICE}') FROM {{documents}}
UNION ALL SELECT 'html', page_id, regexp_matches(html, '{_LONG_PRICE}') FROM {{pages}}""")
def _(v: Inputs):
    def rows(df, kind: str, key: str, column: str):
        return df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(column).alias("content"))

    texts = (
        rows(v.contents, "page", "page_id", "content")
        .unionByName(rows(v.documents, "doc", "doc_id", "text"))
        .unionByName(rows(v.pages, "html", "page_id", "html"))
    )
    return content.with_price_flag(texts).drop("content")


_AMOUNT = r"(\d{{1,3}}(?:[,.]\d{{3}})*(?:[.,]\d{{2}})?)"
_FOUND = f"""list_filter(list_transform(list_concat(list_concat(regexp_extract_all(t, '[$€£]\\s?{_AMOUNT}', 1),
  regexp_extract_all(t, '{_AMOUNT}\\s?[$€£]', 1)), regexp_extract_all(t, '{_AMOUNT}\\s?EUR', 1)),
  lambda m: CAST(replace(replace(m, ',', ''), '.', '') AS DOUBLE) / CASE WHEN contains(m, ',') AND contains(m, '.') THEN 100 ELSE 1 END),
  lambda p: p > 150 AND p < 6000)"""
_MEAN = f"coalesce(list_sum({_FOUND}) / nullif(len({_FOUND}), 0), 0)"
PAGE_PRICE = f"SELECT page_id, {_MEAN} AS avg_price FROM (SELECT page_id, content AS t FROM {{contents}})"


@query("c7_price_extraction", f"""SELECT 'page' AS kind, CAST(page_id AS BIGINT) AS id, {o.half_up(_MEAN, 4)} AS avg_price FROM (SELECT page_id, content AS t FROM {{contents}})
UNION ALL SELECT 'doc', doc_id, {o.half_up(_MEAN, 4)} FROM (SELECT doc_id, text AS t FROM {{documents}})
UNION ALL SELECT 'html', page_id, {o.half_up(_MEAN, 4)} FROM (SELECT page_id, html AS t FROM {{pages}})""")
def _(v: Inputs):
    def rows(df, kind: str, key: str, column: str):
        return df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(column).alias("content"))

    texts = (
        rows(v.contents, "page", "page_id", "content")
        .unionByName(rows(v.documents, "doc", "doc_id", "text"))
        .unionByName(rows(v.pages, "html", "page_id", "html"))
    )
    return texts.select("kind", "id", round_half_up(text.average_price("content"), 4).alias("avg_price"))


LINK_WORDS = {"suit": ("the", "que", "und"), "shop": ("and", "for", "les", "der"), "account": ("tion", "ment")}


def _any(t: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({t}, '{w}')" for w in words) + ")"


def _best_sql(words: dict[str, tuple[str, ...]], pages: str) -> str:
    """The best link per page; an anchor reaches to its end tag, the next anchor or the end of the page."""
    links = f"""SELECT page_id, url, raw, pos, CASE WHEN {_any("txt", words["suit"])} THEN 10 ELSE 0 END
  + CASE WHEN {_any("href", words["suit"])} THEN 5 ELSE 0 END + CASE WHEN {_any("txt", words["shop"])} THEN 2 ELSE 0 END
  + CASE WHEN {_any("href", words["shop"])} THEN 1 ELSE 0 END - CASE WHEN {_any("href", words["account"])} THEN 50 ELSE 0 END AS score
 FROM (SELECT page_id, url, pos, raw, lower(trim(raw)) AS href, lower(regexp_replace(regexp_extract(a, '(?is)^[^>]*>(.*)$', 1), '<[^>]*>', ' ', 'g')) AS txt
  FROM (SELECT page_id, url, pos, string_split_regex(a, '(?i)</a')[1] AS a, regexp_extract(a, '(?is)^(?:[^>]*?\\s)?href\\s*=\\s*"([^"]*)"', 1) AS raw
   FROM (SELECT page_id, url, unnest(xs) AS a, generate_subscripts(xs, 1) AS pos
    FROM (SELECT page_id, url, string_split_regex(html, '(?i)<a\\s')[2:] AS xs FROM {pages}))))
 WHERE href <> '' AND NOT starts_with(href, '#') AND NOT starts_with(href, 'javascript')"""
    return f"""SELECT p.page_id, p.url, CAST(b.score AS INTEGER) AS link_score,
 CASE WHEN b.score >= 2 THEN regexp_extract(p.url, '^(https?://[^/?#]*)', 1) || b.raw END AS link
FROM {pages} p LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) AS rn FROM ({links})) WHERE rn = 1) b ON b.page_id = p.page_id"""


_BEST = _best_sql(LINK_WORDS, "{pages}")
DEFAULT_WORDS = {"suit": content.SUIT_LINKS, "shop": content.SHOP_LINKS, "account": content.ACCOUNT_LINKS}


@query("c8_default_words", f"SELECT page_id, link_score, link FROM ({_best_sql(DEFAULT_WORDS, '{shop_pages}')})")
def _(v: Inputs):
    return content.best_link(v.shop_pages).select("page_id", "link_score", "link")


@query("c8_link_scoring", f"SELECT page_id, link_score, link FROM ({_BEST})")
def _(v: Inputs):
    return content.best_link(v.pages, **LINK_WORDS).select("page_id", "link_score", "link")


@query("c9_secondary_target", f"""SELECT page_id, CASE WHEN {o.k1("target")} <> {o.k1("url")} THEN target END AS target_url
FROM (SELECT b.page_id, b.url, coalesce(b.link, h.hit_url) AS target FROM ({_BEST}) b
 LEFT JOIN {{site_hits}} h ON h.site = 'http://' || {o.k3("b.url")})""")
def _(v: Inputs):
    linked = content.best_link(v.pages, **LINK_WORDS)
    return content.secondary_target(linked, v.site_hits).select("page_id", "target_url")


@query("c10_deep_dive_merge", f"""SELECT c.page_id, CASE WHEN s.content IS NOT NULL THEN c.content || chr(10) || chr(10) || repeat('=', 40) || chr(10)
 || '=== DEEP DIVE: SUITS PAGE ===' || chr(10) || 'URL: ' || s.url || chr(10) || s.content ELSE c.content END AS content
FROM {{contents}} c JOIN {{deep_links}} d ON d.page_id = c.page_id LEFT JOIN {{contents}} s ON {o.k1("s.url")} = {o.k1("d.target_url")}""")
def _(v: Inputs):
    named = v.contents.join(v.deep_links.select("page_id", "target_url"), "page_id")
    merged = content.merge_secondary(named, v.contents.select("url", "content"))
    return merged.select("page_id", "content")


def gated(v: Inputs):
    priced = content.with_average_price(v.contents).drop("content")
    best = ranked(v, 1).select(F.col("vec_id").alias("page_id"), "similarity")
    return priced.join(best, "page_id", "left").withColumn("pos", F.col("page_id"))


_GATED = f"""SELECT page_id, city, url, avg_price, similarity, similarity * 0.7::DOUBLE + CASE WHEN avg_price > 500 THEN 30.0::DOUBLE ELSE 0.0::DOUBLE END AS gate_score
FROM (SELECT c.page_id, c.city, c.url, p.avg_price, coalesce(r.similarity, 0) AS similarity FROM {{contents}} c
 JOIN ({PAGE_PRICE}) p ON p.page_id = c.page_id LEFT JOIN (SELECT vec_id, similarity FROM {{o_ranked}} WHERE rank = 1) r ON r.vec_id = c.page_id)
WHERE NOT (avg_price > 0 AND avg_price < 300) AND NOT (similarity < 45 AND avg_price = 0)"""


@query("c11_finalists", f"""SELECT page_id, city, {o.half_up("gate_score", 4)} AS gate_score FROM (
 SELECT *, row_number() OVER (PARTITION BY city ORDER BY gate_score DESC, page_id) AS rn FROM ({_GATED}) WHERE gate_score >= 25) WHERE rn <= 25""")
def _(v: Inputs):
    top = content.select_finalists(gated(v))
    return top.select("page_id", "city", round_half_up(F.col("gate_score"), 4).alias("gate_score"))


def _walk(leads: str) -> str:
    """Row-by-row walk per city; ``leads`` gives city, pos, name_key, domain, url."""
    return f"""WITH RECURSIVE leads AS ({leads}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY pos) AS rn FROM leads WHERE domain <> '' AND url <> ''),
walk AS (
 SELECT city, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS pos, false AS kept, CAST([] AS VARCHAR[]) AS doms, CAST([] AS VARCHAR[]) AS nms
 FROM (SELECT DISTINCT city FROM numbered)
 UNION ALL
 SELECT city, rn, pos, NOT clash, CASE WHEN clash THEN doms ELSE list_append(doms, domain) END, CASE WHEN clash THEN nms ELSE list_append(nms, name_key) END
 FROM (SELECT n.city, n.rn, n.pos, n.domain, n.name_key, w.doms, w.nms, list_contains(w.doms, n.domain)
   OR len(list_filter(w.nms, lambda s: contains(n.name_key, s) OR contains(s, n.name_key))) > 0 AS clash
  FROM walk w JOIN numbered n ON n.city = w.city AND n.rn = w.rn + 1))
SELECT city, pos FROM walk WHERE kept"""


_LEADS = f"SELECT city, seq AS pos, lower(trim(name)) AS name_key, {o.k3('website_url')} AS domain, website_url AS url FROM {{prospects}}"


@query("c12_final_dedupe", _walk(_LEADS))
def _(v: Inputs):
    leads = content.normalize_leads(content.parse_leads(v.lead_json, LEAD)).withColumnRenamed("seq", "pos")
    return finalists.dedupe_leads(leads).select("city", "pos")


@query("c12_final_dedupe_stretches", _walk(_LEADS))
def _(v: Inputs):
    leads = content.normalize_leads(content.parse_leads(v.lead_json, LEAD)).withColumnRenamed("seq", "pos")
    return finalists.dedupe_leads(leads, fold_limit=0).select("city", "pos")


@query("c12_finalists_fold", _walk(f"""SELECT city, page_id AS pos, 'part ' || CAST(page_id AS VARCHAR) AS name_key, {o.k3("url")} AS domain, url FROM (
 SELECT *, row_number() OVER (PARTITION BY city ORDER BY gate_score DESC, page_id) AS rn FROM ({_GATED}) WHERE gate_score >= 25) WHERE rn <= 25"""))
def _(v: Inputs):
    top = content.select_finalists(gated(v)).select(
        "city", "pos", F.concat(F.lit("Part "), F.col("page_id").cast("string")).alias("name"),
        F.col("url").alias("website_url"))
    return finalists.dedupe_finalists(top, short_lists=True).select("city", "pos")


@query("c13_lead_normalization", """SELECT seq, json_extract_string(payload, '$.name') AS name, json_extract_string(payload, '$.url') AS website_url,
 coalesce(nullif(CAST(json_extract_string(payload, '$.storeCount') AS INTEGER), 0), 1) AS store_count,
 coalesce(CAST(json_extract_string(payload, '$.avgPrice') AS DOUBLE), 0) AS average_suit_price_usd,
 coalesce(json_extract_string(payload, '$.priceSource') = 'found', false) AS verified,
 coalesce(json_extract_string(payload, '$.brandStyle'), 'Premium') AS brand_style,
 coalesce(json_extract_string(payload, '$.businessModel'), 'Retail') AS business_model,
 coalesce(json_extract_string(payload, '$.madeToMeasure') = 'true', false) AS made_to_measure,
 'International' AS origin_country, 'standard' AS location_quality FROM {lead_json}""")
def _(v: Inputs):
    return content.normalize_leads(content.parse_leads(v.lead_json, LEAD)).select(
        "seq", "name", "website_url", "store_count", "average_suit_price_usd", "verified", "brand_style",
        "business_model", "made_to_measure", "origin_country", "location_quality")


@query("c14_price_fill", """SELECT id, usd AS average_suit_price_usd, CASE WHEN eur IS NULL AND usd > 0 THEN usd / 1.08::DOUBLE ELSE eur END AS avg_suit_price_eur
FROM (SELECT id, eur, CASE WHEN u = 0 AND eur <> 0 THEN eur * 1.08::DOUBLE ELSE u END AS usd
 FROM (SELECT id, avg_suit_price_eur AS eur, CAST(CASE WHEN seq % 2 = 0 THEN 0 ELSE seq % 900 END AS DOUBLE) AS u FROM {prospects}))""")
def _(v: Inputs):
    usd = F.expr("CAST(CASE WHEN seq % 2 = 0 THEN 0 ELSE seq % 900 END AS double)")
    rows = v.prospects.select("id", usd.alias("average_suit_price_usd"), "avg_suit_price_eur")
    return content.fill_prices(rows)


@query("c15_usd_threshold", "SELECT request_id, CAST(request_id % 1000 AS DOUBLE) * 1.08::DOUBLE AS price_threshold_usd FROM {city_requests}")
def _(v: Inputs):
    eur = (F.col("request_id") % 1000).cast("double")
    return v.city_requests.select("request_id", content.usd_threshold(eur).alias("price_threshold_usd"))
