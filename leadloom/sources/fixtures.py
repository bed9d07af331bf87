"""Derived input views over the given tables.

One SQL text per view serves Spark and the oracle: only ``||``, ``%`` and plain functions, no ``/`` on
integers, ``floor`` before a double becomes an integer. ``{name}`` stands for a table or another view.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

# Schemas of the given tables, so that no job is spent on reading them from file footers.
TABLES: dict[str, str] = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def _brand_rows(city_shift: int) -> str:
    """Prospect-like rows of ``orders``; the shift decides in how many cities a brand appears."""
    return f"""
SELECT substring(md5(domain || '/p' || seq || '_' || city), 1, 16) AS id, *
FROM (
 SELECT CAST(o_orderkey AS bigint) AS seq,
  'Brand ' || CAST(o_custkey AS varchar(20)) AS name,
  'https://www.brand' || CAST(o_custkey AS varchar(20)) || '.example.com/p' || CAST(o_orderkey AS varchar(20)) AS website_url,
  'brand' || CAST(o_custkey AS varchar(20)) || '.example.com' AS domain,
  lower(n_name) AS city, n_name AS country,
  CASE n_nationkey % 5 WHEN 0 THEN 'GB' WHEN 1 THEN 'ES' WHEN 2 THEN 'PT' WHEN 3 THEN 'XX' ELSE 'AT' END AS country_code,
  CAST(o_orderkey % 36 AS int) AS store_count,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN CAST(0 AS double)
       ELSE CAST(CAST(floor(o_totalprice) AS bigint) % 2600 AS double) END AS avg_suit_price_eur,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'unknown' ELSE lower(c_mktsegment) END AS brand_style,
  CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'Bespoke' ELSE 'Retail' END AS business_model,
  CASE o_orderkey % 4 WHEN 0 THEN '100%' WHEN 1 THEN 'wool blend' WHEN 2 THEN 'unknown' ELSE NULL END AS wool_percentage,
  CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END AS made_to_measure,
  CASE WHEN o_orderkey % 17 = 0 THEN 'rejected' WHEN o_orderstatus = 'O' THEN 'new'
       WHEN o_orderstatus = 'F' THEN 'contacted' ELSE 'converted' END AS status,
  CAST((o_orderkey * 37) % 101 AS int) AS final_score,
  CAST((o_orderkey * 13) % 101 AS int) AS quality_score,
  CAST((o_orderkey * 29) % 11 AS int) AS similarity_score,
  o_orderdate AS discovered_at
 FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey
 JOIN {{nation}} ON n_nationkey = (c_nationkey + o_orderkey % {city_shift}) % 25
) s"""


VIEWS: dict[str, str] = {
    "prospects": _brand_rows(3),
    # Newly found brands: the same companies, partly in cities where they are not stored yet.
    "candidates": _brand_rows(4),
    # Stored prospects with the remaining columns of the table, lists still in their JSON form.
    "stored_rows": """
SELECT p.*,
 'Overview of ' || name AS company_overview,
 CASE seq % 6 WHEN 0 THEN NULL ELSE 'Details of ' || domain END AS detailed_description,
 CASE seq % 5 WHEN 0 THEN NULL WHEN 1 THEN '[]' WHEN 2 THEN 'not json'
  WHEN 3 THEN '["Main ' || city || '"]' ELSE '["Main ' || city || '","North ' || city || '"]' END AS store_locations,
 CASE seq % 5 WHEN 0 THEN '["100% wool","silk"]' WHEN 1 THEN NULL WHEN 2 THEN '[]'
  WHEN 3 THEN 'n/a' ELSE '["wool blend"]' END AS material_composition,
 CASE seq % 4 WHEN 0 THEN 'premium' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE 'standard' END AS location_quality,
 CAST(CASE seq % 3 WHEN 0 THEN 10 WHEN 1 THEN 4 ELSE 0 END AS int) AS location_score,
 CAST((seq * 7) % 101 AS int) AS fit_score,
 'Supplier#' || CAST(seq % 13 AS varchar(20)) AS most_similar_client
FROM {prospects} p""",
    # The older layout: everything is text, numbers and lists may be damaged.
    "legacy_rows": """
SELECT id, name, website_url, domain, city, country, country_code, status,
 CASE WHEN seq % 13 = 0 THEN 'many' WHEN seq % 17 = 0 THEN '12.0' WHEN seq % 19 = 0 THEN ''
  ELSE CAST(store_count AS varchar(20)) END AS store_count,
 CASE WHEN seq % 7 = 0 THEN CAST(final_score AS varchar(20)) || '.5' WHEN seq % 23 = 0 THEN 'n/a'
  ELSE CAST(final_score AS varchar(20)) END AS final_score,
 material_composition, store_locations AS sustainability_certs
FROM {stored_rows}""",
    # Outreach lines of the older layout: text throughout, some times unreadable.
    "legacy_log": """
SELECT brand_name, website_url, status,
 CASE WHEN status = 'failed' THEN 'unknown' ELSE substring(CAST(sent_at AS varchar(40)), 1, 19) END AS sent_at
FROM {outreach_log}""",
    "search_results": """
SELECT lower(n_name) AS city, CAST(o_orderkey % 4 AS int) AS query_index, CAST(o_orderkey AS bigint) AS rank,
 CASE WHEN o_orderkey % 10 = 4 THEN ''
  WHEN o_orderkey % 5 = 0 THEN 'https://www.brand' || b || '.example.com/p' || p
  WHEN o_orderkey % 5 = 1 THEN 'HTTP://WWW.Brand' || b || '.example.com/p' || p
  WHEN o_orderkey % 5 = 2 THEN 'https://brand' || b || '.example.com/p' || p || '/?utm=1'
  WHEN o_orderkey % 5 = 3 THEN 'https://www.brand' || b || '.example.com:8080/p' || p || '#top'
  ELSE 'https://brand' || b || '.example.com/p' || p || '/' END AS url,
 'Title ' || b AS title
FROM (SELECT o.*, CAST(o_custkey AS varchar(20)) AS b, CAST(o_orderkey % 4 AS varchar(20)) AS p FROM {orders} o) o
JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON n_nationkey = c_nationkey""",
    # Search hits as delivered: one row per query call, the hits nested.
    "nested_results": """
SELECT CAST(o_orderkey AS bigint) AS call_id, lower(n_name) AS city, CAST(o_orderkey % 4 AS int) AS query_index,
 array(named_struct('url', 'https://brand' || o_custkey || '.example.com/a', 'title', 'A ' || o_orderkey),
       named_struct('url', 'https://brand' || o_custkey || '.example.com/b', 'title', 'B ' || o_orderkey),
       named_struct('url', 'https://brand' || (o_custkey + 1) || '.example.com/', 'title', o_orderstatus)) AS results
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON n_nationkey = c_nationkey""",
    "contents": """
SELECT page_id, 'nation_' || CAST(page_id % 25 AS varchar(20)) AS city,
 CASE WHEN page_id % 16 = 6 THEN 'https://part' || k || '.example.com/blog/1' ELSE 'https://part' || k || '.example.com/' END AS url,
 CAST(1 + page_id % 3 AS int) AS source,
 CASE page_id % 8
  WHEN 0 THEN 'Bespoke suit ' || nm || ' from €' || u
  WHEN 1 THEN 'Tailor made jacket ' || nm || ' ' || u || ' EUR'
  WHEN 2 THEN 'Menswear blazer ' || nm || ' $' || th || ',' || md
  WHEN 3 THEN 'Sartorial suit ' || nm || ' ' || th || '.' || md || ',00€'
  WHEN 4 THEN 'Suit and blazer ' || nm || ' ' || u || '.00 $'
  WHEN 5 THEN 'Sartorial traje ' || nm || ' price on request'
  WHEN 6 THEN 'Unrelated text ' || nm
  ELSE 'A tailor at 12 New Bond Street, ' || nm || ' £' || u || ' or €' || v END AS content
FROM (SELECT page_id, nm, k, CAST(v AS varchar(20)) AS v, CAST(160 + v % 801 AS varchar(20)) AS u, CAST(CAST(floor(v * 0.001) AS bigint) AS varchar(20)) AS th,
             lpad(CAST(v % 1000 AS varchar(20)), 3, '0') AS md
      FROM (SELECT CAST(p_partkey AS bigint) AS page_id, p_name AS nm, CAST(p_partkey AS varchar(20)) AS k,
                   CAST(1000 + (p_partkey * 37) % 3000 AS bigint) AS v FROM {part}) a) b""",
    # Web pages with links to shops and accounts, some anchors unclosed or without an address.
    "shop_pages": """
SELECT page_id, url, CASE page_id % 5
 WHEN 0 THEN '<a href="/login">Suits</a><a class="x" href="/collections/tailoring">See all</a>'
 WHEN 1 THEN '<a href="/about">About<a href="/wedding">Our wedding suits'
 WHEN 2 THEN '<a data-href="/suits">Suits</a><A HREF="/store">Shop</A>'
 WHEN 3 THEN '<p>no link</p><a name="suit">Suits</a>' ELSE '' END || html AS html
FROM {pages}""",
    # What the selection step says of the brand behind a text page.
    "page_leads": """
SELECT page_id, '{{"name":"Title ' || CAST(page_id AS varchar(20)) || '","country":"' || n_name || '"'
 || CASE WHEN page_id % 6 = 0 THEN '' ELSE ',"storeCount":' || CAST(p_size AS varchar(20)) END
 || CASE WHEN page_id % 4 = 0 THEN '' ELSE ',"avgPrice":' || CAST((page_id * 37) % 1500 AS varchar(20)) END
 || CASE page_id % 3 WHEN 0 THEN ',"woolPercentage":"100%"' WHEN 1 THEN ',"woolPercentage":"wool blend"' ELSE '' END
 || CASE WHEN page_id % 2 = 0 THEN ',"madeToMeasure":true' ELSE '' END || '}}' AS payload
FROM {contents} JOIN {part} ON p_partkey = page_id JOIN {nation} ON n_nationkey = page_id % 25""",
    "countries": """
SELECT n_name AS country,
 CASE n_nationkey % 5 WHEN 0 THEN 'GB' WHEN 1 THEN 'ES' WHEN 2 THEN 'PT' WHEN 3 THEN 'XX' ELSE 'AT' END AS country_code
FROM {nation}""",
    # Page texts that mention what the documented quality bonus looks for.
    "praised": """
SELECT page_id, content || CASE page_id % 11
 WHEN 0 THEN ' Fato 100% Lã, feito à medida' WHEN 1 THEN ' super 170s cloth' WHEN 2 THEN ' SUPER120' WHEN 3 THEN ' super 110s'
 WHEN 4 THEN ' Pure new wool, fully canvassed' WHEN 5 THEN ' Loro Piana and Holland & Sherry, personalised'
 WHEN 6 THEN ' made-to-measure in Italian fabric' WHEN 7 THEN ' british cloth, customizable' WHEN 8 THEN ' lã virgem, sob medida'
 ELSE '' END AS content
FROM {contents}""",
    # Texts of one address fetched by three sources, of very different length.
    "fetched": """
SELECT 'https://doc' || CAST(d.doc_id - d.doc_id % 3 AS varchar(20)) || '.example.com/' AS url,
 CAST(1 + d.doc_id % 3 AS int) AS source, COALESCE(quality, 1) = 1 AS success, text AS content
FROM {documents} d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM {labels} GROUP BY doc_id) l
ON d.doc_id = l.doc_id""",
    # Whole documents as reader output, most of them with a heading below an intro line.
    "reader_pages": """
SELECT doc_id, CASE WHEN lang = 'fr' THEN text
 ELSE 'intro' || chr(10) || '# Title ' || CAST(doc_id AS varchar(20)) || ' ' || chr(10) || text END AS content
FROM {documents}""",
    "clients": """
SELECT CAST(s_suppkey AS bigint) AS client_id, s_name AS name, n_name AS country,
 CASE n_nationkey % 5 WHEN 0 THEN 'GB' WHEN 1 THEN 'ES' WHEN 2 THEN 'PT' WHEN 3 THEN 'XX' ELSE 'AT' END AS country_code,
 lower(n_name) AS city,
 CAST((s_suppkey * 5) % 13 AS int) AS years_as_client,
 CAST((s_suppkey * 7) % 31 AS int) AS store_count,
 CASE WHEN s_suppkey % 9 = 5 THEN NULL ELSE CAST(375 + (s_suppkey * 125) % 1126 AS double) END AS pvp_suits_eur,
 CASE WHEN s_suppkey % 6 = 1 THEN 'blend' ELSE '100%' END AS wool_percentage,
 s_suppkey % 4 <> 1 AS made_to_measure,
 CASE WHEN s_suppkey % 6 = 4 THEN 'multibrand' ELSE 'own_brand' END AS brand_type,
 CASE s_suppkey % 3 WHEN 0 THEN 'furniture' WHEN 1 THEN 'household' ELSE 'machinery' END AS brand_style,
 CASE WHEN s_suppkey % 2 = 0 THEN 'Retail' ELSE 'Bespoke' END AS business_model,
 CASE s_suppkey % 3 WHEN 0 THEN 'high_value' WHEN 1 THEN 'medium_value' ELSE 'low_value' END AS tier
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    # Every client that has a vector, and every vector as the profile of the brand with that number.
    "client_vectors": """
SELECT client_id, name, tier, embedding FROM {clients} JOIN {embeddings} ON client_id = vec_id""",
    "brand_vectors": """
SELECT CAST(vec_id AS bigint) AS vec_id, 'brand' || CAST(vec_id AS varchar(20)) || '.example.com' AS domain, embedding
FROM {embeddings}""",
    "streets": """
SELECT lower(n_name) AS city, 0 AS pos, 'bond street' AS street, 2 AS tier FROM {nation} WHERE n_regionkey <> 4
UNION ALL SELECT lower(n_name), 1, 'new bond street', 1 FROM {nation} WHERE n_regionkey <> 4
UNION ALL SELECT lower(n_name), 2, 'mill lane', 3 FROM {nation} WHERE n_regionkey <> 4""",
    "suppression": """
SELECT 'brand' || CAST(c_custkey AS varchar(20)) || '.example.com' AS domain, 'Unsubscribed' AS reason
FROM {customer} WHERE c_acctbal < 0""",
    # Opt-out requests as they arrive: padded, mixed case, repeated.
    "opt_outs": """
SELECT CAST(event_id AS bigint) AS request_no,
 '  Brand' || CAST(user_id AS varchar(20)) || '.Example.com ' AS domain, event_type AS reason
FROM {events}""",
    # One search order per customer.
    "city_requests": """
SELECT CAST(c_custkey AS bigint) AS request_id,
 CASE c_custkey % 8 WHEN 0 THEN 'Greater London' WHEN 1 THEN 'PARIS 8e' WHEN 2 THEN 'Frankfurt am Main'
  WHEN 3 THEN 'Rome' WHEN 4 THEN 'Madrid' WHEN 5 THEN 'Porto' WHEN 6 THEN 'Boston' ELSE n_name END AS city,
 CASE WHEN c_custkey % 9 = 0 THEN 'Canada' ELSE 'USA' END AS country
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    # Cities asked for: those of the customers plus a suburb for each market segment.
    "wanted_cities": """
SELECT DISTINCT lower(n_name) AS city FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
UNION SELECT DISTINCT lower(n_name) || ' ' || lower(c_mktsegment) FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    # A reviewer's verdict per brand and city.
    "decisions": """
SELECT city, domain, max(seq) % 3 = 0 AS approved FROM {prospects} GROUP BY city, domain""",
    "query_edits": """
SELECT request_id, CAST(request_id % 3 AS int) AS query_index, city || ' edited by reviewer' AS edited
FROM {city_requests}""",
    # Status changes: each returned item line asks for one, several may hit the same prospect.
    "changes": """
SELECT p.id, CAST(l_linenumber AS int) AS change_no,
 CASE CAST(floor(l_quantity) AS bigint) % 5 WHEN 0 THEN 'contacted' WHEN 1 THEN 'converted' WHEN 2 THEN 'rejected'
  WHEN 3 THEN 'archived' ELSE 'new' END AS status,
 CASE WHEN l_linestatus = 'O' THEN 'line ' || CAST(l_linenumber AS varchar(20)) ELSE NULL END AS notes
FROM {lineitem} JOIN {prospects} p ON l_orderkey = p.seq WHERE l_returnflag = 'R'""",
    "outreach_log": """
SELECT 'Brand ' || CAST(user_id AS varchar(20)) AS brand_name,
 'https://www.brand' || CAST(user_id AS varchar(20)) || '.example.com/' AS website_url,
 CASE WHEN event_type = 'purchase' THEN 'success' ELSE 'failed' END AS status,
 CASE WHEN event_type = 'purchase' THEN NULL ELSE event_type END AS error_message, ts AS sent_at
FROM {events}""",
    # What the selection step returns for a brand, as JSON text.
    "lead_json": """
SELECT seq, city,
 '{{"name":"' || name || '","url":"' || website_url || '"'
 || CASE WHEN seq % 5 = 0 THEN '' ELSE ',"storeCount":' || CAST(store_count AS varchar(20)) END
 || CASE WHEN seq % 4 = 0 THEN '' ELSE ',"avgPrice":' || CAST(seq % 1500 AS varchar(20)) END
 || CASE seq % 3 WHEN 0 THEN ',"priceSource":"found"' WHEN 1 THEN ',"priceSource":"not_public"' ELSE '' END
 || CASE WHEN brand_style = 'unknown' THEN '' ELSE ',"brandStyle":"' || brand_style || '"' END
 || CASE WHEN business_model = 'Retail' THEN '' ELSE ',"businessModel":"' || business_model || '"' END
 || CASE WHEN made_to_measure THEN ',"madeToMeasure":true' ELSE '' END
 || '}}' AS payload
FROM {prospects}""",
    # Text pages as search hits of their city, so that the whole chain can run over one input.
    "page_hits": """
SELECT page_id, city, CAST(page_id % 3 AS int) AS query_index, CAST(page_id AS bigint) AS rank, url, 'Title ' || CAST(page_id AS varchar(20)) AS title
FROM {contents}""",
    # A second page per text page (the next one), and a site-search hit per domain.
    "site_hits": """
SELECT 'http://' || host AS site, min('http://' || host || '/hit/' || CAST(page_id AS varchar(20))) AS hit_url
FROM (SELECT page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host FROM {pages}) h GROUP BY host""",
    "deep_links": """
SELECT page_id, url, 'HTTPS://WWW.part' || CAST(page_id + 1 AS varchar(20)) || '.example.com' AS target_url FROM {contents}""",
}

# The oracle's own spelling, where the nested-type constructors differ.
ORACLE_VIEWS: dict[str, str] = {
    "nested_results": """
SELECT CAST(o_orderkey AS bigint) AS call_id, lower(n_name) AS city, CAST(o_orderkey % 4 AS int) AS query_index,
 [{{'url': 'https://brand' || o_custkey || '.example.com/a', 'title': 'A ' || o_orderkey}},
  {{'url': 'https://brand' || o_custkey || '.example.com/b', 'title': 'B ' || o_orderkey}},
  {{'url': 'https://brand' || (o_custkey + 1) || '.example.com/', 'title': o_orderstatus}}] AS results
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON n_nationkey = c_nationkey""",
}

_REF = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def references(sql: str) -> list[str]:
    """Names used in a text, each once, in order."""
    return list(dict.fromkeys(_REF.findall(sql)))


def frame(
    spark: SparkSession, sf_dir: str, name: str, built: dict[str, DataFrame] | None = None
) -> DataFrame:
    """A given table or a derived view as a lazy DataFrame; ``built`` keeps what was analyzed before."""
    built = {} if built is None else built
    if name not in built:
        if name in TABLES:
            path = os.path.join(sf_dir, f"{name}.parquet")
            built[name] = spark.read.schema(TABLES[name]).parquet(path)
        else:
            used = {r: frame(spark, sf_dir, r, built) for r in references(VIEWS[name])}
            built[name] = spark.sql(VIEWS[name], **used)
    return built[name]


def oracle_with(body: str) -> str:
    """Oracle text: ``body`` may name views as ``{view}``; they become CTEs in front of it."""
    ordered: dict[str, str] = {}

    def add(name: str) -> None:
        if name in TABLES or name in ordered:
            return
        sql = ORACLE_VIEWS.get(name, VIEWS.get(name, ""))
        for r in references(sql):
            add(r)
        ordered[name] = sql.format(**{r: r for r in references(sql)})

    used = references(body)
    for r in used:
        add(r)
    text = body.format(**{r: r for r in used}).strip()
    if not ordered:
        return text
    ctes = ",\n".join(f"{n} AS ({s.strip()})" for n, s in ordered.items())
    if text[:5].upper() == "WITH ":
        recursive = text[5:].lstrip().upper().startswith("RECURSIVE ")
        rest = text[5:].lstrip()[10:] if recursive else text[5:]
        return f"WITH {'RECURSIVE ' if recursive else ''}{ctes},\n{rest.strip()}"
    return f"WITH {ctes}\n{text}"
