"""Registered reads and writes (IO, M), outreach (O), incremental ingest (S) and the whole chain."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from leadloom.operators import clients, outreach, writes
from leadloom.plans import oracle_text as o
from leadloom.plans import qualification
from leadloom.functions import text
from leadloom.functions.exprs import round_half_up
from leadloom.plans.catalog_discovery import _MEAN, _relevance
from leadloom.plans.catalog_scoring import POINTS, ranked, scored
from leadloom.plans.registry import Inputs, query
from leadloom.schemas import OUTREACH_LOG
from leadloom.sizing import work_folder
from leadloom.sources import kept_counts, records, store
from leadloom.streaming import ingest

NOW = "2026-01-01 00:00:00"


def now():
    return F.to_timestamp(F.lit(NOW))


# ---------------------------------------------------------------- sources and sinks

STORED = ["id", "domain", "city", "store_count", "avg_suit_price_eur", "final_score", "location_quality", "status"]


def saved_prospects(v: Inputs, where: str = "true") -> str:
    """Write the prospects of the input as a stored table; return its folder."""
    path = work_folder(v.spark, "prospects")
    rows = records.import_legacy(v.stored_rows.filter(where).drop("seq", "wool_percentage"))
    store.append_prospects(rows, path, now())
    return path


@query("io1_read_prospects", """SELECT id, domain, city, store_count, coalesce(avg_suit_price_eur, 0) AS avg_suit_price_eur, final_score,
 coalesce(location_quality, 'standard') AS location_quality, status FROM {stored_rows}""")
def _(v: Inputs):
    return store.read_prospects(v.spark, saved_prospects(v)).select(STORED)


@query("io2_append_prospects", """SELECT id, domain, city, store_count, coalesce(avg_suit_price_eur, 0) AS avg_suit_price_eur, final_score,
 coalesce(location_quality, 'standard') AS location_quality, status FROM {stored_rows}
UNION ALL SELECT id, domain, city, store_count, coalesce(avg_suit_price_eur, 0), CAST(trunc(final_score) AS INTEGER), 'standard', 'new' FROM {o_new_candidates}""")
def _(v: Inputs):
    path = saved_prospects(v)
    fresh = writes.qualify_batch(v.candidates, v.prospects, lambda df: scored(v, df.drop("final_score")), ["seq"])
    store.append_prospects(fresh, path, now())
    return store.read_prospects(v.spark, path).select(STORED)


def _json_list(c: str) -> str:
    return f"CASE WHEN json_valid({c}) THEN coalesce(array_to_string(json_extract_string({c}, '$[*]'), '|'), '') ELSE '' END"


@query("io3_legacy_import", f"""SELECT id, status, coalesce(TRY_CAST(CASE WHEN regexp_full_match(store_count, '[0-9]+') THEN store_count END AS INTEGER), 0) AS store_count,
 coalesce(CAST(trunc(TRY_CAST(final_score AS DOUBLE)) AS INTEGER), 0) AS final_score,
 {_json_list("material_composition")} AS materials, {_json_list("sustainability_certs")} AS certs FROM {{legacy_rows}}""")
def _(v: Inputs):
    rows = records.import_legacy(v.legacy_rows)
    return rows.select(
        "id", "status", "store_count", "final_score", F.array_join("material_composition", "|").alias("materials"),
        F.array_join("sustainability_certs", "|").alias("certs"))


_LENIENT = "coalesce(TRY_CAST(CASE WHEN regexp_full_match(l.store_count, '[0-9]+') THEN l.store_count END AS INTEGER), 0)"


@query("io3_import_stored", f"""SELECT l.id, l.name || ' (legacy)' AS name, l.status, l.city,
 CASE WHEN s.id IS NULL THEN {_LENIENT} ELSE s.store_count END AS store_count FROM {{legacy_rows}} l
LEFT JOIN (SELECT * FROM {{stored_rows}} WHERE status = 'contacted') s ON s.id = l.id""")
def _(v: Inputs):
    path = saved_prospects(v, "status = 'contacted'")
    older = records.import_legacy(v.legacy_rows).withColumn("name", F.concat("name", F.lit(" (legacy)")))
    store.upsert_prospects(v.spark, path, older, now=now())
    return store.read_prospects(v.spark, path).select("id", "name", "status", "city", "store_count")


@query("io3_log_import", """SELECT brand_name, website_url, status, error_message, sent_at FROM {outreach_log}
UNION ALL SELECT brand_name, website_url, status, NULL, TRY_CAST(sent_at AS TIMESTAMP) FROM {legacy_log}""")
def _(v: Inputs):
    path = work_folder(v.spark, "log")
    store.append_log(records.import_log(v.outreach_log), path)
    store.append_log(records.import_log(v.legacy_log), path)
    log = v.spark.read.schema(OUTREACH_LOG).parquet(path)
    return log.withColumn("sent_at", F.col("sent_at").cast("timestamp_ntz"))


@query("io4_flatten_results", """SELECT call_id, city, query_index, CAST(pos - 1 AS INTEGER) AS rank, hit.url AS url, hit.title AS title
FROM (SELECT call_id, city, query_index, unnest(results) AS hit, generate_subscripts(results, 1) AS pos FROM {nested_results})""")
def _(v: Inputs):
    return records.flatten_results(v.nested_results)


@query("io5_response_mapping", f"""SELECT id, coalesce(avg_suit_price_eur, 0) * 1.08::DOUBLE AS "averageSuitPriceUSD", status <> 'new' AS verified,
 coalesce(avg_suit_price_eur, 0) > 0 AS "priceKnown",
 'Pontuação: ' || final_score || '.0/100|Similar a: ' || most_similar_client AS "verificationLog", coalesce(detailed_description, '') AS "detailedDescription",
 {_json_list("store_locations")} AS "storeLocations", coalesce(nullif(location_quality, ''), CASE WHEN location_score > 0 THEN 'premium' ELSE 'standard' END) AS "locationQuality",
 location_score AS "locationScore", fit_score AS "fitScore",
 CASE WHEN json_valid(material_composition) THEN json_extract_string(material_composition, '$[0]') END AS "woolPercentage",
 coalesce(made_to_measure, false) AS "madeToMeasure" FROM {{stored_rows}}""")
def _(v: Inputs):
    return records.api_records(v.stored_rows).select(
        "id", "averageSuitPriceUSD", "verified", "priceKnown",
        F.array_join("verificationLog", "|").alias("verificationLog"), "detailedDescription",
        F.array_join("storeLocations", "|").alias("storeLocations"), "locationQuality", "locationScore",
        "fitScore", "woolPercentage", "madeToMeasure")


# ---------------------------------------------------------------- changes


def new_candidates(v: Inputs):
    return writes.qualify_batch(v.candidates, v.prospects, lambda df: scored(v, df), ["seq"])


@query("m1_qualify_and_save", f"SELECT {', '.join(POINTS)}, domain, city FROM {{o_new_candidates}}")
def _(v: Inputs):
    return new_candidates(v).select(*POINTS, "domain", "city")


@query("m1_batch_report", """SELECT city, CAST(count(*) AS BIGINT) AS candidates, count(DISTINCT domain) FILTER (NOT known) AS new_saved,
 count(*) - count(DISTINCT domain) FILTER (NOT known) AS duplicates_skipped
FROM (SELECT c.city, c.domain, EXISTS (SELECT 1 FROM {prospects} p WHERE p.city = c.city AND p.domain = c.domain) AS known FROM {candidates} c) GROUP BY city""")
def _(v: Inputs):
    return writes.batch_report(v.candidates, v.prospects)


@query("m1_save_report", """WITH after AS (SELECT city, domain, id, final_score FROM {prospects}
 UNION ALL SELECT city, domain, id, CAST(trunc(final_score) AS INTEGER) FROM {o_new_candidates}),
report AS (SELECT city, CAST(count(*) AS BIGINT) AS candidates, count(DISTINCT domain) FILTER (NOT known) AS new_saved
 FROM (SELECT c.city, c.domain, EXISTS (SELECT 1 FROM {prospects} p WHERE p.city = c.city AND p.domain = c.domain) AS known FROM {candidates} c) GROUP BY city),
listed AS (SELECT city, string_agg(domain || ':' || final_score, '|' ORDER BY domain) AS listing, CAST(count(*) AS INTEGER) AS total_for_city FROM (
 SELECT *, row_number() OVER (PARTITION BY city ORDER BY domain) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY city, domain ORDER BY final_score DESC NULLS FIRST, id) AS rn FROM after) WHERE rn = 1) WHERE place <= 25 GROUP BY city)
SELECT r.city, candidates, new_saved, candidates - new_saved AS duplicates_skipped, total_prospects, top_score, total_for_city, listing
FROM report r JOIN (SELECT city, count(*) AS total_prospects, max(final_score) AS top_score FROM after GROUP BY city) s ON s.city = r.city
JOIN listed l ON l.city = r.city""")
def _(v: Inputs):
    report = writes.save_report(v.candidates, v.prospects, new_candidates(v))
    line = F.transform("prospects", lambda x: F.concat_ws(":", x["domain"], x["final_score"]))
    return report.select(
        "city", "candidates", "new_saved", "duplicates_skipped", "total_prospects", "top_score", "total_for_city",
        F.array_join(line, "|").alias("listing"))


@query("m2_insert_or_ignore", """SELECT domain, reason FROM {suppression} UNION ALL
SELECT domain, reason FROM (SELECT lower(trim(domain)) AS domain, reason, row_number() OVER (PARTITION BY lower(trim(domain)) ORDER BY request_no) AS rn FROM {opt_outs}) a
WHERE rn = 1 AND domain NOT IN (SELECT domain FROM {suppression})""")
def _(v: Inputs):
    return writes.suppress(v.suppression, v.opt_outs)


@query("m3_upsert", """SELECT coalesce(p.id, n.id) AS id, CASE WHEN n.id IS NULL THEN p.name ELSE n.name || ' (new)' END AS name,
 CASE WHEN n.id IS NULL THEN p.website_url ELSE n.website_url || '/new' END AS website_url,
 CASE WHEN p.id IS NULL THEN n.city ELSE p.city END AS city, CASE WHEN p.id IS NULL THEN n.final_score + 1000 ELSE p.final_score END AS final_score
FROM {prospects} p FULL JOIN {candidates} n ON p.id = n.id""")
def _(v: Inputs):
    columns = ["id", "name", "website_url", "city", "final_score"]
    incoming = v.candidates.select(
        "id", F.concat("name", F.lit(" (new)")).alias("name"),
        F.concat("website_url", F.lit("/new")).alias("website_url"), "city",
        (F.col("final_score") + 1000).alias("final_score"))
    return writes.upsert(v.prospects.select(columns), incoming, "id", ["name", "website_url"])


_GONE = "SELECT lower(n_name) AS city FROM {nation} JOIN {region} ON n_regionkey = r_regionkey WHERE r_regionkey >= 3 UNION SELECT 'atlantis'"


def _gone(v: Inputs):
    named = v.nation.join(v.region.filter("r_regionkey >= 3"), F.col("n_regionkey") == F.col("r_regionkey"))
    atlantis = v.region.select(F.lit("  Atlantis ").alias("city")).distinct()
    return named.select(F.col("n_name").alias("city")).unionByName(atlantis)


@query("m3_upsert_stored", """SELECT coalesce(p.id, n.id) AS id, CASE WHEN n.id IS NULL THEN p.name ELSE n.name || ' (new)' END AS name,
 CASE WHEN n.id IS NULL THEN p.website_url ELSE n.website_url || '/new' END AS website_url,
 CASE WHEN p.id IS NULL THEN n.city ELSE p.city END AS city, CASE WHEN p.id IS NULL THEN n.status ELSE p.status END AS status,
 CASE WHEN p.id IS NULL THEN n.final_score ELSE p.final_score END AS final_score
FROM {stored_rows} p FULL JOIN {candidates} n ON p.id = n.id""")
def _(v: Inputs):
    path = saved_prospects(v)
    incoming = v.candidates.drop("seq", "wool_percentage").withColumns({
        "name": F.concat("name", F.lit(" (new)")), "website_url": F.concat("website_url", F.lit("/new"))})
    store.upsert_prospects(v.spark, path, incoming, now=now())
    return store.read_prospects(v.spark, path).select("id", "name", "website_url", "city", "status", "final_score")


@query("m4_update_stored", """SELECT p.id, p.city, CASE WHEN c.id IS NULL THEN p.status ELSE c.status END AS status, c.notes
FROM {stored_rows} p LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY change_no DESC, status DESC, notes DESC NULLS LAST) AS rn FROM {changes}
 WHERE status <> 'archived') WHERE rn = 1) c ON c.id = p.id""")
def _(v: Inputs):
    path = saved_prospects(v)
    store.change_status(v.spark, path, v.changes.withColumn("turn", F.struct("change_no", "status", "notes")), "turn", now())
    return store.read_prospects(v.spark, path).select("id", "city", "status", "notes")


@query("m5_remove_stored", f"""SELECT id, city FROM {{stored_rows}} WHERE id NOT IN (SELECT id FROM {{changes}} WHERE status = 'rejected')
 AND city NOT IN ({_GONE})""")
def _(v: Inputs):
    path = saved_prospects(v)
    store.remove_ids(v.spark, path, v.changes.filter("status = 'rejected'"))
    store.drop_cities(v.spark, path, _gone(v))
    return store.read_prospects(v.spark, path).select("id", "city")


_COUNTED = f"""(SELECT p.id, p.city, p.final_score, CASE WHEN c.id IS NULL THEN p.status ELSE c.status END AS status FROM {{stored_rows}} p
 LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY change_no DESC, status DESC, notes DESC NULLS LAST) AS rn FROM {{changes}}
  WHERE status <> 'archived') WHERE rn = 1) c ON c.id = p.id
 WHERE p.city NOT IN ({_GONE}) AND p.id NOT IN (SELECT id FROM {{changes}} WHERE status = 'archived'))"""


def _counted(v: Inputs) -> kept_counts.CountedStore:
    """A counted store after batches, status changes, removals and dropped cities."""
    folder = work_folder(v.spark, "counted")
    counted = kept_counts.CountedStore(v.spark, os.path.join(folder, "rows"), os.path.join(folder, "counts"))
    rows = records.import_legacy(v.stored_rows.drop("seq", "wool_percentage"))
    half = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    counted.append(rows.filter(half), "first", now())
    counted.append(rows.filter(~half), "second", now())
    counted.change_status(v.changes.withColumn("turn", F.struct("change_no", "status", "notes")), "changes", "turn", now())
    counted.compact()
    counted.remove_ids(v.changes.filter("status = 'archived'"), "archived")
    counted.drop_cities(_gone(v), "gone")
    return counted


@query("m1_kept_rollup", f"""SELECT city, count(*) AS total_prospects, avg(final_score) AS avg_score, max(final_score) AS top_score,
 count(*) FILTER (status = 'new') AS new_count, count(*) FILTER (status = 'contacted') AS contacted_count,
 count(*) FILTER (status = 'converted') AS converted_count FROM {_COUNTED} GROUP BY city""")
def _(v: Inputs):
    return _counted(v).city_rollup()


@query("m4_update_status", """SELECT p.id, CASE WHEN c.id IS NULL THEN p.status ELSE c.status END AS status, CASE WHEN c.id IS NULL THEN 'old note' ELSE c.notes END AS notes
FROM {prospects} p LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY change_no DESC, status DESC, notes DESC NULLS LAST) AS rn FROM {changes}
 WHERE status <> 'archived') WHERE rn = 1) c ON c.id = p.id""")
def _(v: Inputs):
    rows = v.prospects.select("id", "status").withColumn("notes", F.lit("old note"))
    ordered = v.changes.withColumn("turn", F.struct("change_no", "status", "notes"))
    return writes.update_status(rows, ordered, "turn")


@query("m4_rejected_changes", "SELECT id, change_no, status FROM {changes} WHERE status NOT IN ('new','contacted','converted','rejected')")
def _(v: Inputs):
    return writes.rejected_changes(v.changes).select("id", "change_no", "status")


@query("m5_delete_by_ids", "SELECT id, city FROM {prospects} WHERE id NOT IN (SELECT id FROM {changes} WHERE status = 'rejected')")
def _(v: Inputs):
    return writes.delete_ids(v.prospects, v.changes.filter("status = 'rejected'")).select("id", "city")


@query("m5_delete_by_cities", f"SELECT id, city FROM {{prospects}} WHERE city NOT IN ({_GONE})")
def _(v: Inputs):
    return writes.delete_cities(v.prospects, _gone(v)).select("id", "city")


@query("m5_deleted_per_city", f"""SELECT g.city, count(p.id) AS deleted FROM ({_GONE}) g LEFT JOIN {{prospects}} p ON p.city = g.city GROUP BY g.city""")
def _(v: Inputs):
    return writes.deleted_per_city(v.prospects, _gone(v))


def client_table(v: Inputs):
    """Clients in the stored layout, with text ids and vectors."""
    vec = v.client_vectors.select("client_id", "embedding")
    return v.clients.join(vec, "client_id").withColumn(
        "id", F.concat(F.lit("client_"), F.col("client_id").cast("string"))
    ).withColumn("profile_text", F.lit("old"))


@query("m6_refresh_clients", """SELECT 'client_' || client_id AS id, name, 'size ' || store_count AS size_text,
 position('is a menswear brand' IN name || ' is a menswear brand') > 0 AS renewed FROM {clients}""")
def _(v: Inputs):
    table = client_table(v).select("id", "name", "country", "city", "store_count", "profile_text", "brand_type", "pvp_suits_eur", "embedding")
    stored = table.filter("store_count > 10")  # an incomplete store
    out = writes.refresh_clients(stored, table)
    return out.select(
        "id", "name", F.concat(F.lit("size "), "store_count").alias("size_text"),
        F.contains("profile_text", F.lit("is a menswear brand")).alias("renewed"))


@query("m7_promote_converted", """SELECT 'client_' || client_id AS id, name, store_count, 'old' AS profile_text FROM {clients}
UNION ALL SELECT id, name, store_count, name || ' is a menswear brand from ' || city || ', ' || country || '. They are a '
 || CASE WHEN store_count <= 5 THEN 'small boutique' WHEN store_count <= 20 THEN 'medium chain' ELSE 'large chain' END
 || ' selling ' || CASE WHEN coalesce(avg_suit_price_eur, 0) <> 0 THEN 'suits priced at €' || CAST(CAST(avg_suit_price_eur AS BIGINT) AS VARCHAR) ELSE 'price not public' END
 || '.' FROM {prospects} WHERE status = 'converted'""")
def _(v: Inputs):
    table = client_table(v).select(
        "id", "name", "country", "country_code", "city", "store_count", "brand_style", "business_model", "profile_text")
    return writes.promote_converted(table, v.prospects).select("id", "name", "store_count", "profile_text")


# ---------------------------------------------------------------- outreach

_HOST = "regexp_extract(website_url, '^https?://(?:www\\.)?([^/?#]*)', 1)"


@query("o1_outreach_batch", f"""SELECT id, domain, 'info@' || domain AS contact, 'Novo Potencial Cliente: ' || name AS subject,
 'Novo cliente detetado: ' || name || chr(10) || 'Website: ' || website_url || chr(10) || 'Cidade: ' || city AS body,
 CASE WHEN avg_suit_price_eur > 0 THEN '€' || CAST(CAST(avg_suit_price_eur AS BIGINT) AS VARCHAR) ELSE '$0' END AS price_text
FROM ({o.first_per("{prospects}", "domain", "id")})
WHERE domain NOT IN (SELECT domain FROM {{suppression}}) AND domain NOT IN (SELECT {_HOST} FROM {{outreach_log}} WHERE status = 'success')""")
def _(v: Inputs):
    batch = outreach.outreach_batch(v.prospects, v.suppression, v.outreach_log)
    return batch.select("id", "domain", "contact", "subject", "body", "price_text")


@query("o2_outreach_log", f"""SELECT brand_name, website_url, status, error_message, sent_at FROM {{outreach_log}}
UNION ALL SELECT name, website_url, 'success', NULL, TIMESTAMP '{NOW}' FROM ({o.first_per("{prospects}", "domain", "id")})
WHERE domain NOT IN (SELECT domain FROM {{suppression}}) AND domain NOT IN (SELECT {_HOST} FROM {{outreach_log}} WHERE status = 'success')""")
def _(v: Inputs):
    batch = outreach.outreach_batch(v.prospects, v.suppression, v.outreach_log)
    log = outreach.append_log(v.outreach_log, outreach.log_rows(batch, at=now()))
    return log.withColumn("sent_at", F.col("sent_at").cast("timestamp_ntz"))


# ---------------------------------------------------------------- incremental ingest and the whole chain

STREAM_SQL = """SELECT CAST(o_orderkey AS bigint) AS pos, 'Brand ' || CAST(o_custkey AS string) AS name,
 'https://www.brand' || CAST(o_custkey AS string) || '.example.com/p' || CAST(o_orderkey AS string) AS website_url,
 lower(n_name) AS city, n_name AS country, CAST(o_orderkey % 36 AS int) AS store_count
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON n_nationkey = (c_nationkey + o_orderkey % 4) % 25"""


@query("s1_incremental_ingest", """SELECT id, domain, city, store_count FROM (SELECT c.*, row_number() OVER (PARTITION BY c.city, c.domain ORDER BY c.seq) AS rn
 FROM {candidates} c ANTI JOIN {prospects} p ON p.city = c.city AND p.domain = c.domain) WHERE rn = 1""")
def _(v: Inputs):
    orders = ingest.candidate_stream(v.spark, os.path.join(v.sf_dir, "orders.parquet"), v.orders.schema)
    stream = v.spark.sql(STREAM_SQL, orders=orders, customer=v.customer, nation=v.nation)
    folder = work_folder(v.spark, "ingest")
    path = os.path.join(folder, "store")
    ingest.start_ingest(
        stream, path, os.path.join(folder, "checkpoint"), lambda df: df, ["pos"], v.prospects, now()
    ).awaitTermination()
    return store.read_or_empty(v.spark, path).select("id", "domain", "city", "store_count")


@query("s1_stateful_ingest", """SELECT id, domain, city, store_count FROM (SELECT c.*, row_number() OVER (PARTITION BY c.city, c.domain ORDER BY c.seq) AS rn
 FROM {candidates} c ANTI JOIN {prospects} p ON p.city = c.city AND p.domain = c.domain) WHERE rn = 1""")
def _(v: Inputs):
    orders = ingest.candidate_stream(v.spark, os.path.join(v.sf_dir, "orders.parquet"), v.orders.schema)
    stream = v.spark.sql(STREAM_SQL, orders=orders, customer=v.customer, nation=v.nation)
    folder = work_folder(v.spark, "ingest")
    path = os.path.join(folder, "store")
    ingest.start_stateful_ingest(
        stream, path, os.path.join(folder, "checkpoint"), lambda df: df, ["pos"], v.prospects, now()
    ).awaitTermination()
    return store.read_or_empty(v.spark, path).select("id", "domain", "city", "store_count")


_CHAIN = f"""WITH RECURSIVE chosen AS (
 SELECT page_id, city, url, content FROM {{contents}} WHERE content <> '' AND NOT (source = 2 AND length(content) <= 500)),
texts AS (SELECT c.page_id, c.city, c.url, CASE WHEN s.content IS NOT NULL THEN c.content || chr(10) || chr(10) || repeat('=', 40) || chr(10)
  || '=== DEEP DIVE: SUITS PAGE ===' || chr(10) || 'URL: ' || s.url || chr(10) || s.content ELSE c.content END AS t
 FROM chosen c JOIN {{page_hits}} h ON h.page_id = c.page_id AND h.query_index < 3 JOIN {{deep_links}} d ON d.page_id = c.page_id
 LEFT JOIN chosen s ON {o.k1("s.url")} = {o.k1("d.target_url")}
 WHERE NOT regexp_matches(lower(c.url), '{"|".join(text.DIRECTORY_WORDS)}')),
priced AS (SELECT x.page_id, city, url, avg_price, similarity, tier FROM (
  SELECT page_id, city, url, {_MEAN} AS avg_price FROM texts) x
 JOIN (SELECT page_id, {_relevance(text.RELEVANT_WORDS, text.STRONG_WORDS)} AS relevance
  FROM (SELECT page_id, substring(lower(t), 1, 5000) AS t FROM texts)) y ON y.page_id = x.page_id AND relevance >= 2
 LEFT JOIN (SELECT vec_id, similarity FROM {{o_ranked}} WHERE rank = 1) r ON r.vec_id = x.page_id
 LEFT JOIN (SELECT page_id, arg_min(tier, pos) AS tier FROM texts JOIN {{streets}} s ON s.city = texts.city AND contains(lower(t), s.street)
  GROUP BY page_id) z ON z.page_id = x.page_id),
gated AS (SELECT *, coalesce(similarity, 0) * 0.7::DOUBLE + CASE WHEN avg_price > 500 THEN 30.0::DOUBLE ELSE 0.0::DOUBLE END AS gate_score FROM priced
 WHERE NOT (avg_price > 0 AND avg_price < 300) AND NOT (coalesce(similarity, 0) < 45 AND avg_price = 0)),
numbered AS (SELECT * FROM (SELECT g.*, payload, lower(json_extract_string(payload, '$.name')) AS name_key,
  CAST(row_number() OVER (PARTITION BY city ORDER BY gate_score DESC, page_id) AS INTEGER) AS place
 FROM gated g JOIN {{page_leads}} USING (page_id) WHERE gate_score >= 25) WHERE place <= 25),
walk AS (
 SELECT city, 0 AS place, CAST(NULL AS BIGINT) AS page_id, false AS kept, CAST([] AS VARCHAR[]) AS nms FROM (SELECT DISTINCT city FROM numbered)
 UNION ALL
 SELECT city, place, page_id, NOT clash, CASE WHEN clash THEN nms ELSE list_append(nms, name_key) END
 FROM (SELECT n.city, n.place, n.page_id, n.name_key, w.nms, len(list_filter(w.nms, lambda s: contains(n.name_key, s) OR contains(s, n.name_key))) > 0 AS clash
  FROM walk w JOIN numbered n ON n.city = w.city AND n.place = w.place + 1)),
leads AS (SELECT n.*, coalesce(nullif(CAST(json_extract_string(payload, '$.storeCount') AS INTEGER), 0), 1) AS store_count,
  json_extract_string(payload, '$.woolPercentage') AS wool_percentage, coalesce(json_extract_string(payload, '$.madeToMeasure') = 'true', false) AS made_to_measure,
  coalesce(nullif(avg_price, 0), nullif(CAST(json_extract_string(payload, '$.avgPrice') AS DOUBLE), 0) / 1.08::DOUBLE) AS avg_suit_price_eur, country_code, share
 FROM numbered n JOIN walk w ON w.page_id = n.page_id AND w.kept JOIN {{countries}} ON country = json_extract_string(payload, '$.country')
 LEFT JOIN {{o_market}} USING (country_code))
SELECT city, regexp_extract(url, '^https?://([^/?#]*)', 1) AS domain, place, store_count, country_code,
 CASE tier WHEN 1 THEN 10 WHEN 2 THEN 7 WHEN 3 THEN 4 ELSE 0 END AS location_score, CASE WHEN tier IS NULL THEN 'standard' ELSE 'premium' END AS location_quality,
 {o.half_up("avg_suit_price_eur", 4)} AS avg_suit_price_eur, {o.REASON} AS rejection_reason,
 {o.half_up(f"CASE WHEN {o.REASON} IS NULL THEN {o.TOTAL} ELSE least({o.TOTAL}, 40.0::DOUBLE) END", 2)} AS final_score
FROM leads"""


@query("whole_qualification", _CHAIN)
def whole_qualification(v: Inputs):
    best = ranked(v, 1).select(F.col("vec_id").alias("page_id"), "similarity")
    out = qualification.qualify_cities(
        v.page_hits, v.contents.withColumn("success", F.lit(True)), v.deep_links, v.page_leads, v.countries, best,
        v.suppression, v.streets, clients.market_strength(v.clients), v.prospects)
    return out.select(
        "city", "domain", "place", "store_count", "country_code", "location_score", "location_quality",
        round_half_up(F.col("avg_suit_price_eur"), 4).alias("avg_suit_price_eur"), "rejection_reason", "final_score")
