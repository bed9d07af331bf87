"""Registered queries of the numbered operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm import (
    byte_cnn, fill_middle, importance, lang_profiles, line_rules, mtree, packing, pieces, simhash, site_style, token_counts, url_rules,
    warc,
)
from leadloom.llm.common import held_out, table

PIECE_MODEL = "piece_bpe_32k.model"
WORD_MODEL = "word_bpe_49k.json"
BYTE_MODEL = "byte_bpe_50k.json"
#: Tokens beyond which op 12 calls a text too long.
TOKEN_LIMIT = 512
HOST_RULES = (
    url_rules.HostRule("allow", "org"),
    url_rules.HostRule("block", "example.org", "/es/"),
    url_rules.HostRule("block", "example.org", "/en/1"),
    url_rules.HostRule("allow", "com", "/fr/"),
    url_rules.HostRule("block", "com", "/de/"),
)


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return site_style.main_text(pages).withColumn("n_chars", F.length("text").cast("long"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    net = byte_cnn.train(byte_cnn.sample(documents, table(spark, sf_dir, "labels", "doc_id", "quality")))
    scored = byte_cnn.score(documents, net)
    return scored.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score",
        F.when(F.col("score") >= byte_cnn.THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip_digests(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_file(PIECE_MODEL))


def op4_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    return url_rules.judge(pages, HOST_RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_rules.judge(table(spark, sf_dir, "documents", "doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = lang_profiles.learn(lang_profiles.sample(table(spark, sf_dir, "documents", "doc_id", "text", "lang")))
    found = lang_profiles.identify(table(spark, sf_dir, "documents", "doc_id", "text"), profiles)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_file(WORD_MODEL))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.written_and_read(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return read.select(
        F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def op10_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_products(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents", "doc_id", "text"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(made), 256).alias("restored_sha256"),
    )


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_file(BYTE_MODEL))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    drawn = importance.resample(documents, table(spark, sf_dir, "benchmark", "text"))
    return drawn.select(F.col("doc_id").cast("long").alias("doc_id"), *importance.RESULTS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_main_text, op2_quality, op3_pieces, op4_url_verdicts, op5_line_rules, op6_language, op7_near_duplicates,
        op8_packing, op9_warc, op10_top_products, op11_fill_middle,
        op12_token_counts, op13_importance_resampling,
    )
}


def _host_rules_sql() -> tuple[str, str]:
    """CASE expressions for the rule's text and verdict, longest rule first."""
    text, verdict = [], []
    for r in sorted(HOST_RULES, key=lambda r: -len(r.text)):
        fits = f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
        text.append(f"{fits} THEN '{r.text}'")
        verdict.append(f"{fits} THEN '{r.verdict}'")
    return f"CASE {' '.join(text)} END", f"CASE {' '.join(verdict)} END"


def _op4_sql() -> str:
    text, verdict = _host_rules_sql()
    blocked = " OR ".join(f"regexp_matches(lower(url), '{r.pattern}')" for r in url_rules.PATTERNS)
    return f"""
        WITH parts AS (
            SELECT page_id, url,
                coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages)
        SELECT page_id, host, path, {text} AS rule,
            coalesce({verdict}, CASE WHEN coalesce({blocked}, false) THEN 'block' ELSE 'allow' END) AS verdict
        FROM parts"""


def _op5_sql() -> str:
    gap, word = r"[ \t\n\x0B\f\r]+", r"[^ \t\n\x0B\f\r]"
    marks = line_rules.MARKS
    phrases = "|".join(line_rules.PHRASES)
    fails = f"""
        len(regexp_extract_all(x, '{marks}')) * 100 >= length(x) * {line_rules.MARK_PERCENT}
        OR (len(regexp_extract_all(x, '{line_rules.SEPARATOR}')) >= {line_rules.SEPARATORS}
            AND length(x) <= (len(regexp_extract_all(x, '{line_rules.SEPARATOR}')) + 1) * {line_rules.ITEM_CHARS})
        OR (length(x) <= {line_rules.PHRASE_LINE_CHARS} AND regexp_matches(lower(x), '{phrases}'))"""
    return rf"""
        WITH texts AS (
            SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        words AS (
            SELECT *, list_filter(string_split_regex(text, '{gap}'), lambda x: x <> '') AS words,
                list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines
            FROM texts),
        windows AS (
            SELECT r, i, list_slice(words, i, i + 2) AS w
            FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM words)),
        again AS (SELECT r, w FROM windows GROUP BY r, w HAVING count(*) > 1),
        covered AS (
            SELECT r, count(DISTINCT place) AS n
            FROM (SELECT r, unnest([i, i + 1, i + 2]) AS place FROM windows SEMI JOIN again USING (r, w))
            GROUP BY r),
        counted AS (
            SELECT doc_id, len(words)::BIGINT AS n_words,
                length(array_to_string(words, ''))::BIGINT AS word_chars,
                len(regexp_extract_all(text, '{line_rules.SYMBOL}'))::BIGINT AS n_symbols,
                (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
                coalesce(n, 0)::BIGINT AS n_repeat_words,
                list_sum(list_transform(list_filter(list_distinct(lines), lambda x: NOT ({fails})),
                    lambda x: length(regexp_replace(x, '{gap}', '', 'g')))) AS kept_chars
            FROM words LEFT JOIN covered USING (r))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
            n_words < {line_rules.LEAST_WORDS}
                OR 100 * n_repeat_words > {line_rules.MOST_REPEAT_PERCENT} * n_words AS base_failed,
            NOT (n_words < {line_rules.LEAST_WORDS}
                OR 100 * n_repeat_words > {line_rules.MOST_REPEAT_PERCENT} * n_words)
                AND 100 * coalesce(kept_chars, 0) >= {line_rules.LEAST_KEPT_PERCENT} * word_chars AS kept
        FROM counted"""


OP9_SQL = f"""
    WITH payloads AS (
        SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
    keepers AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS keeper FROM payloads)
    SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
        CASE WHEN payload_bytes >= {warc.LEAST_REVISIT_BYTES} AND page_id <> keeper THEN 'revisit' ELSE 'response' END
            AS record_type,
        CASE WHEN payload_bytes >= {warc.LEAST_REVISIT_BYTES} AND page_id <> keeper THEN keeper END AS refers_to
    FROM keepers"""

OP10_SQL = f"""
    WITH vectors AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor({mtree.SCALE} * x::DOUBLE)) AS v
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    products AS (
        SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
        FROM vectors q JOIN vectors c ON q.vec_id % {mtree.QUERY_EVERY} = 0 AND q.vec_id <> c.vec_id),
    ranked AS (
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
            vec_id, score
        FROM products)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {mtree.TOP}"""

OP11_SQL = f"""
    WITH texts AS (
        SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
            regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
            sha256('{fill_middle.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS hex
        FROM documents),
    drawn AS (
        SELECT *, len(units)::BIGINT AS n, ('0x' || hex[1:8])::BIGINT AS h1, ('0x' || hex[9:16])::BIGINT AS h2,
            ('0x' || hex[17:24])::BIGINT AS h3, ('0x' || hex[25:32])::BIGINT AS h4
        FROM texts),
    parts AS (
        SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
            CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90
                THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
        FROM drawn),
    three AS (
        SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle,
            array_to_string(units[b + 1:], '') AS suffix
        FROM parts)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
        CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
            ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
        sha256(text) AS restored_sha256
    FROM three"""

OP13_SQL = rf"""
    WITH words AS (
        SELECT row_number() OVER () AS r, doc_id, true AS mine, text FROM documents
        UNION ALL SELECT row_number() OVER (), NULL, false, text FROM benchmark),
    cut AS (
        SELECT r, doc_id, mine, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM words),
    features AS (
        SELECT r, doc_id, mine, len(w)::BIGINT AS n_words,
            list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f
        FROM cut),
    each AS (SELECT r, mine, unnest(f) AS g FROM features),
    remainders AS (
        SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i:
            CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t),
    hashed AS (
        SELECT g, xor(4294967295, list_reduce(
            list_transform(range(strlen(g)), lambda i: ('0x' || substr(hex(encode(g)), 2 * i + 1, 2))::BIGINT),
            lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295::BIGINT)) % {importance.BUCKETS} AS bucket
        FROM (SELECT DISTINCT g FROM each), remainders),
    counted AS (
        SELECT bucket, count(*) FILTER (mine) AS s, count(*) FILTER (NOT mine) AS t
        FROM each JOIN hashed USING (g) GROUP BY bucket),
    gains AS (
        SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + {importance.BUCKETS})::DOUBLE
            / ((s + 1)::DOUBLE * (sum(t) OVER () + {importance.BUCKETS})::DOUBLE))) AS gain
        FROM counted),
    weights AS (
        SELECT r, floor(sum(gain) / count(*))::BIGINT AS weight
        FROM each JOIN hashed USING (g) JOIN gains USING (bucket) WHERE mine GROUP BY r),
    scored AS (
        SELECT r, doc_id, n_words, len(f)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
            coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{importance.SEED}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT
                + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
        FROM features LEFT JOIN weights USING (r) WHERE mine),
    placed AS (
        SELECT *, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, r) AS place, count(*) OVER () AS n
        FROM scored WHERE n_words >= {importance.LEAST_WORDS})
    SELECT doc_id, n_features, weight, score, place::BIGINT AS rank FROM placed WHERE place <= {importance.PERCENT} * n // 100
    UNION ALL
    SELECT doc_id, n_features, weight, score, NULL FROM placed WHERE place > {importance.PERCENT} * n // 100
    UNION ALL
    SELECT doc_id, n_features, weight, score, NULL FROM scored WHERE n_words < {importance.LEAST_WORDS}"""

ORACLES: dict[str, str] = {
    "op4_url_verdicts": _op4_sql(), "op5_line_rules": _op5_sql(), "op9_warc": OP9_SQL, "op10_top_products": OP10_SQL,
    "op11_fill_middle": OP11_SQL, "op13_importance_resampling": OP13_SQL,
}
