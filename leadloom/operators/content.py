"""Qualification of page text: source choice, relevance, prices, links, final selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import keys, text
from leadloom.functions.exprs import as_col, falsy_to, let, strip
from leadloom.operators.common import top_per_key

# Length limits of the source fallback.
SHORT, CUT = 500, 12000

# Link words and their points.
SUIT_LINKS = (
    "suit", "fatos", "fato", "traje", "abito", "tailoring", "sartorial", "ceremony", "wedding",
)
SHOP_LINKS = ("shop", "store", "collection", "loja", "comprar", "boutique", "catalog")
ACCOUNT_LINKS = ("login", "account", "cart", "basket", "checkout")
SUIT_TEXT, SUIT_HREF, SHOP_TEXT, SHOP_HREF, ACCOUNT_HREF, LINK_MIN = 10, 5, 2, 1, -50, 2

# Header between a page and its second page.
DEEP_DIVE = "\n\n" + "=" * 40 + "\n=== DEEP DIVE: SUITS PAGE ===\nURL: "

# Candidate gate.
GATE_PRICE, GATE_SIMILARITY, GATE_WEIGHT = 300, 45, 0.7
GATE_HIGH_PRICE, GATE_BONUS, GATE_MIN_SCORE, FINALISTS = 500, 30, 25, 25

EUR_USD = 1.08

# an anchor ends with its end tag, at the next anchor or with the page, so that no unclosed one is scanned twice
ANCHOR = r"(?is)<a\s(?:[^>]*?\s)?href\s*=[^>]*>[^<]*+(?:<(?!/?a[\s>])[^<]*+)*+"
HREF = r"""(?is)^<a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
ANCHOR_TEXT = r"(?is)^<a\s[^>]*>(.*)$"


# ---------------------------------------------------------------- choice of the source


def _source(n: int, column: Column) -> Column:
    return F.max(F.when(F.col("source") == n, column))


def choose_source(fetched: DataFrame, short: int = SHORT, cut: int | None = CUT) -> DataFrame:
    """Per URL the text of the first good source of three, in one shuffle on the URL.

    ``cut`` is the length to which the definition cuts sources 2 and 3; ``None`` keeps them whole.
    Sources 2 and 3 are used only cut, so they are cut before the shuffle, and a source 2 that is too
    short to be used is not sent at all.
    """
    body = F.col("content")
    fallback = body if cut is None else F.substring(body, 1, cut)
    useful = (
        F.when((F.col("source") == 2) & (F.length(body) <= short), F.lit(None))
        .when(F.col("source") == 3, F.when(F.col("success"), fallback))
        .when(F.col("source") == 2, fallback)
        .otherwise(body)
    )
    wide = (
        fetched.select("url", "source", useful.alias("useful"))
        .groupBy("url")
        .agg(
            _source(1, F.col("useful")).alias("c1"),
            _source(2, F.col("useful")).alias("c2"),
            _source(3, F.col("useful")).alias("c3"),
        )
    )
    ok = F.length("c1") >= short
    return wide.select(
        "url",
        F.when(ok, F.col("c1")).otherwise(F.coalesce("c2", "c3", "c1")).alias("content"),
        F.when(ok, 1)
        .when(F.col("c2").isNotNull(), 2)
        .when(F.col("c3").isNotNull(), 3)
        .when(F.col("c1").isNotNull(), 1)
        .alias("source"),
    )


def choose_of_two(primary: DataFrame, secondary: DataFrame, short: int = SHORT) -> DataFrame:
    """Primary text when long enough, else a strictly longer secondary text; flags tell what happened."""
    s = secondary.filter("success").select("url", F.col("content").alias("other"))
    p = F.coalesce("content", F.lit(""))
    ok = F.length(p) >= short
    longer = F.coalesce(F.length("other"), F.lit(0)) > F.length(p)
    return primary.join(s, "url", "left").select(
        "url",
        F.when(~ok & longer, F.col("other")).otherwise(p).alias("content"),
        F.when(~ok & longer, "secondary").otherwise("primary").alias("source"),
        (ok | longer | (F.length(p) > 0)).alias("success"),
        (~ok).alias("used_fallback"),
        (~ok & ~longer).alias("fallback_failed"),
    )


def with_title(pages: DataFrame, limit: int | None = text.TITLE_LIMIT) -> DataFrame:
    """Cut overlong text with a marker; title from the first heading of what is left."""
    return pages.withColumn("content", text.truncated("content", limit)).withColumn(
        "title", text.heading_title("content")
    )


def extracted(contents: DataFrame) -> DataFrame:
    return contents.filter(F.col("content").isNotNull() & (F.col("content") != ""))


def extraction_rate(contents: DataFrame, *by: str) -> DataFrame:
    hit = F.col("content").isNotNull() & (F.col("content") != "")
    return contents.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(hit).alias("extracted")
    ).withColumn("rate", F.try_divide("extracted", "total"))


# ---------------------------------------------------------------- relevance and prices


def relevant(
    contents: DataFrame,
    words: Sequence[str] = text.RELEVANT_WORDS,
    strong: Sequence[str] = text.STRONG_WORDS,
    directory: Sequence[str] = text.DIRECTORY_WORDS,
    window: int | None = text.RELEVANCE_WINDOW,
    minimum: int = text.RELEVANCE_MIN,
) -> DataFrame:
    """Keep trade pages; the cheap URL test runs before the text scan."""
    kept = contents.filter(~text.is_directory_url("url", directory))
    return kept.withColumn(
        "relevance", text.relevance_score("content", words, strong, window)
    ).filter(F.col("relevance") >= minimum)


def with_price_flag(contents: DataFrame) -> DataFrame:
    return contents.withColumn("mentions_price", text.mentions_price("content"))


def with_average_price(contents: DataFrame) -> DataFrame:
    return contents.withColumn("avg_price", text.average_price("content"))


# ---------------------------------------------------------------- second page


def _link(anchor: Column, pos: Column, suit: Sequence[str], shop: Sequence[str], account: Sequence[str]):
    raw = F.concat(*[F.regexp_extract(anchor, HREF, g) for g in (1, 2, 3)])
    href = strip(F.lower(raw))
    label = F.lower(F.regexp_replace(F.regexp_extract(anchor, ANCHOR_TEXT, 1), r"(?s)<[^>]*>", " "))
    skip = (href == "") | href.startswith("#") | href.startswith("javascript")

    def points(flag: Column, p: int) -> Column:
        return F.when(flag, F.lit(p)).otherwise(F.lit(0))

    score = (
        points(text.any_word(label, suit), SUIT_TEXT)
        + points(text.any_word(href, suit), SUIT_HREF)
        + points(text.any_word(label, shop), SHOP_TEXT)
        + points(text.any_word(href, shop), SHOP_HREF)
        + points(text.any_word(href, account), ACCOUNT_HREF)
    )
    return F.when(~skip, F.struct(score.alias("score"), (-pos).alias("neg_pos"), raw.alias("href")))


def resolve_url(base: Column | str, href: Column) -> Column:
    """An ``href`` as an absolute URL, seen from the page it stands on."""
    base, href = as_col(base), strip(F.replace(href, F.lit("&amp;"), F.lit("&")))
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    root = F.regexp_extract(base, r"^((?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*)", 1)
    no_query = F.regexp_replace(base, r"[?#].*$", "")
    path = F.substr(no_query, F.length(root) + 1)
    folder = F.concat(root, F.when(path == "", "/").otherwise(F.regexp_replace(path, r"[^/]*$", "")))
    joined = (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?"), F.concat(no_query, href))
        .otherwise(F.concat(folder, href))
    )
    return F.when(joined.rlike(r"/\.{1,2}(?:[/?#]|$)"), _without_dot_segments(joined)).otherwise(joined)


def _without_dot_segments(url: Column) -> Column:
    """Fold ``.`` and ``..`` in the path."""
    root = F.regexp_extract(url, r"^((?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*)", 1)
    rest = F.substr(url, F.length(root) + 1)
    path, tail = F.regexp_extract(rest, r"^([^?#]*)", 1), F.regexp_extract(rest, r"([?#].*)$", 1)
    parts = F.split(F.regexp_replace(path, r"^/", ""), "/")
    empty = F.array().cast("array<string>")
    kept = F.aggregate(
        parts,
        empty,
        lambda acc, s: F.when(
            s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        ).when(s == ".", acc).otherwise(F.concat(acc, F.array(s))),
    )
    closing = F.when(path.rlike(r"/\.{1,2}$"), "/").otherwise("")
    return F.concat(root, F.lit("/"), F.array_join(kept, "/"), closing, tail)


def best_link(
    pages: DataFrame,
    html: str = "html",
    suit: Sequence[str] = SUIT_LINKS,
    shop: Sequence[str] = SHOP_LINKS,
    account: Sequence[str] = ACCOUNT_LINKS,
    minimum: int = LINK_MIN,
) -> DataFrame:
    """The best link of each page, resolved; null when no link scores enough.

    A page's links stay in its row: the winner is the largest (score, earliest position), found in the
    same projection without exploding or shuffling.
    """
    anchors = F.regexp_extract_all(as_col(html), F.lit(ANCHOR), F.lit(0))
    links = F.transform(anchors, lambda a, i: _link(a, i, suit, shop, account))
    best = F.array_max(F.filter(links, lambda x: x.isNotNull()))
    return (
        pages.withColumn("_best", best)
        .withColumn(
            "link",
            F.when(F.col("_best.score") >= minimum, resolve_url("url", F.col("_best.href"))),
        )
        .withColumn("link_score", F.col("_best.score"))
        .drop("_best")
    )


def secondary_target(pages: DataFrame, hits: DataFrame) -> DataFrame:
    """Second page to read: the best link, else a site-search hit; never the page itself."""
    h = hits.select("site", "hit_url")
    joined = pages.withColumn(
        "site", F.concat(F.lit("http://"), keys.discovery_domain("url"))
    ).join(h, "site", "left")
    target = F.coalesce("link", "hit_url")
    other = keys.discovery_url_key(target) != keys.discovery_url_key("url")
    return joined.withColumn("target_url", F.when(other, target)).drop("site", "hit_url")


def merge_secondary(contents: DataFrame, second: DataFrame) -> DataFrame:
    """Append the text of the second page under a header.

    ``second`` has (url, content) of the pages read; ``contents`` names its page in ``target_url``. A blank
    target or address matches nothing. Only texts that some page asks for are shuffled, and a page without a
    target has a null key, so that such pages never meet in one task.
    """

    def key(url: str) -> Column:
        k = keys.discovery_url_key(url)
        return F.when(k != "", k)

    texts = extracted(second).select(
        key("url").alias("target_key"), F.col("url").alias("second_url"), F.col("content").alias("second_text"),
    ).filter("target_key is not null")
    keyed = contents.withColumn("target_key", key("target_url"))
    wanted = keyed.select("target_key").filter("target_key is not null").distinct()
    s = top_per_key(texts.join(wanted, "target_key", "left_semi"), ["target_key"], ["second_url", "second_text"])
    merged = F.concat(F.col("content"), F.lit(DEEP_DIVE), F.col("second_url"), F.lit("\n"), F.col("second_text"))
    return (
        keyed.join(s, "target_key", "left")
        .withColumn("content", F.coalesce(merged, "content"))
        .drop("target_key", "second_url", "second_text")
    )


# ---------------------------------------------------------------- selection


def gate_score(similarity: Column, price: Column) -> Column:
    bonus = F.when(price > GATE_HIGH_PRICE, F.lit(float(GATE_BONUS))).otherwise(F.lit(0.0))
    return similarity * F.lit(GATE_WEIGHT) + bonus


def select_finalists(candidates: DataFrame, k: int = FINALISTS, place: str | None = None) -> DataFrame:
    """Gate by price and similarity, then the best ``k`` per city; the sort is stable on ``pos``.

    ``place`` names a column for the rank within the city.
    Reads ``avg_price`` and ``similarity`` (null means no client to compare with).
    """
    price = F.coalesce("avg_price", F.lit(0.0))
    sim = F.coalesce("similarity", F.lit(0.0))
    # the price is often an expression over the text that a pushed filter would repeat: bind it once
    too_cheap = let(price, lambda p: (p > 0) & (p < GATE_PRICE))
    passed = candidates.filter(
        ~too_cheap & ~((sim < GATE_SIMILARITY) & (price == 0))
    ).withColumn("gate_score", gate_score(sim, price))
    return top_per_key(
        passed.filter(F.col("gate_score") >= GATE_MIN_SCORE),
        ["city"],
        [F.col("gate_score").desc(), F.col("pos")],
        k,
        rank_name=place,
    )


# ---------------------------------------------------------------- lead records


def parse_leads(raw: DataFrame, schema, payload: str = "payload") -> DataFrame:
    """JSON text of one lead per row -> columns."""
    keep = [c for c in raw.columns if c != payload]
    return raw.withColumn("lead", F.from_json(payload, schema)).select(*keep, "lead.*")


def normalize_leads(leads: DataFrame, keep: Sequence[str] = ("seq", "city")) -> DataFrame:
    """Defaults for what the selection left out (fixed values); ``keep`` names columns passed through."""
    return leads.select(
        *[c for c in keep if c in leads.columns],
        F.coalesce("name", F.lit("Unknown")).alias("name"),
        F.coalesce("url", F.lit("")).alias("website_url"),
        falsy_to("storeCount", 1).alias("store_count"),
        F.coalesce("avgPrice", F.lit(0.0)).alias("average_suit_price_usd"),
        F.coalesce("country", F.lit("International")).alias("origin_country"),
        F.coalesce(F.col("priceSource") == "found", F.lit(False)).alias("verified"),
        F.coalesce("brandStyle", F.lit("Premium")).alias("brand_style"),
        F.coalesce("businessModel", F.lit("Retail")).alias("business_model"),
        F.coalesce("whySelected", F.lit("")).alias("company_overview"),
        F.col("detailedDescription").alias("detailed_description"),
        F.coalesce("storeLocations", F.array().cast("array<string>")).alias("store_locations"),
        F.coalesce("locationQuality", F.lit("standard")).alias("location_quality"),
        F.coalesce("fitScore", F.lit(0)).alias("fit_score"),
        F.col("woolPercentage").alias("wool_percentage"),
        F.coalesce("madeToMeasure", F.lit(False)).alias("made_to_measure"),
    )


def fill_prices(leads: DataFrame, rate: float = EUR_USD) -> DataFrame:
    """Fill the dollar price from the euro price, then the euro price from the dollar price."""
    usd, eur = F.col("average_suit_price_usd"), F.col("avg_suit_price_eur")
    has_eur = F.coalesce(eur != 0, F.lit(False))
    return leads.withColumn(
        "average_suit_price_usd", F.when((usd == 0) & has_eur, eur * rate).otherwise(usd)
    ).withColumn("avg_suit_price_eur", F.when(eur.isNull() & (usd > 0), usd / rate).otherwise(eur))


def usd_threshold(eur: Column | str, rate: float = EUR_USD) -> Column:
    return as_col(eur) * F.lit(rate)


def lead_price_text(eur: Column, usd: Column) -> Column:
    """Euro price when known, else the dollar price, without decimals."""
    return F.when(
        F.coalesce(eur > 0, F.lit(False)), F.concat(F.lit("€"), F.bround(eur, 0).cast("bigint"))
    ).otherwise(F.concat(F.lit("$"), F.bround(F.coalesce(usd, F.lit(0.0)), 0).cast("bigint")))
