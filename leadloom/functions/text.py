"""Expressions over page text: relevance words, prices, titles, quality bonuses."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions.exprs import as_col, let, strip

# Relevance words of the trade, words that mark a directory page, strong words.
RELEVANT_WORDS = (
    "suit", "fato", "jacket", "blazer", "tailor", "sartorial",
    "bespoke", "abito", "traje", "costume", "menswear", "moda",
)
DIRECTORY_WORDS = (
    "yelp", "tripadvisor", "directory", "pages", "list", "blog", "news", "guide", "ranking",
)
STRONG_WORDS = ("suit", "tailor", "bespoke", "sartorial")
RELEVANCE_WINDOW = 5000
STRONG_BONUS = 3
RELEVANCE_MIN = 2

# Currency signs, the number form inside a price, words that announce a price.
CURRENCY = "[$€£]"
AMOUNT = r"(\d{1,3}(?:[,.]\d{3})*(?:[.,]\d{2})?)"
PRICE_WORDS = ("price", "prix", "preço", "preis", "precio", "from", r"starting\s+at", r"a\s+partir\s+de")
PRICE_LOW, PRICE_HIGH = 150, 6000

# Page text limits and marker.
TITLE_LIMIT = 15000
TRUNCATION_MARK = "\n\n[Content truncated...]"

# Documented quality bonuses, in points, with a cap of 100. The last form of a cloth grade is any
# "super" number from 120 on.
QUALITY_BONUS = (
    ("wool", 25, ("100% wool", "pure wool", "pure new wool", "100% lã", "pura lã", "lã virgem")),
    ("made_to_measure", 20, ("made to measure", "made-to-measure", "bespoke", "mtm", "por medida", "à medida", "sob medida")),
    ("italian_cloth", 15, ("loro piana", "italian fabric", "italian cloth")),
    ("british_cloth", 15, ("holland & sherry", "british fabric", "british cloth")),
    ("super_grade", 10, re.compile(r"super\s*(?:1[2-9][0-9]|2[0-9][0-9])")),
    ("canvassed", 10, ("canvassed",)),
    ("customization", 5, ("customiz", "personaliz", "personalis")),
)


def any_word(text: Column, words: Sequence[str]) -> Column:
    """True when any word occurs in the text (plain substring, as in ``suitable`` for ``suit``)."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def relevance_score(
    content: Column | str,
    words: Sequence[str] = RELEVANT_WORDS,
    strong: Sequence[str] = STRONG_WORDS,
    window: int | None = RELEVANCE_WINDOW,
) -> Column:
    """Distinct relevance words present, plus a bonus for a strong word.

    ``window`` is the number of leading characters that count by definition (lower-cased first, then
    cut); ``None`` looks at the whole text.
    """
    text = F.lower(F.coalesce(as_col(content), F.lit("")))
    if window is not None:
        text = F.substring(text, 1, window)

    def score(t: Column) -> Column:
        hits = reduce(lambda a, b: a + b, [F.contains(t, F.lit(w)).cast("int") for w in words])
        return hits + F.when(any_word(t, strong), F.lit(STRONG_BONUS)).otherwise(F.lit(0))

    return let(text, score)


def is_directory_url(url: Column | str, words: Sequence[str] = DIRECTORY_WORDS) -> Column:
    return let(F.lower(F.coalesce(as_col(url), F.lit(""))), lambda u: any_word(u, words))


def mentions_price(content: Column | str) -> Column:
    """A currency amount or a price word with a number.

    Only the presence counts, so a digit next to the sign decides and the rest of the number need not be
    matched. Most texts have no digit at all and are done after one plain scan; the case-insensitive
    search runs on the lower-cased text, which is several times faster than the matching flag.
    """
    text = as_col(content)
    signed = text.rlike(rf"(?U){CURRENCY}\s?\d|\d\s?{CURRENCY}")
    announced = F.lower(text).rlike(rf"(?U)(?:{'|'.join(PRICE_WORDS)})\s*[:=]?\s*{CURRENCY}?\d")
    return F.coalesce(text.rlike(r"\p{Nd}") & (signed | announced), F.lit(False))


def _amount(m: Column) -> Column:
    """Digits without separators; with both separators present the last two digits are cents."""
    digits = F.regexp_replace(m, "[,.]", "").try_cast("double")
    both = F.contains(m, F.lit(",")) & F.contains(m, F.lit("."))
    return F.when(both, digits / F.lit(100.0)).otherwise(digits)


def price_values(content: Column | str, low: float = PRICE_LOW, high: float = PRICE_HIGH) -> Column:
    """All plausible amounts: sign before, sign after, then ``EUR`` after the number."""
    text = as_col(content)
    forms = (rf"(?U){CURRENCY}\s?{AMOUNT}", rf"(?U){AMOUNT}\s?{CURRENCY}", rf"(?U){AMOUNT}\s?EUR")
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in forms])
    return F.filter(F.transform(found, _amount), lambda v: (v > F.lit(low)) & (v < F.lit(high)))


def average_price(content: Column | str, low: float = PRICE_LOW, high: float = PRICE_HIGH) -> Column:
    """Mean plausible amount of a text, 0 when there is none.

    Three capturing scans run only on texts that contain a currency mark at all.
    """
    text = as_col(content)
    mean = let(
        price_values(text, low, high),
        lambda vs: F.when(
            F.size(vs) > 0, F.aggregate(vs, F.lit(0.0), lambda a, v: a + v) / F.size(vs)
        ).otherwise(F.lit(0.0)),
    )
    return F.when(text.rlike(f"{CURRENCY}|EUR"), F.coalesce(mean, F.lit(0.0))).otherwise(F.lit(0.0))


def truncated(content: Column | str, limit: int | None = TITLE_LIMIT, mark: str = TRUNCATION_MARK) -> Column:
    """Text beyond the limit is replaced by a marker; ``None`` keeps whole texts."""
    text = as_col(content)
    if limit is None:
        return text
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(mark))
    ).otherwise(text)


def heading_title(content: Column | str) -> Column:
    """First line that starts with ``# ``, without the mark; empty when there is none."""
    return strip(F.regexp_extract(as_col(content), r"(?:^|\n)# ([^\n]*)", 1))


def quality_bonus(content: Column | str, rules=QUALITY_BONUS, cap: int = 100) -> Column:
    """Documented quality points of a text: one bonus per feature found, capped."""

    def points(t: Column) -> Column:
        def found(words: Sequence[str] | re.Pattern) -> Column:
            return t.rlike(words.pattern) if isinstance(words, re.Pattern) else any_word(t, words)

        parts = [F.when(found(words), F.lit(p)).otherwise(F.lit(0)) for _, p, words in rules]
        return F.least(reduce(lambda a, b: a + b, parts), F.lit(cap))

    return let(F.lower(F.coalesce(as_col(content), F.lit(""))), points)
