"""URL rules found by their rarest literal token.

A pattern rule is a regular expression over the lower-cased url with at least one literal token: a run of
letters and digits that any matching url holds as a whole token. Each rule is filed under the one of its tokens
that is rarest among all urls; the tokens of a url fetch the rules filed under them, and only those candidates
run their expression. Host and path rules (longest fitting rule wins) are decided first; where none fits, the
pattern rules give the verdict: block if any candidate matches, else allow.

Everything is a DataFrame expression. Null urls and urls without ``://`` have an empty host and path; they match
host rules never and pattern rules by their text (null: none). Rows that repeat are judged alike, other columns
of the input are passed through unless they are named like a result.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class HostRule(NamedTuple):
    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


class PatternRule(NamedTuple):
    name: str
    pattern: str
    tokens: tuple[str, ...]


#: Default block patterns: advertising, tracking, log-in, shop and adult addresses.
PATTERNS = (
    PatternRule("adserver", r"[/.-]adserver[/.-]", ("adserver",)),
    PatternRule("doubleclick", r"\bdoubleclick\b", ("doubleclick",)),
    PatternRule("banner_ads", r"/banner[/_-]ads?\b", ("banner",)),
    PatternRule("affiliate", r"[?&]affiliate([_-]id)?=", ("affiliate",)),
    PatternRule("login_form", r"/(account|user)/login\b", ("login",)),
    PatternRule("cart", r"/cart/checkout\b", ("cart", "checkout")),
    PatternRule("wp_login", r"/wp-login\.php\b", ("wp", "login", "php")),
    PatternRule("cgi_bin", r"/cgi-bin/", ("cgi", "bin")),
    PatternRule("casino", r"[/.-]casino[/.-]", ("casino",)),
    PatternRule("poker", r"[/.-]online-poker\b", ("online", "poker")),
    PatternRule("porn", r"\bporn\b", ("porn",)),
    PatternRule("xxx", r"[/.-]xxx[/.-]", ("xxx",)),
    PatternRule("torrent", r"/torrent/[^/]+/download\b", ("torrent", "download")),
    PatternRule("session_id", r"[?&;]jsessionid=[0-9a-f]{8,}", ("jsessionid",)),
    PatternRule("mail_to", r"/share/email\b", ("share", "email")),
    PatternRule("print_view", r"[?&]print=(1|true)\b", ("print",)),
    PatternRule("calendar", r"/calendar/\d{4}/\d{2}\b", ("calendar",)),
    PatternRule("feed_xml", r"/feed/(rss|atom)\b", ("feed",)),
)

def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?`` or ``#``, with A-Z lower-cased; empty without a ``://``."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?`` or ``#``; empty without a ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_rule(host: Column, path: Column, rules: Sequence[HostRule]) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits host or superdomain and path start; null if none fits.

    Of rules of one length the one with the longer host wins, then a block.
    """
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), len(r.host), r.verdict == "block")):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def url_tokens(url: Column) -> Column:
    """Distinct runs of letters and digits of the lower-cased url."""
    return F.array_distinct(F.filter(F.split(F.lower(url), "[^a-z0-9]+"), lambda t: t != ""))


def rule_index(urls: DataFrame, rules: Sequence[PatternRule], url_col: str = "url") -> DataFrame:
    """(token, name, pattern): each rule under its token that the fewest urls hold; ties to the first in order."""
    spark = urls.sparkSession
    filed = spark.createDataFrame([(r.name, r.pattern, t) for r in rules for t in r.tokens], "name string, pattern string, token string")
    wanted = sorted({t for r in rules for t in r.tokens})
    held = F.array_intersect(url_tokens(F.col(url_col)), F.array(*map(F.lit, wanted)))
    counts = urls.select(F.explode(held).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    order = Window.partitionBy("name").orderBy(F.coalesce("n", F.lit(0)), "token")
    rarest = filed.join(counts, "token", "left").withColumn("_k", F.row_number().over(order))
    return rarest.filter("_k = 1").select("token", "name", "pattern")


def matches(urls: DataFrame, rules: Sequence[PatternRule] = PATTERNS, url_col: str = "url") -> DataFrame:
    """Distinct urls that some pattern rule matches, with the least rule name: (url, pattern_rule).

    Only tokens that some rule is filed under leave the scan, so that the shuffle is as small as the candidates.
    """
    index = rule_index(urls, rules, url_col)
    wanted = sorted({t for r in rules for t in r.tokens})
    held = F.array_intersect(url_tokens(F.col(url_col)), F.array(*map(F.lit, wanted)))
    asked = urls.select(F.col(url_col).alias("_url"), F.explode(held).alias("token"))
    found = asked.join(index, "token").filter(F.rlike(F.lower("_url"), F.col("pattern")))
    return found.groupBy("_url").agg(F.min("name").alias("pattern_rule"))


def judge(
    urls: DataFrame, host_rules: Sequence[HostRule], rules: Sequence[PatternRule] = PATTERNS, url_col: str = "url"
) -> DataFrame:
    """The frame with host, path, rule, pattern_rule and verdict."""
    results = {"host", "path", "rule", "pattern_rule", "verdict"}
    kept = [F.col(f"`{c}`") for c in urls.columns if c.lower() not in results]
    url = F.col(url_col)
    text, verdict = host_rule(F.col("host"), F.col("path"), host_rules)
    judged = (
        urls.select(*kept, host_of(url).alias("host"), path_of(url).alias("path"))
        .withColumns({"rule": text, "_given": verdict})
        .join(matches(urls, rules, url_col), url == F.col("_url"), "left")
    )
    own = F.when(F.col("pattern_rule").isNotNull(), "block").otherwise("allow")
    return judged.withColumn("verdict", F.coalesce("_given", own)).drop("_given", "_url")
