"""URL rules and line rules against plain Python versions."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leadloom.llm import line_rules, url_rules
from leadloom.llm.queries import HOST_RULES

URLS = [
    None, "", "no scheme", "http://Example.ORG", "http://example.org/", "https://www.example.org/es/1?x#y", "http://example.org/en/12",
    "http://example.org/en/2", "http://notexample.org/es/", "http://a.com/fr/x", "http://com/de/", "http://a.com/de", "http://a.com?u=http://b.org/",
    "ftp://a.net/x/doubleclick/y", "http://a.net/online-poker", "http://a.net/poker", "http://A.net/WP-LOGIN.php?x", "http://a.net/wp-login",
    "http://a.net/calendar/2020/01", "http://a.net/calendar/20/01", "http://a.com/de/casino/", "http://a.net/x?print=1&y", "http://é.net/É/porn",
    "x://y://z.org/fr/", "http://a.net/a b\nc", "http://a.org:80/x", "http://a.net/" + "a/" * 30_000 + "xxx/", "http://a.net/account/login",
]


def plain_verdict(url):
    text = url or ""
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", text)
    host, path = (found[1], found[2]) if found else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in HOST_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        best = max(fits, key=lambda r: len(r.text))
        return host, path, best.text, best.verdict
    hit = any(re.search(r.pattern, text.lower()) for r in url_rules.PATTERNS)
    return host, path, None, "block" if hit else "allow"


def test_urls(spark):
    df = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate([*URLS, *URLS])], "page_id long, url string, host string, verdict string")
    out = url_rules.judge(df, HOST_RULES)
    assert out.columns == ["page_id", "url", "host", "path", "rule", "pattern_rule", "verdict"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert got == {k: plain_verdict(u) for k, u in enumerate([*URLS, *URLS])}
    assert {v[3] for v in got.values() if v[2] is None} == {"allow", "block"}
    assert url_rules.judge(df.limit(0), HOST_RULES).count() == 0


def test_every_match_holds_its_tokens():
    """What lets the index skip a rule: a url without the rule's token cannot match it."""
    samples = [u for u in URLS if u] + ["http://x.net/banner-ads", "http://x.net/?affiliate_id=1", "http://x.net/cgi-bin/x", "http://x/feed/rss"]
    for rule in url_rules.PATTERNS:
        for url in samples:
            if re.search(rule.pattern, url.lower()):
                assert set(rule.tokens) <= set(re.split("[^a-z0-9]+", url.lower())), (rule.name, url)


def test_rules_are_filed_under_their_rarest_token(spark):
    df = spark.createDataFrame([("http://a/cart",)] * 3 + [("http://a/checkout",), ("http://a/bin",)], "url string")
    index = {r.name: r.token for r in url_rules.rule_index(df, url_rules.PATTERNS).collect()}
    assert index["cart"] == "checkout" and index["cgi_bin"] == "cgi" and set(index) == {r.name for r in url_rules.PATTERNS}


GAP = " \t\n\x0b\f\r"
PIECES = [" ", "\n", "\t", "a", "bb", "The cat", "sat on a mat.", "###", "a | b | c | d | e", "\x0b", "É漢", "!!", "<x>", "\x1c", " ", "log in", "1 2 3"]


def plain_counts(text):
    text = text or ""
    words = [w for w in re.split(f"[{GAP}]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(f"[^{GAP}]", x)]
    windows = {}
    for k in range(len(words) - 2):
        windows.setdefault(tuple(words[k:k + 3]), []).append(k)
    repeated = {p for ks in windows.values() if len(ks) > 1 for k in ks for p in (k, k + 1, k + 2)}
    kept = 0
    for x in dict.fromkeys(lines):
        marks, bars = len(re.findall(line_rules.MARKS, x)), len(re.findall(line_rules.SEPARATOR, x))
        bad = marks * 100 >= 10 * len(x) or (bars >= 3 and len(x) <= (bars + 1) * 25)
        bad = bad or (len(x) <= 200 and any(p in x.lower() for p in line_rules.PHRASES))
        kept += 0 if bad else len(re.sub(f"[{GAP}]", "", x))
    chars = sum(map(len, words))
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return (
        len(words), chars, len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed,
        not failed and 100 * kept >= 50 * chars,
    )


def judged(spark, texts):
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, n_words int")
    rows = sorted(line_rules.judge(df).collect(), key=lambda r: r.doc_id)
    return [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in rows]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=90).map("".join), min_size=20, max_size=40))
def test_lines(spark, texts):
    assert judged(spark, texts) == [plain_counts(t) for t in texts]


def test_line_edges(spark, small):
    clean = "The old house stood by the river and nobody had opened its doors since that long winter ended. "
    body = "\n".join(" ".join(f"w{k}{chr(97 + j)}" for j in range(14)) + "." for k in range(30))
    texts = [
        None, "", " \n ", "a", clean * 40, body, body + "\nlog in\nhome | news | shop | about | more", body.replace(" ", "### "),
        "x " * 30_000, "word" * 100_000, "a b c", "a b c a b c", "\n".join(["same line here"] * 40),
    ]
    got = judged(spark, texts)
    assert got == [plain_counts(t) for t in texts]
    assert got[5][6] and got[6][6] and not got[7][6] and not got[4][6]
    given_texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    assert judged(spark, given_texts) == [plain_counts(t) for t in given_texts]
    assert judged(spark, []) == []


@pytest.mark.parametrize("name", ["op4_url_verdicts", "op5_line_rules"])
def test_no_python_in_the_plan(spark, small, name):
    from leadloom.llm.queries import QUERIES

    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
