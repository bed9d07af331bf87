"""Parsing, noise removal and site style trees on planted pages."""

import random
import re
from html import escape, unescape

import pytest

from leadloom.llm import site_style

FURNITURE = {
    "nav": "<nav><a href=/>Home</a></nav>", "header": "<header><h1>Site</h1></header>", "footer": "<footer>&copy; x</footer>",
    "aside": "<aside>more</aside>", "menu class": "<div class='main-menu'>One Two</div>", "ad id": "<div id=adBox>Buy</div>",
    "notice": "<div class='cookie-notice'><p>We use cookies</div>", "form": "<form><p>Name<input></form>",
    "script": "<script>if (a < b && '</p>') x()</script>", "style": "<STYLE>p > a {}</STYLE>", "comment": "<!-- <p>no -->",
    "comments": "<section id='comments'><p>First!</section>", "role": "<div role=navigation>go</div>",
    "hidden": "<div hidden>x</div><div style='display: none'>y</div>", "noscript": "<noscript><p>Enable</noscript>",
    "unclosed comment": "", "cdata": "<![CDATA[ <p>x ]]>", "title": "<title>T <p></title>",
}


@pytest.mark.parametrize("name", sorted(FURNITURE))
@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<div>{}</div>"])
def test_furniture_goes(name, wrap):
    article = wrap.format("<h1>Head</h1><p>One  <b>two</b>\n&amp;&nbsp;three<p>four<br>five")
    page = f"<!DOCTYPE html><html><head><meta charset=utf-8></head><body class='has-sidebar ad'>{FURNITURE[name]}{article}{FURNITURE[name]}"
    assert site_style.extract(page) == "Head\nOne two & three\nfour five"


@pytest.mark.parametrize(("source", "text"), [
    (None, ""), ("", ""), ("plain", "plain"), ("<p>", ""), ("a<b>c", "ac"), ("a < b", "a < b"), ("<p>x</div></p>y", "x\ny"),
    ("<ul><li>a<li>b</ul>c", "a\nb\nc"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("&lt;p&gt; &#233;&eacute;", "<p> éé"),
    ("<p title='a > b'>x", "x"), ("R&<b>reg;</b> &copy2", "R&reg; ©2"), ("<p>x<!-- never closed", "x"), ("<div>a<span class=ad>buy</span> b</div>", "a b"),
    ("<main><div class=share>f</div><p>x</main><p>y", "x"), ("<article class='comment'>c</article><p>x", "x"),
    ("<p>" + "word " * 60_000, " ".join(["word"] * 60_000)), ("<article><header><h1>T</h1></header><p>x</article>", "T\nx"),
])
def test_small_pages(source, text):
    assert site_style.extract(source) == text


@pytest.mark.parametrize("names", [
    "no-sidebar", "content with-sidebar", "post has-comments", "layout sidebar-right", "blog-post single widget-area", "entry hentry tag-news tags",
    "page-search", "article rating", "post share-buttons-on",
])
@pytest.mark.parametrize("page", ["<div class='{}'>{}</div>", "<article class='{}'>{}</article>", "<main><div class='{}'>{}</div></main>", "<section id='{}'><div>{}</div></section>"])
def test_wrappers_keep_their_article(names, page):
    body = "<h1>Head</h1><p>One two three four five</p><div class='sidebar'>Others</div><div class='comments'><p>First!</p></div><p>six</p>"
    around = "<div class='main-menu'>Home</div>" + page.format(names, body) + "<div class='related'>More</div>"
    assert site_style.extract(f"<body>{around}</body>") == "Head\nOne two three four five\nsix"
    assert site_style.extract(page.format(names, "<p>Only</p><p>text</p>")) == "Only\ntext"


def test_long_comments_still_go():
    page = "<div class=post><h1>Head</h1><p>Short</p></div><div class=comments>" + "<p>a long remark</p>" * 50 + "</div>"
    assert site_style.extract(page) == "Head\nShort"


def test_broken_markup_takes_linear_time():
    for source in ("<div>" * 50_000 + "x", '<a href="' * 20_000, "<p " * 50_000, "<" * 100_000, "<!--" * 50_000, "<b><p>" * 20_000):
        site_style.extract(source)


def site(rnd, host, pages, first_id):
    """Pages of one host whose repeated parts bear no telling name."""
    rows, want = [], {}
    for k in range(pages):
        body = [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 9) for _ in range(12)) + str(rnd.random()) for _ in range(3)]
        box = rnd.choice(["See our other shops", "Shops near you"])
        rows.append((first_id + k, f"http://{host}/{k}", f"<body><div class=x1>{box}</div><div class=x2><p>{'<p>'.join(map(escape, body))}</div></body>"))
        want[first_id + k] = "\n".join(body)
    return rows, want


def test_repeated_branches_of_a_host_go(spark):
    rnd = random.Random(2)
    rows, want = site(rnd, "big.example", 60, 0)
    few, _ = site(rnd, "few.example", 3, 1000)
    copies = [(2000 + k, f"http://same.example/{k}", "<div class=y><p>only text</p></div>") for k in range(30)]
    shared = [(3000 + k, f"http://near.example/{k}", f"<article><div class=body><p>shared</p></div><h2>{k}</h2></article>") for k in range(30)]
    odd = [(4000, None, "<p>no url"), (4001, "no scheme", "<p>x"), (4002, "http://big.example/", None), (4002, "http://big.example/", None)]
    df = spark.createDataFrame([(*r, "z") for r in rows + few + copies + shared + odd], "page_id long, url string, html string, text string")
    got = {}
    for r in site_style.main_text(df).collect():
        got.setdefault(r.page_id, r.text)
    assert {k: got[k] for k in want} == want
    assert all("hop" in got[1000 + k] for k in range(3))  # too few pages for a tree
    assert all(got[2000 + k] == "only text" for k in range(30))  # one page, however often it is copied
    assert all(got[3000 + k] == f"shared\n{k}" for k in range(30))  # most of a marked article stays
    assert (got[4000], got[4001], got[4002]) == ("no url", "x", "")
    assert site_style.main_text(df).count() == df.count()
    tree = {(r.host, r.path): r for r in site_style.style_tree(df.withColumn("host", site_style.host_of(df.url))).collect()}
    assert tree["big.example", "/body/div.x1"].importance < 0.3 < 0.85 < tree["big.example", "/body/div.x2"].importance
    assert not any(host in ("few.example", "same.example") for host, _ in tree)


def test_no_pages(spark):
    assert site_style.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_given_pages(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in site_style.main_text(pages).collect():
        article = re.search(r"<article>(.*?)</article>", html[r.page_id], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b)


def test_containers_of_many_styles_keep_unique_texts(spark):
    """1200 unmarked pages: one usual and 30 rare styles of the body and a container, all texts but the last unique."""
    rows = []
    for k in range(1200):
        rare = f"<h{k % 5 + 2}>Title {k}</h{k % 5 + 2}>" + "<p>x{0} y</p><ul><li>z{0}</li></ul>".format(k) * (k // 10 % 6 + 1) if k % 10 == 0 else ""
        inner = f"<div class='s{k // 10 % 30}'>{rare}</div>" if rare else ""
        rows.append((k, "http://h.example/a", f"<html><body><div class='c'>{inner}<p>text {k} of its own</p></div>{inner}<div class='z'>Same everywhere</div></body></html>"))
    out = site_style.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == 1200
    assert all(f"text {r.page_id} of its own" in r.text for r in out)
    assert not any("Same everywhere" in r.text for r in out)
