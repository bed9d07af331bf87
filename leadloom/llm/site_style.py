"""Main text of web pages by site style trees.

The pages of a host are merged into one style tree whose nodes are element paths (tag and classes from the root
on). For each path the tree knows

- presentation: in which styles (sequences of child labels) the element occurs, and how evenly;
- content: which block texts stand there, and on how many of the host's different pages each one recurs.

A node's presentation importance is the entropy of its styles to the base of the number of pages; a text that
recurs on k of m pages has entropy log k / log m, and the content importance of a branch is the mean of one minus
that over its different texts. Both combine as (1 - G**l) * presentation + G**l * content with l styles. A branch
is removed from every page of the host if it, all branches below it and the texts that stand directly in any of them
are below ``LEAST_IMPORTANCE``: a container of many styles stays where a part of it is important. The tree is built by grouped aggregation, so
that a host with a third of all pages is spread over all tasks.

Elements whose tag, role or class says what they are (menus, headers, footers, sidebars, notices, adverts, forms,
comments, scripts) are removed from the page itself, which also serves hosts with too few pages for a tree. A class or id
is only a hint: a block element stays in spite of it if it holds the page's heading and most of its text, or all of the
text, as a wrapper does whose class tells what stands beside it (``no-sidebar``, ``has-comments``). What
stays is cut to ``main`` or ``article`` where a page marks one. Inside such a marked part a branch is removed for
low importance only if it is a container of its own and holds less than half of the text, so that pages that
share their whole article keep it.

Null and empty html give an empty text. A null url has the host ''. Very long pages are read whole. Rows that repeat, or tie
in url or html, give rows of their own. An empty table gives an empty result. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import checkpointed, map_batches
from leadloom.sizing import bounded_broadcast

#: G: weight of content against presentation.
CONTENT_WEIGHT = 0.9
LEAST_IMPORTANCE = 0.3
#: Different pages of a host from which its tree is used.
LEAST_PAGES = 8
#: Path labels kept from the root on; deeper elements share the path of their ancestor there.
DEEPEST = 24

BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Content of these is not markup.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
NOISE_TAGS = frozenset(
    "nav footer aside form dialog menu select button label datalist fieldset noscript template svg math canvas "
    "object applet audio video map search head".split()
)
NOISE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar "
    "tablist doc-footnote status".split()
)
#: Words of classes and ids.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adsbygoogle sponsor sponsored sponsors "
    "promo promos promotion promoted banner banners sidebar sidebars sidenav menu menus nav navbar navigation "
    "navi topbar breadcrumb breadcrumbs cookie cookies consent gdpr notice notices notification popup modal overlay "
    "newsletter subscribe subscription signup login comment comments commentlist disqus respond replies reply "
    "social share sharing sharebar related recommended recommendations teaser teasers widget widgets toolbar "
    "search searchbox pagination pager paging skip footer copyright masthead byline hidden tags tagcloud rating".split()
)
#: Words that count only outside of a marked main part.
OUTER_WORDS = frozenset(("header",))
NEVER_NOISE = frozenset(("html", "body"))
#: Elements whose class is no reason to take them for a container of their own.
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table tbody thead tfoot tr td th figure figcaption hgroup".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORD = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z0-9]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Block(NamedTuple):
    path: str
    text: str
    main: bool
    article: bool
    hinted: tuple[int, ...] = ()  # numbers of the elements around it whose class says noise


class _Element:
    __slots__ = ("article", "children", "hinted", "label", "main", "name", "noise", "path")

    def __init__(
        self, name: str, label: str, path: str, noise: bool, main: bool, article: bool, hinted: tuple[int, ...] = ()
    ) -> None:
        self.name, self.label, self.path, self.noise = name, label, path, noise
        self.main, self.article, self.children, self.hinted = main, article, [], hinted


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), a or b or c)
    return out


def _is_noise(name: str, attributes: dict[str, str], inside: bool) -> bool:
    """Whether tag, role or attributes say so."""
    if name in NOISE_TAGS or (name == "header" and not inside):
        return True
    if name in NEVER_NOISE or not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    return attributes.get("role", "").strip().lower() in NOISE_ROLES or bool(HIDDEN.search(attributes.get("style", "")))


def _is_hinted(name: str, words: set[str], inside: bool) -> bool:
    """Whether a word of class or id says so."""
    if name in NEVER_NOISE or name == "main":
        return False
    return bool(words & NOISE_WORDS) or (not inside and bool(words & OUTER_WORDS))


class _Page:
    """One pass over the tokens of a page, with the stack of open elements."""

    def __init__(self) -> None:
        self.root = _Element("", "", "", False, False, False)
        self.stack = [self.root]
        self.open: Counter[str] = Counter()
        self.blocks: list[Block] = []
        self.styles: list[tuple[str, str, tuple[int, ...]]] = []
        self.pieces: list[str] = []
        self.hints = 0
        self.headed: set[int] = set()  # hinted elements that hold a heading of the page

    def text(self, source: str) -> None:
        if not self.stack[-1].noise:
            self.pieces.append(entities.unescape(source) if "&" in source else source)

    def flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            self.pieces = []
            if text:
                top = self.stack[-1]
                self.blocks.append(Block(top.path, text, top.main, top.article, top.hinted))

    def start(self, name: str, source: str) -> None:
        if name == "br":
            self.text(" ")
            return
        if name in VOID:
            if name == "hr":
                self.flush()
            return
        attributes = _attributes(source) if source.strip(" /\n\t\r") else {}
        block = name in BLOCKS
        if not block and not attributes and name not in NOISE_TAGS:
            return  # plain inline markup
        top = self.stack[-1]
        named = f"{attributes.get('class', '')} {attributes.get('id', '')}"
        words = {w.lower() for w in WORD.findall(named)}
        inside = top.main or top.article
        hinted = _is_hinted(name, words, inside)
        own_noise = _is_noise(name, attributes, inside) or (hinted and not block)
        if not block and not (top.noise or own_noise):
            return
        if block:
            self.flush()
            self._imply_ends(name)
            top = self.stack[-1]
        noise = top.noise or own_noise
        label = name + "".join(f".{w}" for w in attributes.get("class", "").lower().split()[:3])
        top.children.append(label)
        path = top.path if len(self.stack) > DEEPEST else f"{top.path}/{label}"
        role = attributes.get("role", "").lower()
        main = top.main or (not noise and (name == "main" or role == "main" or attributes.get("itemprop") == "articleBody"))
        article = top.article or (not noise and (name == "article" or role == "article"))
        around = top.hinted
        if hinted and block:
            self.hints += 1
            around = (*around, self.hints)
        if name == "h1" and not noise:
            self.headed.update(around)
        self.stack.append(_Element(name, label, path, noise, main, article, around))
        self.open[name] += 1

    def end(self, name: str) -> None:
        if name in BLOCKS:
            self.flush()
        if self.open[name]:
            while self._close().name != name:
                pass

    def _close(self) -> _Element:
        if self.stack[-1].name in BLOCKS:
            self.flush()
        done = self.stack.pop()
        self.open[done.name] -= 1
        if not done.noise and done.children:
            kept = [c for k, c in enumerate(done.children) if not k or c != done.children[k - 1]]
            self.styles.append((done.path, " ".join(kept), done.hinted))
        return done

    def _imply_ends(self, name: str) -> None:
        """Close what an opening block element ends without an end tag."""
        ends, stops = IMPLIED.get(name, PARAGRAPH)
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].name in ends:
                while len(self.stack) > k:
                    self._close()
                return
            if self.stack[k].name in stops:
                return

    def finish(self) -> None:
        self.flush()
        while len(self.stack) > 1:
            self._close()

    def wrappers(self) -> set[int]:
        """The hinted elements that hold a heading and more than half of the text, or else all of it."""
        held: Counter[int] = Counter()
        for b in self.blocks:
            for k in b.hinted:
                held[k] += len(b.text)
        total = sum(len(b.text) for b in self.blocks)
        found = {k for k in self.headed if 2 * held[k] > total}
        if any(found.issuperset(b.hinted) for b in self.blocks):
            return found
        return found | {k for k, n in held.items() if n == total}


LISTS, TABLES = frozenset("ul ol menu dir".split()), frozenset(("table",))
CONTAINERS = BLOCKS - {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
PARAGRAPH = (frozenset(("p",)), CONTAINERS)
IMPLIED = {
    "li": (frozenset(("li",)), LISTS), "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))), "tr": (frozenset(("tr",)), TABLES),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))), "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
}


def parse(source: str) -> tuple[list[Block], list[tuple[str, str]]]:
    """The text blocks of a page outside of plain noise, and (path, style) of its elements."""
    page, at, raw_end = _Page(), 0, {}
    while token := TOKEN.search(source, at):
        if token.start() > at:
            page.text(source[at:token.start()])
        at = token.end()
        if name := token["end"]:
            page.end(name.lower())
        elif name := token["start"]:
            name = name.lower()
            if name in RAW:
                if name not in raw_end:
                    raw_end[name] = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I)
                found = raw_end[name].search(source, at)
                at = found.end() if found else len(source)
            else:
                page.start(name, token["attributes"])
    page.text(source[at:])
    page.finish()
    kept = page.wrappers()
    blocks = [b for b in page.blocks if kept.issuperset(b.hinted)]
    chosen = [b for b in blocks if b.main] or [b for b in blocks if b.article] or blocks
    return chosen, [(path, style) for path, style, hinted in page.styles if kept.issuperset(hinted)]


def _prefixes(path: str) -> list[str]:
    parts = path.split("/")
    return ["/".join(parts[:k]) for k in range(2, len(parts) + 1)]


def _container(path: str) -> bool:
    """Whether the last element is more than plain text markup."""
    last = path.rpartition("/")[2]
    return last.partition(".")[0] not in TEXT_TAGS


def extract(source: str | None, low: list[str] | None = None) -> str:
    """The main text of a page, without the branches whose paths are ``low`` on its host."""
    if not source:
        return ""
    blocks, _ = parse(source)
    if low and blocks:
        paths = set(low)
        marked = blocks[0].main or blocks[0].article
        gone = []
        for b in blocks:
            hit = [p for p in _prefixes(b.path) if p in paths]
            if marked:  # below the marked element only, and only containers
                hit = [p for p in hit if _container(p) and not re.search(r"/(main|article)[^/]*$", p) and re.search(r"/(main|article)\b", p)]
            gone.append(bool(hit))
        lost = sum(len(b.text) for b, g in zip(blocks, gone) if g)
        if not marked or 2 * lost < sum(len(b.text) for b in blocks):
            blocks = [b for b, g in zip(blocks, gone) if not g]
    return "\n".join(b.text for b in blocks)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def features(pages: DataFrame) -> DataFrame:
    """Per page of (host, html): (host, path, kind, feature, page): its block texts (kind c), the styles of its
    elements (kind s) and one row for the page itself (kind p), each once; page is a hash of its html."""
    import xxhash

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for host, source in zip(*(c.to_pylist() for c in batch.columns)):
            if not source:
                continue
            page = xxhash.xxh64_intdigest(source.encode()) - 2**63
            blocks, styles = parse(source)
            own = {(b.path, "c", xxhash.xxh64_intdigest(b.text.encode()) - 2**63) for b in blocks}
            own |= {(path, "s", xxhash.xxh64_intdigest(style.encode()) - 2**63) for path, style in styles}
            own.add(("", "p", 0))
            rows += [(host, *row, page) for row in own]
        columns = list(zip(*rows)) or [[]] * 5
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, kinds)], names=["host", "path", "kind", "feature", "page"]
        )

    return map_batches(pages.select("host", "html"), run, "host string, path string, kind string, feature long, page long")


def style_tree(pages: DataFrame, content_weight: float = CONTENT_WEIGHT, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, path, pages, presentation, content, own, importance) of every branch; pages is of the whole host, own is the
    content importance of the texts directly in the element."""
    seen = features(pages).distinct().groupBy("host", "path", "kind", "feature").agg(F.count("*").alias("k"))
    seen = checkpointed(seen.groupBy("host", "path", "kind").agg(
        F.count("*").alias("n"), F.sum("k").alias("k"), F.sum(F.log("k")).alias("logs"),
        F.sum(F.col("k") * F.log("k")).alias("k_logs"),
    ))
    sizes = seen.filter("kind = 'p'").select("host", F.col("k").alias("pages")).filter(F.col("pages") >= least_pages)
    known = seen.join(checkpointed(sizes), "host")
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    base = F.log("pages")
    content = (
        known.filter("kind = 'c'").select("host", "pages", F.explode(prefixes).alias("path"), F.col("path").alias("at"), "n", "logs")
        .groupBy("host", "path", "pages")
        .agg(
            (1 - F.sum("logs") / F.sum("n") / F.first(base)).alias("content"),
            F.max(F.when(F.col("path") == F.col("at"), 1 - F.col("logs") / F.col("n") / base)).alias("own"),
        )
    )
    styles = known.filter("kind = 's'").select(
        "host", "path", F.col("n").alias("styles"), ((F.log("k") - F.col("k_logs") / F.col("k")) / base).alias("presentation")
    )
    weight = F.pow(F.lit(content_weight), F.coalesce("styles", F.lit(0)))
    return content.join(styles, ["host", "path"], "left").select(
        "host", "path", "pages", F.coalesce("presentation", F.lit(0.0)).alias("presentation"), "content", "own",
        ((1 - weight) * F.coalesce("presentation", F.lit(0.0)) + weight * F.col("content")).alias("importance"),
    )


def low_branches(tree: DataFrame, least: float = LEAST_IMPORTANCE) -> DataFrame:
    """(host, low): the paths of a host's branches without any important part."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    best = F.greatest("importance", "own")  # of those that are not null
    whole = tree.select("host", F.explode(above).alias("path"), best.alias("best")).groupBy("host", "path").agg(F.max("best").alias("best"))
    return whole.filter(F.col("best") < least).groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("low"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) of every page."""
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host")
    )
    low = bounded_broadcast(checkpointed(low_branches(style_tree(rows))))
    joined = rows.join(low, "host", "left").select("id", "url", "html", "low")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract(h.as_py(), p.as_py()) for h, p in zip(batch.column(2), batch.column(3))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=[id_col, url_col, "text"])

    return map_batches(joined, run, f"`{id_col}` {dict(rows.dtypes)['id']}, `{url_col}` string, text string")
