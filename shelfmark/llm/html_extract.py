"""Main-text extraction by wrapper induction.

Pages are parsed into trees.  Each host has a reference page (least hash of its
distinct pages); every other page of the host is aligned with it by simple tree
matching.  A reference node that holds the same text on most of the host's pages
is *template*; the other nodes are varying *slots*.  Pages whose slots are equal
count once.  Of the slots, those go whose element is no article by its tag or
role, or is a block of reader comments.  Words in a class or id are a hint only:
such a block goes unless it holds the article (``STRONG_SHARE``, ``WEAK_SHARE`` of
the text).  Where article elements hold most of what is left, they are the
content, constant headings included; else all that is left is.

Scale: alignment counts are summed per task and then per (host, node), so a hot
host is no hot task; references go to the tasks by broadcast while they are at
most ``MAX_BROADCAST`` characters in total, by an equi-join on the host beyond
that.  Pages are never grouped.

Defined results: null or empty html gives an empty text; a null URL, or one
without host, takes part without a reference.  Unclosed and stray tags are
tolerated.  A host with fewer than ``min_pages`` different pages has no template;
with few pages, at least three must agree.  Repeated rows give a row each.  The
alignment has one rule for pages of all sizes.
"""

from __future__ import annotations

import bisect
import html as html_lib
import math
import re
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import cut, table
from shelfmark.llm.url_filters import url_host

MAX_BROADCAST = 32_000_000
#: A reference node is template if its text is the same on this share of the
#: host's different pages, and on at least MIN_PAGES of them.
TEMPLATE_SHARE, MIN_PAGES = 0.6, 3
#: Blocks with a word of STRONG or WEAK go if they hold less than this share of the article's text.
STRONG_SHARE, WEAK_SHARE = 0.9, 0.5
#: Article elements are the content if they hold this share of the text that is left.
ARTICLE_SHARE = 0.5
#: Weights of pairs of forms that are kept for later rows; others are found again.
KEPT = 1_000_000

# Element names by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript template svg select object canvas annotation".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo mroot mrow ms msqrt msub msup mtext q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: A start tag of the first closes an open element of the second, up to one of the third.
IMPLIED = {
    "li": ("li", "ul ol menu"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "tr": ("tr td th", "table"),
    "td": ("td th", "tr table"),
    "th": ("td th", "tr table"),
    "tbody": ("thead tbody tfoot tr td th", "table"),
    "tfoot": ("thead tbody tfoot tr td th", "table"),
    "body": ("head", "html"),
}
NOT_ARTICLE = frozenset("nav aside footer form button dialog menu head audio video fieldset input datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
COMMENTS = frozenset("comment comments disqus reply replies respond".split())
STRONG = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored sponsors cookie cookies consent gdpr menu navbar nav navigation "
    "navigate breadcrumb breadcrumbs sidebar sharing social recommended recommendations popup modal overlay newsletter subscribe subscription signup login pagination pager "
    "toolbar masthead outbrain taboola".split()
)
WEAK = frozenset("notice notices alert aside rail discussion share related widget widgets copyright disclaimer skip tags hidden".split())
#: These words count outside of an article only.
OUTER_STRONG, OUTER_WEAK = frozenset("header footer".split()), frozenset("head foot top bottom".split())
#: A name with one of these says what a page has or lacks, not what the element is.
ABOUT = frozenset("no not has have with without is open closed enabled disabled supports layout".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_ATTR = re.compile(r"(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?(?=[\s/]|$)", re.I)
_PART = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


NEUTRAL, DROPPED, ARTICLE, STRONG_HINT, WEAK_HINT = range(5)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Page:
    """A parsed page: nodes as parallel lists, and its text in page order."""

    __slots__ = ("label", "parent", "children", "role", "inline", "stream", "_own")

    def __init__(self) -> None:
        self.label: list[str] = ["#page"]
        self.parent: list[int] = [-1]
        self.children: list[list[int]] = [[]]
        #: One of NEUTRAL, DROPPED, ARTICLE, STRONG_HINT and WEAK_HINT.
        self.role: list[int] = [0]
        self.stream: list[tuple[int, str]] = []
        self._own: list[int] | None = None

    def own(self) -> list[int]:
        """A checksum of each node's own text, white space collapsed; 0 for no text."""
        if self._own is None:
            texts: list[list[str]] = [[] for _ in self.label]
            for node, text in self.stream:
                if text:
                    texts[node] += text.split()
            self._own = [zlib.crc32(" ".join(t).encode("utf-8", "replace")) | 1 << 32 if t else 0 for t in texts]
        return self._own


def _hint(tag: str, names: str, in_article: bool) -> int:
    """What the names in a class or id say; an article is judged by whole names only."""
    found = NEUTRAL
    for name in names.split():
        parts = {name.lower()} if tag == "article" else set(_PART.findall(_CAMEL.sub(" ", name).lower()))
        if parts & ABOUT:
            continue
        if parts & COMMENTS:
            return DROPPED
        if parts & STRONG or not in_article and parts & OUTER_STRONG:
            found = STRONG_HINT
        elif parts & WEAK or not in_article and parts & OUTER_WEAK:
            found = found or WEAK_HINT
    return found


def _role(tag: str, attrs: str, in_article: bool) -> tuple[int, str]:
    """The part of an element, and its label: the tag with those of its classes that hold no number."""
    role, hint, shown = NEUTRAL, NEUTRAL, ""
    frame = tag in ("html", "body", "main")
    if tag in NOT_ARTICLE or tag == "header" and not in_article:
        role = DROPPED
    elif tag in ("article", "main"):
        role = ARTICLE
    for m in _ATTR.finditer(attrs) if attrs else ():
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name in ("class", "id"):
            if not frame:
                now = _hint(tag, value, in_article)
                hint = min(hint, now) if hint and now else hint or now
            if name == "class":
                shown = " ".join(x for x in value.split() if not re.search(r"\d", x))
        elif frame:
            continue
        elif name == "role" and value.lower() in ("main", "article"):
            role = role or ARTICLE
        elif name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
            role = DROPPED
    return role if role == DROPPED else hint or role, f"{tag}.{shown}" if shown else tag


def parse(source: str) -> Page:
    page = Page()
    label, parent, children, role, stream = page.label, page.parent, page.children, page.role, page.stream
    open_tags, open_ids = ["#page"], [0]
    #: Depths of the open elements of each tag, from the outside in.
    places: dict[str, list[int]] = {}
    unclosed: set[str] = set()
    articles = 0
    at = 0
    search, last_end = _TOKEN.search, source.rfind(">")

    def innermost(tags: Iterable[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def text(raw: str) -> None:
        stream.append((open_ids[-1], html_lib.unescape(raw) if "&" in raw else raw))

    def close(depth: int) -> None:
        nonlocal articles
        while len(open_ids) > depth:
            articles -= role[open_ids.pop()] == ARTICLE
            gone = open_tags.pop()
            places[gone].pop()
            if gone not in INLINE:
                stream.append((open_ids[-1], ""))

    # Beyond the last end of a tag there is none, and nothing to look for but comments.
    while m := search(source, at) if at <= last_end else _COMMENT.search(source, at):
        if m.start() > at:
            text(source[at : m.start()])
        at = m.end()
        slash, tag, attrs = (None, None, None) if m.re is _COMMENT else (m[1], m[2], m[3]) if m[2] is not None else (m[4], m[5], m[6])
        if tag is None:
            continue
        tag = tag.lower()
        if slash:
            if places.get(tag):
                close(places[tag][-1])
            elif tag in ("p", "br"):
                stream.append((open_ids[-1], ""))
            continue
        if tag in RAW:
            if not attrs.endswith("/"):
                end = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(source, at)
                if not end:
                    unclosed.add(tag)
                at = end.end() if end else len(source) if tag in ("script", "style", "textarea", "title") else at
            continue
        if tag in CLOSES_P and places.get("p"):
            last = places["p"][-1]
            if innermost(("button", "table", "td", "th")) < last:
                close(last)
        if tag in IMPLIED:
            ends, stops = (x.split() for x in IMPLIED[tag])
            stop = innermost(stops)
            inside = [d[bisect.bisect_right(d, stop)] for d in (places.get(t) for t in ends) if d and d[-1] > stop]
            if inside:
                close(min(inside))
        elif tag == "article" and places.get("nav"):
            close(places["nav"][0])  # a menu that was never closed
        if tag in ("html", "body") and places.get(tag):
            continue
        if tag not in INLINE:
            stream.append((open_ids[-1], ""))
        if tag in VOID:
            continue
        kind, shown = _role(tag, attrs, articles > 0)
        node = len(label)
        label.append(shown)
        parent.append(open_ids[-1])
        children.append([])
        children[open_ids[-1]].append(node)
        role.append(kind)
        if attrs.endswith("/") and tag in ("path", "use"):
            continue
        places.setdefault(tag, []).append(len(open_tags))
        open_tags.append(tag)
        open_ids.append(node)
        articles += kind == ARTICLE
    if at < len(source):
        rest = source[at:]
        text(rest[: rest.index("<")] if re.match(r"[^<]*<[a-zA-Z/!]", rest) else rest)
    return page


def _forms(*pages: Page) -> tuple[list[list[int]], list[str], list[tuple[int, ...]], list[int]]:
    """Nodes of one form (label, and forms of the children in order) share a number: the nodes' forms by page, then label, children and size of each form."""
    known: dict[tuple, int] = {}
    label: list[str] = []
    kids: list[tuple[int, ...]] = []
    size: list[int] = []
    forms = []
    for page in pages:
        form = [0] * len(page.label)
        # Parents come before their children.
        for i in range(len(form) - 1, -1, -1):
            key = page.label[i], tuple([form[c] for c in page.children[i]])
            at = known.get(key)
            if at is None:
                at = known[key] = len(label)
                label.append(key[0])
                kids.append(key[1])
                size.append(1 + sum([size[c] for c in key[1]]))
            form[i] = at
        forms.append(form)
    return forms, label, kids, size


class _Rows:
    """Two rows of forms, and the weights of their pairs: how many nodes a largest match of the two forms has, 0 for other labels."""

    def __init__(self, p: Sequence[int], q: Sequence[int], label: list[str], base: int = 0) -> None:
        us, vs = {u: r for r, u in enumerate(dict.fromkeys(p))}, {v: c for c, v in enumerate(dict.fromkeys(q))}
        self.base, self.weight = base, np.zeros((len(us), len(vs)), np.int32)
        self.p, self.q = [us[u] for u in p], np.array([vs[v] for v in q], np.int64)
        by: dict[str, list[tuple[int, int]]] = {}
        for v, c in vs.items():
            by.setdefault(label[v], []).append((c, v))
        self.todo = ((r, c, u, v) for u, r in us.items() for c, v in by.get(label[u], ()))
        self.at = (0, 0, 0, 0)

    def below(self, best: np.ndarray, r: int) -> np.ndarray:
        """Row r + 1 of the table of best sums, from row r."""
        out = np.zeros_like(best)
        np.maximum(best[1:], best[:-1] + self.weight[self.p[r]][self.q], out=out[1:])
        return np.maximum.accumulate(out, out=out)

    def most(self) -> int:
        best = np.zeros(len(self.q) + 1, np.int32)
        for r in range(len(self.p)):
            best = self.below(best, r)
        return self.base + int(best[-1])

    def pairs(self) -> list[tuple[int, int]]:
        """Places of a largest match.  One row of the table in every sqrt(rows) is held; those between are made again when the way back comes to them."""
        m, n = len(self.p), len(self.q)
        step = math.isqrt(m)
        held = [np.zeros(n + 1, np.int32)]
        best = held[0]
        for r in range(m):
            best = self.below(best, r)
            if (r + 1) % step == 0:
                held.append(best)
        out, r, c, first, rows = [], m, n, m, []
        while r and c:
            if r <= first:
                first = (r - 1) // step * step
                rows = [held[first // step]]
                for k in range(first, r):
                    rows.append(self.below(rows[-1], k))
            here, above = rows[r - first], rows[r - first - 1]
            if here[c] == above[c]:
                r -= 1
            elif here[c] == here[c - 1]:
                c -= 1
            else:
                r, c = r - 1, c - 1
                out.append((r, c))
        return out


def _same_start(p: Sequence[int], q: Sequence[int]) -> int:
    return next((k for k, (u, v) in enumerate(zip(p, q, strict=False)) if u != v), min(len(p), len(q)))


def align(a: Page, b: Page) -> list[tuple[int, int]]:
    """Simple tree matching: the pairs of nodes of a largest order-keeping match from the roots down.

    Only nodes of equal labels match.  Pages of every size are matched by this one rule.  Work goes by forms,
    of which pages have few: a form matches itself whole, equal beginnings of rows match each other, and the
    quadratic step is left to what differs.
    """
    (fa, fb), label, kids, size = _forms(a, b)
    known: dict[tuple[int, int], int] = {}

    def weighed(rows: _Rows) -> _Rows:
        """Fill in the weights, without recursion (trees may be deep)."""
        open_rows = [rows]
        while True:
            now = open_rows[-1]
            for r, c, u, v in now.todo:
                if u == v:
                    now.weight[r, c] = size[u]
                elif not kids[u] or not kids[v]:
                    now.weight[r, c] = 1
                elif (u, v) in known:
                    now.weight[r, c] = known[u, v]
                else:
                    # What the rows begin and end with alike is in a largest match.
                    p, q = kids[u], kids[v]
                    k = _same_start(p, q)
                    e = _same_start(p[k:][::-1], q[k:][::-1])
                    base = 1 + sum([size[x] for x in p[:k]]) + sum([size[x] for x in p[len(p) - e :]])
                    if k + e == min(len(p), len(q)):
                        now.weight[r, c] = base
                        continue
                    now.at = r, c, u, v
                    open_rows.append(_Rows(p[k : len(p) - e], q[k : len(q) - e], label, base))
                    break
            else:
                if len(open_rows) == 1:
                    return rows
                open_rows.pop()
                up = open_rows[-1]
                r, c, u, v = up.at
                if len(known) >= KEPT:
                    known.clear()
                up.weight[r, c] = known[u, v] = now.most()

    out, todo = [], [(0, 0)]
    while todo:
        i, j = todo.pop()
        out.append((i, j))
        p, q = a.children[i], b.children[j]
        forms = [fa[u] for u in p], [fb[v] for v in q]
        k = _same_start(*forms)
        todo += zip(p[:k], q[:k], strict=False)
        if k < min(len(p), len(q)):
            todo += [(p[k + r], q[k + c]) for r, c in weighed(_Rows(forms[0][k:], forms[1][k:], label)).pairs()]
    return out


def content(page: Page, template: set[int]) -> str:
    """The article's text; ``template`` holds the page's nodes that the wrapper knows as constant."""
    n, role, parent = len(page.label), page.role, page.parent
    # Parents come before their children, so one walk down and one up are enough.
    dropped, inside, mass = [False] * n, [False] * n, [0] * n
    holds = [False] * n  # holds an article element
    for i in range(n - 1, 0, -1):
        holds[i] |= role[i] == ARTICLE
        holds[parent[i]] |= holds[i]
    for i in range(n):
        up = parent[i]
        form = page.label[i].partition(".")[0] == "form"
        dropped[i] = role[i] == DROPPED and not (form and holds[i]) or up >= 0 and dropped[up]
        inside[i] = role[i] == ARTICLE or up >= 0 and inside[up]
    for i, text in page.stream:
        if not dropped[i] and (inside[i] or i not in template):
            mass[i] += len(text.strip())
    found = [mass[i] if inside[i] else 0 for i in range(n)]
    for i in range(n - 1, 0, -1):
        mass[parent[i]] += mass[i]
        found[parent[i]] += found[i]
    # A block that is hinted to be no article goes, unless it holds the article.
    of, total = (found, found[0]) if found[0] else (mass, mass[0])
    left, left_found = mass[0], found[0]
    for i in range(1, n):
        if dropped[parent[i]]:
            dropped[i] = True
        elif role[i] >= STRONG_HINT and of[i] < (STRONG_SHARE if role[i] == STRONG_HINT else WEAK_SHARE) * total:
            dropped[i] = True
            left -= mass[i]
            left_found -= found[i]
    held = left_found and left_found >= ARTICLE_SHARE * left
    keep = [not dropped[i] and (inside[i] or not held and i not in template) for i in range(n)]
    return " ".join("".join(" " if not t else t if keep[i] else "" for i, t in page.stream).split())


def induce(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, html) -> one row per host with ``min_pages`` distinct pages: host, ref (html), nodes (template nodes of ref)."""
    keyed = pages.where("host != '' and html is not null and html != ''").select("host", F.xxhash64("html").alias("h"))
    hosts = keyed.distinct().groupBy("host").agg(F.min("h").alias("h"), F.count("*").alias("n")).where(F.col("n") >= min_pages)
    hosts = cut(hosts)
    hint = F.broadcast(hosts) if hosts.count() <= 100_000 else hosts
    refs = cut(pages.withColumn("h", F.xxhash64("html")).join(hint, ["host", "h"]).groupBy("host").agg(F.min("html").alias("ref")))
    once = pages.select("host", "html")

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        same: dict[tuple[str, int, int], int] = {}
        known: dict[str, Page] = {}
        for part in parts:
            for host, ref, source in zip(part["host"], part["ref"], part["html"], strict=True):
                if host not in known:
                    if len(known) > 500:
                        known.clear()
                    known[host] = parse(ref)
                a, b = known[host], parse(source or "")
                x, y = a.own(), b.own()
                equal = {j: i for i, j in align(a, b) if x[i] and x[i] == y[j]}
                # Pages with equal slots are one; node -1 counts them.
                slots = hash(tuple(t for j, t in enumerate(y) if t and j not in equal))
                same.update(((host, i, slots), 1) for i in (-1, *equal.values()))
                if len(same) > 200_000:
                    yield _rows(same)
                    same.clear()
        yield _rows(same)

    def _rows(same: dict) -> pd.DataFrame:
        return pd.DataFrame(list(same), columns=["host", "node", "h"])

    with_ref = _with_refs(once, refs, refs, "inner")
    seen = with_ref.mapInPandas(count, "host string, node int, h long")
    per = seen.distinct().groupBy("host", "node").agg(F.count("*").alias("c"))
    n = per.where("node = -1").select("host", F.col("c").alias("n"))
    agree = F.greatest(F.col("n") * TEMPLATE_SHARE, F.lit(float(min_pages)))
    nodes = per.where("node >= 0").join(n, "host").where(F.col("c") >= agree)
    nodes = nodes.groupBy("host").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    return cut(refs.join(nodes, "host", "left").select("host", "ref", F.coalesce("nodes", F.array().cast("array<int>")).alias("nodes")))


def _with_refs(pages: DataFrame, refs: DataFrame, sized: DataFrame, how: str) -> DataFrame:
    total = sized.agg(F.sum(F.length("ref"))).first()[0] or 0
    return pages.join(F.broadcast(refs) if total <= MAX_BROADCAST else refs, "host", how)


def extract(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """``pages`` (page_id, url, html) -> page_id, url, text, n_chars, n_template (nodes that the wrapper knows as constant)."""
    rows = pages.select("page_id", "url", "html").withColumn("host", url_host(F.col("url")))
    wrapper = induce(rows, min_pages)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[Page, set[int]]] = {}
        for part in parts:
            texts, removed = [], []
            for host, source, ref, nodes in zip(part["host"], part["html"], part["ref"], part["nodes"], strict=True):
                page = parse(source or "")
                template: set[int] = set()
                if ref is not None and nodes is not None and len(nodes):
                    if host not in known:
                        if len(known) > 500:
                            known.clear()
                        known[host] = parse(ref), {int(x) for x in nodes}
                    a, constant = known[host]
                    x, y = a.own(), page.own()
                    template = {j for i, j in align(a, page) if i in constant and x[i] == y[j]}
                texts.append(content(page, template))
                removed.append(len(template))
            yield pd.DataFrame({"page_id": part["page_id"].array, "url": part["url"].array, "text": texts, "n_template": removed})

    out = _with_refs(rows, wrapper, wrapper, "left").mapInPandas(run, "page_id long, url string, text string, n_template long")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_template")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
