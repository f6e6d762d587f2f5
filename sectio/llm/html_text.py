"""Main text of web pages by tag-path ratios.

A tolerant parse gives the text nodes of a page with their root-to-leaf tag
paths (tags with class or id); a path is a number, made from its parent's and the
last label. What can't be article text (scripts, navigation, hidden elements and
the like) is left out first. Then, per path, the text length per node and the
punctuation per node are aggregated; both series are smoothed over the nodes in
page order, fused (geometric mean, less by the share of link text), and paths
whose mean fused value reaches the threshold are content.

Forms and elements whose role, class or id names them as adverts, sidebars,
notices, reader comments and the like go, whatever their size, if the page has an
article of its own outside them. Without one they are judged by the content text
that they hold and leave: a wrapper of the article stays, a list of like items
(comments, teasers) does not. The ratios are taken again over what is left. The
article is the page's one article element, or the smallest element that holds
most of the content text; its other nodes, such as headings and short lines,
belong to it.

All passes are linear in the nodes and elements of a page, however deep.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sectio.llm.common import carry, lean, quoted, sized_batches, texts, typed, unpack

# What HTML says of its elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = set("script style noscript template head title nav aside footer button select option textarea input iframe object svg canvas audio video menu dialog".split())
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NAMES = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner sidebar side nav navbar navigation menu "
    "breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup "
    "login share sharing social related recommended recommendations comment comments reply replies respond disqus toolbar pagination pager paging "
    "skip copyright widget search hidden teaser outbrain taboola".split())
# A start tag of a kind closes open elements of these kinds.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
          "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = {"ul", "ol", "dl", "table", "select"}
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "tr", "td", "th", "tbody", "dt", "dd", "figure", "hr"}
CONTAINERS = {"html", "body", "article", "main", "div", "section", "center", "table"}
ARTICLES = {"article", "main"}
ROOTS = {"html", "body", "article", "main"}
READERS = {"comment", "comments", "reply", "replies", "respond", "disqus"}
PUNCTUATION = re.compile(r"[.,;:!?…。、，؟।\"'()]")


def unwanted(tag: str, attrs: dict[str, str | None], inside: bool) -> bool:
    """Whether tag or state tell that an element isn't article text. Inside an
    article a header is the article's own."""
    if tag in NEVER or (tag == "header" and not inside):
        return True
    if tag in ROOTS:
        return False
    if "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true":
        return True
    return bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style") or "", re.I))


def named_so(tag: str, attrs: dict[str, str | None], inside: bool) -> bool:
    """Whether a form, a role or names say that an element isn't article text."""
    if tag == "form" or (attrs.get("role") or "").lower() in ROLES:
        return True
    return any(w in NAMES and not (w == "header" and inside) for w in named_words(attrs))


def named_words(attrs: dict[str, str | None]) -> Iterator[str]:
    """Words of class and id that say what an element is; "with-sidebar" and the
    like tell of something else."""
    for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
        for word in re.findall("[a-z]+", re.sub("([a-z])([A-Z])", r"\1 \2", name).lower()):
            if word in ("has", "with", "no", "without"):
                break
            yield word


class Reader(HTMLParser):
    """Elements as columns (number 0 is ``html``; parents come before children),
    and text nodes as ``(element, block number, text)`` in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.path, self.depth = ["html"], [-1], [0], [0]
        # Of the element or one around it: left out, link text, inside an article.
        self.drop, self.link, self.article = [False], [False], [False]
        # Of the element itself: named as no article text, and as readers' words.
        self.named, self.readers = [False], [False]
        self.paths: dict[tuple[int, str], int] = {}
        self.nodes: list[tuple[int, int, str]] = []
        self.block = 0
        # Open elements; places of each tag among them; the last block element's place up to each.
        self.open, self.places, self.floor = [0], {}, [0]

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "br":
            self.nodes.append((self.open[-1], self.block, " "))
            return
        if tag not in INLINE:
            self.block += 1
            self.shut({"p"}, SCOPES) if tag != "p" else self.shut({"p"}, {"button", "table"})
            if tag in CLOSES:
                self.shut(CLOSES[tag], SCOPES - CLOSES[tag])
        if tag in VOID or tag == "html":
            return
        top = self.open[-1]
        name = (attrs.get("id") or attrs.get("class") or "").split()
        key = (self.path[top], f"{tag}.{name[0]}" if name else tag)
        inside = self.article[top]
        self.tag.append(tag)
        self.parent.append(top)
        self.path.append(self.paths.setdefault(key, len(self.paths) + 1))
        self.depth.append(self.depth[top] + 1)
        self.drop.append(self.drop[top] or unwanted(tag, attrs, inside))
        self.link.append(self.link[top] or tag == "a")
        self.article.append(inside or tag in ARTICLES)
        self.named.append(tag not in ROOTS and named_so(tag, attrs, inside))
        self.readers.append(self.named[-1] and any(w in READERS for w in named_words(attrs)))
        self.places.setdefault(tag, []).append(len(self.open))
        self.floor.append(self.floor[-1] if tag in INLINE else len(self.open))
        self.open.append(len(self.tag) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path", "iframe") and self.tag[self.open[-1]] == tag and len(self.open) > 1:
            self.cut(len(self.open) - 1)

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.block += 1
        if tag == "html" or tag in VOID or not self.places.get(tag):
            return
        at = self.places[tag][-1]
        if tag not in INLINE or self.floor[-1] <= at:  # a stray end of an inline element closes no block
            self.cut(at)

    def cut(self, at: int) -> None:
        """Close the open elements from a place on."""
        while len(self.open) > at:
            self.places[self.tag[self.open.pop()]].pop()
            self.floor.pop()

    def shut(self, tags: set[str], scopes: set[str]) -> None:
        """Close the innermost open element of ``tags`` unless one of ``scopes`` is nearer."""
        last = lambda names: max((self.places[t][-1] for t in names if self.places.get(t)), default=0)
        at = last(tags)
        if at > last(scopes):
            self.cut(at)

    def handle_data(self, data):
        self.nodes.append((self.open[-1], self.block, data))

    def add_up(self, own: list) -> list:
        """Sums over elements and all that they hold, from the elements' own values."""
        out = list(own)
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return out


def smooth(x: np.ndarray, spread: float = 1.0) -> np.ndarray:
    reach = 2
    kernel = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * spread**2))
    padded = np.pad(x, reach)
    weight = np.convolve(np.pad(np.ones(len(x)), reach), kernel, "valid")
    return np.convolve(padded, kernel, "valid") / weight


def content_paths(page: Reader, nodes: list[tuple[int, int, str]], share: float = 0.5) -> set[int]:
    """Paths whose fused ratio reaches ``share`` of the spread (or of the mean,
    if that is less) of all nodes' fused ratios."""
    paths, own = np.unique([page.path[e] for e, _, _ in nodes], return_inverse=True)
    length = np.array([len(" ".join(t.split())) for _, _, t in nodes], float)
    marks = np.array([len(PUNCTUATION.findall(t)) for _, _, t in nodes], float)
    links = np.array([page.link[e] for e, _, _ in nodes], float) * length
    number = np.bincount(own)
    total = np.bincount(own, length)
    per_text = smooth((total / number)[own])
    per_mark = smooth(((np.bincount(own, marks) + 1) / number)[own])
    fused = np.sqrt(per_text * per_mark) * (1 - (np.bincount(own, links) / np.maximum(total, 1))[own])
    level = share * min(fused.std(), fused.mean()) if len(fused) > 1 else 0.0
    mean = np.bincount(own, fused) / number
    return set(paths[(mean >= level) & (mean > 0)].tolist())


def text_sizes(page: Reader, nodes: list[tuple[int, int, str]], paths: set[int] | None = None) -> list[int]:
    """Characters of text directly in each element, on the given paths only."""
    own = [0] * len(page.tag)
    for e, _, t in nodes:
        if paths is None or page.path[e] in paths:
            own[e] += len(t.strip())
    return own


def lone_articles(page: Reader, held: list[int], near: list[int]) -> list[int]:
    """Outermost article and main elements with text that lie in no named
    element, but for articles of which the page has a list (three or more alike)."""
    found = [e for e in range(len(page.tag)) if page.tag[e] in ARTICLES and held[e] and near[e] < 0]
    alike = Counter(page.path[e] for e in found if page.tag[e] == "article")
    found = [e for e in found if page.tag[e] == "main" or alike[page.path[e]] < 3]
    inner = set(found)
    return [e for e in found if not any_above(page, e, inner)]


def any_above(page: Reader, e: int, among: set[int]) -> bool:
    """Whether an element around ``e`` is one of ``among``; articles know whether one is."""
    while page.article[page.parent[e]]:
        e = page.parent[e]
        if e in among:
            return True
    return False


def judge(page: Reader, nodes: list[tuple[int, int, str]], minor: float = 0.25) -> list[tuple[int, int, str]]:
    """The nodes that are in no named element that goes.

    If an article or main element lies outside all named elements, all of these
    go. Otherwise outer ones are judged first, by their text on content paths
    against the text beside them: that outside all named elements, and that of
    the wrappers around them. A list of like items and readers' words go if there
    is any text beside them; an element stays that holds the page's only article
    or main element and at least as much text as is beside it, or that has
    ``minor`` of the page's text and leaves no more than ``minor`` beside it."""
    if not any(page.named):
        return nodes
    full = [n for n in nodes if n[2].strip()]
    if not full:
        return []
    number = len(page.tag)
    near = [-1] * number  # the nearest named element around, or the element itself
    for e in range(1, number):
        near[e] = e if page.named[e] else near[page.parent[e]]
    paths = content_paths(page, full)
    own = text_sizes(page, full, paths)
    held = page.add_up(own)
    any_text = page.add_up(text_sizes(page, full))
    gone = [False] * number
    if lone_articles(page, any_text, near):
        gone = list(page.named)
    else:
        by = {-1: 0}  # content text by the nearest named element
        for e in range(number):
            by[near[e]] = by.get(near[e], 0) + own[e]
        whole = page.add_up([int(page.tag[e] in ARTICLES and any_text[e] > 0 and not page.article[page.parent[e]]) if e else 0 for e in range(number)])
        items = Counter((page.parent[e], page.path[e]) for e in range(1, number) if page.tag[e] not in INLINE and page.tag[e] not in PROSE and held[e])
        lists = [0] * number  # text of like items, three or more under one element
        for e in range(1, number):
            if items.get((page.parent[e], page.path[e]), 0) >= 3:
                lists[page.parent[e]] += held[e]
        for e in range(number - 1, 0, -1):
            lists[page.parent[e]] = max(lists[page.parent[e]], lists[e])
        around = {-1: by[-1]}  # text beside what lies directly in a wrapper
        for e in range(1, number):
            if not page.named[e]:
                continue
            outer = near[page.parent[e]]
            if outer >= 0 and gone[outer]:
                gone[e] = True
                continue
            beside, both = around[outer], around[outer] + held[e]
            if not held[e]:
                stays = False
            elif beside and (page.readers[e] or 2 * lists[e] > held[e]):
                stays = False
            elif whole[e]:
                stays = whole[e] == whole[0] and held[e] >= beside
            else:
                stays = not whole[0] and held[e] >= minor * held[0] and beside <= minor * both
            gone[e] = not stays
            around[e] = beside + by.get(e, 0)
    drop = [False] * number
    for e in range(1, number):
        drop[e] = drop[page.parent[e]] or gone[e]
    return [n for n in nodes if not drop[n[0]]]


def article_of(page: Reader, nodes: list[tuple[int, int, str]], paths: set[int], share: float = 0.75) -> int:
    """The page's one article element; without one, the deepest element that holds
    ``share`` of the content text, widened to its container."""
    held = page.add_up(text_sizes(page, nodes))
    for kind in ("article", "main"):
        found = [e for e in range(len(page.tag)) if page.tag[e] == kind and held[e]]
        among = set(found)
        outer = [e for e in found if not any_above(page, e, among)]
        if len(outer) == 1:
            return outer[0]
    content = page.add_up(text_sizes(page, nodes, paths))
    found = max((e for e in range(len(page.tag)) if content[e] >= share * content[0]), key=lambda e: (page.depth[e], -e))
    # A paragraph or a part of one is no article: its container is, and an enclosing article element above all.
    while found and (page.tag[found] not in CONTAINERS or (page.article[found] and page.tag[found] not in ARTICLES)):
        found = page.parent[found]
    return found


def main_text(html: str) -> str:
    """Text of the article of one page; empty if there is none."""
    page = Reader()
    page.feed(html)
    HTMLParser.close(page)
    wanted = judge(page, [n for n in page.nodes if not page.drop[n[0]]])
    full = [n for n in wanted if n[2].strip()]
    if not full:
        return ""
    paths = content_paths(page, full)
    if not paths and not any(page.article[e] for e, _, _ in full):
        return ""  # nothing but links
    root = article_of(page, full, paths)
    inside = [False] * len(page.tag)
    for e in range(len(page.tag)):
        inside[e] = e == root or (e > 0 and inside[page.parent[e]])
    blocks: dict[int, list[str]] = {}
    for e, block, text in wanted:
        if inside[e]:
            blocks.setdefault(block, []).append(text)
    return " ".join(b for parts in blocks.values() if (b := " ".join("".join(parts).split())))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Add ``text`` and ``n_chars`` (code points) to every row and drop the html;
    columns of those names are replaced. Null or empty html gives an empty text;
    rows are independent, so repeated rows repeat their result."""
    keep = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    held = carry(pages, keep, html=quoted(html_col).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "html"):
            out = [main_text(h) for h in texts(batch.column("html"))]
            yield pa.record_batch([batch.column("rest"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["rest", "text", "n_chars"])

    return unpack(held.mapInArrow(lean(run), typed(held, ["rest"], "text string, n_chars long")), keep, "text", "n_chars")
