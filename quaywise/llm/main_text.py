"""Main text of web pages: boosted trees over node features of the document tree, decoded as a whole tree.

A page becomes a tree of elements and text runs (scripts, styles and other raw elements never enter it). Every
node gets features: its tag and attribute tokens and those of its ancestors, depth and place among siblings,
and densities of its subtree. The trees' score says whether main text lies in a node; decoding then picks the
most likely labelling in which no node is kept under a dropped one, by one pass up and one down the tree. The
kept runs, cut into blocks, give the text.

The model is trained on pages that :func:`training_pages` lays out from a seed, whose main text is known by
construction. Null pages count as empty; a page without main text gives an empty string. Nothing is cut: the
whole page is read whatever its length, in time that grows with it however broken its markup is. Rows are
independent: repeated rows repeat, null ids stay null, further columns of the input are not looked at, an
empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaywise.llm.boosting import Trees, fit_trees
from quaywise.llm.common import small_batches, text_or_empty

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe textarea select object math title head canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "tbody", "thead"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": set(), "tbody": {"table"}}

TAG_GROUPS = {
    "article": "article main",
    "box": "div section center td th tr table tbody thead figure details summary",
    "paragraph": "p blockquote pre figcaption dd dt",
    "heading": "h1 h2 h3 h4 h5 h6 hgroup",
    "list": "ul ol dl menu dir",
    "item": "li",
    "link": "a",
    "navigation": "nav",
    "header": "header",
    "footer": "footer address",
    "aside": "aside",
    "form": "form fieldset button input label legend dialog",
    "inline": "b i em strong span small u s font code q cite mark sub sup time abbr",
    "top": "html body",
    "run": "#",
}
TOKEN_GROUPS = {
    "content": "article articlebody content main post entry story body text page prose maincontent news blog",
    "navigation": "nav navbar navigation menu menubar breadcrumb breadcrumbs toc pagination pager tabs skip",
    "header": "header masthead topbar branding logo hero",
    "footer": "footer copyright legal bottom colophon imprint",
    "side": "sidebar side aside related recommended recommendations widget rail trending popular more",
    "advert": "ad ads advert advertisement adslot sponsor sponsored promo promotion banner outbrain taboola",
    "notice": "cookie cookies consent notice alert popup modal overlay gdpr newsletter subscribe signup warning message",
    "comment": "comment comments commentlist disqus reply replies respond discussion responses thread",
    "share": "share sharing social follow tools toolbar byline meta tags buttons",
    "form": "form search searchbox login contact field",
}
_TAG = {t: i for i, ts in enumerate(TAG_GROUPS.values()) for t in ts.split()}
_OTHER_TAG = len(TAG_GROUPS)
_TOKEN = {t: i for i, ts in enumerate(TOKEN_GROUPS.values()) for t in ts.split()}
_TOKENS = len(TOKEN_GROUPS)
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_SPECIAL = re.compile(r"[>\"']")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_ZEROS, _BEYOND = re.compile(r"&#0++(?=[0-9])"), re.compile(r"&#[0-9]{8,}+")  # of numbers too long to be read
_ATTRIBUTE = re.compile(r"(?i)(?:^|\s)(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_HIDDEN = re.compile(r"(?i)(?:^|\s)hidden(?=[\s=]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true")
_TOKEN_CUT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")


@dataclass
class Page:
    """Nodes in page order: a parent stands before its children; node 0 is the root."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[int] = field(default_factory=lambda: [_OTHER_TAG])
    tokens: list[int] = field(default_factory=lambda: [0])  # bit set of token groups, one more bit: hidden
    run: list[int] = field(default_factory=lambda: [-1])  # number of the text run, for run nodes
    texts: list[str] = field(default_factory=list)
    blocks: list[int] = field(default_factory=list)  # block of each run
    marks: list[bool] = field(default_factory=lambda: [False])  # nodes that training pages mark as main text


def _token_bits(attributes: str) -> int:
    return _short_token_bits(attributes) if len(attributes) <= 512 else _short_token_bits.__wrapped__(attributes)


@lru_cache(maxsize=4096)
def _short_token_bits(attributes: str) -> int:
    bits = 0
    for m in _ATTRIBUTE.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        for token in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()):
            group = _TOKEN.get(token)
            if group is not None:
                bits |= 1 << group
    if _HIDDEN.search(attributes):
        bits |= 1 << _TOKENS
    return bits


class _Markup:
    """Finds where pieces of markup end, in time that grows with the page however broken it is."""

    def __init__(self, source: str):
        self.source, self.size = source, len(source)
        self.last = source.rfind(">")  # nothing behind it is a tag
        self.from_, self.special = 1, 0  # the next of > " ' behind any place between these two stands at the second
        self.hopeless: set[int] = set()  # quotes from which no end of a tag was reached

    def _next_special(self, at: int) -> int:
        if not self.from_ <= at <= self.special:
            m = _SPECIAL.search(self.source, at)
            self.from_, self.special = at, m.start() if m else self.size
        return self.special

    def tag_end(self, at: int) -> int:
        """The place behind the ``>`` of a tag whose name ends at ``at``. One inside quotes does not count, unless the
        quotes leave no other; -1 if there is none at all."""
        place, tried = at, []
        while True:
            place = self._next_special(place)
            if place == self.size or place in self.hopeless:
                break
            if self.source[place] == ">":
                return place + 1
            tried.append(place)
            place = self.source.find(self.source[place], place + 1) + 1
            if not place:
                break
        self.hopeless.update(tried)
        return self.source.find(">", at) + 1 or -1

    def other_end(self, at: int) -> int:
        """The place behind a comment, a character section or a declaration that opens at ``at``; ``at`` if it is none."""
        for start, stop in (("<!--", "-->"), ("<![CDATA[", "]]>")):
            if self.source.startswith(start, at):
                end = self.source.find(stop, at + len(start))
                return self.size if end < 0 else end + len(stop)
        return self.source.find(">", at + 2) + 1 or at if self.source.startswith(("<!", "<?"), at) else at


class _Open:
    """The open elements, by place and by name."""

    def __init__(self):
        self.stack: list[tuple[str, int]] = [("", 0)]
        self.places: dict[str, list[int]] = {}
        self.blocks = [0]  # places of those that are not inline

    def push(self, name: str, number: int) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        if name not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append((name, number))

    def cut(self, place: int) -> None:
        """Close the element at a place and all inside it."""
        while len(self.stack) > place:
            name, _ = self.stack.pop()
            self.places[name].pop()
            if name not in INLINE:
                self.blocks.pop()

    def last(self, names: set[str]) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def end(self, name: str) -> None:
        """An end tag; a stray inline one does not close blocks."""
        place = self.last({name})
        if place and (name not in INLINE or self.blocks[-1] < place):
            self.cut(place)

    def before(self, name: str) -> None:
        """What a start tag closes."""
        if name not in INLINE:
            self.cut(self.blocks[-1] + 1)  # blocks end open inline elements
            if self.stack[-1][0] == "p":
                self.cut(len(self.stack) - 1)
        if name in CLOSES and self.last(CLOSES[name]) > self.last(HOLDS[name]):
            self.cut(self.last(CLOSES[name]))


def parse(source: str) -> Page:
    """The tree of a page, tolerant of missing end tags. A tag that never ends is text."""
    page = Page()
    markup, open_ = _Markup(source), _Open()
    block = 0
    parent, tag, tokens, run, marks = page.parent, page.tag, page.tokens, page.run, page.marks

    def add(name: str, bits: int, number: int) -> int:
        parent.append(open_.stack[-1][1])
        tag.append(_TAG.get(name, _OTHER_TAG))
        tokens.append(bits)
        run.append(number)
        marks.append(False)
        return len(parent) - 1

    def text(piece: str) -> None:
        if piece and not piece.isspace():
            add("#", 0, len(page.texts))
            page.texts.append(piece)
            page.blocks.append(block)
        elif piece and page.texts and page.blocks[-1] == block and not page.texts[-1][-1].isspace():
            page.texts[-1] += " "  # white space between runs of one block

    at = look = 0
    while at < markup.size:
        start = source.find("<", look)
        if start < 0:
            break
        end, m = markup.other_end(start), None
        if end == start and start < markup.last:
            m = _NAME.match(source, start)
            end = markup.tag_end(m.end()) if m else start
        if end <= start:
            look = start + 1
            continue
        text(source[at:start])
        at = look = end
        if m is None:
            continue
        name, attributes = m[2].lower(), source[m.end() : end - 1]
        if name not in INLINE:
            block += 1
        if m[1]:
            if name not in VOID:
                open_.end(name)
        elif name in RAW:
            if name != "head" and not attributes.rstrip().endswith("/"):
                stop = _RAW_END[name].search(source, at)
                at = look = stop and source.find(">", stop.end()) + 1 or markup.size
        elif name not in VOID:
            open_.before(name)
            number = add(name, _token_bits(attributes) if attributes else 0, -1)
            if "data-main" in attributes:
                marks[number] = True
            open_.push(name, number)
    text(source[at:])
    return page


FEATURES = (_OTHER_TAG + 1) * 2 + (_TOKENS + 1) * 2 + 16
_PUNCTUATION = re.compile(r"[.,;:!?]")


def features(page: Page) -> np.ndarray:
    """[node, feature]: tag and attribute groups of the node and of its ancestors, place, and densities."""
    return np.concatenate(list(feature_slices(page)))


def feature_slices(page: Page, nodes: int = 1 << 15) -> Iterator[np.ndarray]:
    """The features of a page's nodes, some at a time."""
    n = len(page.parent)
    parent = page.parent
    chars, linked, stops, words, runs, paragraphs, items = ([0] * n for _ in range(7))
    children, index, depth, above_tags, above_tokens, inside_link = ([0] * n for _ in range(6))
    link, paragraph, item = _TAG["a"], _TAG["p"], _TAG["li"]
    for i in range(1, n):
        p = parent[i]
        index[i] = children[p]
        children[p] += 1
        depth[i] = depth[p] + 1
        above_tags[i] = above_tags[p] | 1 << page.tag[p]
        above_tokens[i] = above_tokens[p] | page.tokens[p]
        inside_link[i] = inside_link[p] or page.tag[p] == link
        number = page.run[i]
        if number >= 0:
            t = page.texts[number]
            size = len(t)
            chars[i], words[i], runs[i] = size, t.count(" ") + 1, 1
            stops[i] = len(_PUNCTUATION.findall(t))
            if inside_link[i]:
                linked[i] = size
    for i in range(n - 1, 0, -1):
        p = parent[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        stops[p] += stops[i]
        words[p] += words[i]
        runs[p] += runs[i]
        paragraphs[p] += paragraphs[i] + (page.tag[i] == paragraph)
        items[p] += items[i] + (page.tag[i] == item)
    a = np.array([chars, linked, stops, words, runs, paragraphs, items, children, index, depth], np.float64)
    up = np.maximum(np.array(parent), 0)
    total = max(a[0, 0], 1.0)
    own, above = np.array(page.tag), np.array(above_tags)
    tok, tok_above = np.array(page.tokens), np.array(above_tokens)
    groups = np.arange(_OTHER_TAG + 1)
    bits = np.arange(_TOKENS + 1)
    c = np.maximum(a[0], 1.0)
    place = np.stack([
        a[9], a[8], a[7][up], a[8] / np.maximum(a[7][up], 1), np.log1p(a[7]),
        np.log1p(a[0]), a[0] / total, np.log1p(a[0][up]), a[0][up] / total, a[0] / np.maximum(a[0][up], 1),
        a[1] / c, a[2] / c, a[3] / c, c / np.maximum(a[4], 1), np.log1p(a[5]), np.log1p(a[6]),
    ], 1)
    for k in range(0, n, nodes):
        part = slice(k, k + nodes)
        flags = [own[part, None] == groups, above[part, None] >> groups & 1, tok[part, None] >> bits & 1, tok_above[part, None] >> bits & 1]
        yield np.concatenate([*flags, place[part]], 1).astype(np.float32)


def decode(parent: list[int], logit: np.ndarray) -> list[bool]:
    """The most likely labels in which every kept node's parent is kept.

    ``drop`` is the log likelihood of dropping a whole subtree, ``best`` that of its best labelling.
    """
    n = len(parent)
    keep = (-np.logaddexp(0, -logit)).tolist()
    drop = (-np.logaddexp(0, logit)).tolist()
    for i in range(n - 1, 0, -1):
        p = parent[i]
        keep[p] += max(keep[i], drop[i])
        drop[p] += drop[i]
    out = [True] * n
    for i in range(1, n):
        out[i] = out[parent[i]] and keep[i] > drop[i]
    return out


def block_text(page: Page, kept: list[bool]) -> str:
    """Kept runs joined within their blocks, references decoded, white space reduced, blocks joined."""
    blocks: list[list[str]] = []
    last = -1
    for i, number in enumerate(page.run):
        if number >= 0 and kept[i]:
            if page.blocks[number] != last:
                blocks.append([])
                last = page.blocks[number]
            blocks[-1].append(page.texts[number])
    out = [" ".join(html.unescape(_BEYOND.sub("&#99999999", _ZEROS.sub("&#", "".join(b)))).split()) for b in blocks]
    return " ".join(b for b in out if b)


# --------------------------------------------------------------------------- training


def training_pages(n: int = 200, seed: int = 11) -> Iterator[str]:
    """Pages in many layouts; elements of the main text carry a ``data-main`` mark."""
    r = np.random.default_rng(seed)
    pick = lambda *xs: xs[int(r.integers(len(xs)))]
    maybe = lambda p: bool(r.random() < p)

    def words(lo: int, hi: int) -> str:
        out = ["".join(pick("ba", "to", "ri", "ne", "su", "el", "an", "or") for _ in range(int(r.integers(1, 5)))) for _ in range(int(r.integers(lo, hi + 1)))]
        for k in range(7, len(out), int(r.integers(7, 15))):
            out[k] += pick(".", ",", ",", ";")
        return " ".join(out).capitalize() + pick(".", ".", "", "!")

    def names(kind: str, chance: float = 0.75) -> str:
        if not maybe(chance):
            return ""
        token = pick(*TOKEN_GROUPS[kind].split())
        shape = pick(token, f"{token}-{pick('box', 'wrap', 'inner', 'block', 'item')}", f"site-{token}", f"{token}{int(r.integers(9))}", f"x {token}")
        return f' {pick("class", "class", "id")}="{shape}"'

    def links(lo: int, hi: int) -> str:
        body = [f'<a href="/{k}">{words(1, 4)}</a>' for k in range(int(r.integers(lo, hi + 1)))]
        return pick("<ul>" + "".join(f"<li>{x}</li>" for x in body) + "</ul>", " | ".join(body), "".join(f"<div>{x}</div>" for x in body))

    def junk(kind: str) -> str:
        tag = {"navigation": pick("nav", "nav", "div"), "header": pick("header", "header", "div"), "footer": pick("footer", "footer", "div"), "side": pick("aside", "aside", "div", "section"), "form": "form"}.get(kind, pick("div", "section", "div", "aside"))
        named = names(kind, 0.6 if tag in ("nav", "header", "footer", "aside", "form") else 1.0)
        body = {
            "navigation": lambda: links(3, 12),
            "header": lambda: f"<h1>{words(1, 4)}</h1>" * maybe(0.5) + f"<p>{words(2, 9)}</p>" * maybe(0.6) + links(2, 6) * maybe(0.5),
            "footer": lambda: f"<p>&copy; {words(2, 12)}</p>" if maybe(0.5) else f"&copy; {words(3, 30)}" + links(1, 6) * maybe(0.5),
            "side": lambda: f"<h3>{words(1, 4)}</h3>" + pick(links(3, 9), f"<p>{words(8, 60)}</p>", f"{words(8, 30)}"),
            "advert": lambda: pick(words(3, 25), f"<p>{words(4, 40)}</p>", f'<a href="/x">{words(3, 9)}</a>'),
            "notice": lambda: pick(f"<p>{words(6, 45)}</p>", words(5, 25)) + f"<button>{words(1, 2)}</button>" * maybe(0.6),
            "comment": lambda: f"<h3>{words(1, 3)}</h3>" * maybe(0.7) + "".join(f"<{t}{names('comment', 0.5)}><p>{words(5, 70)}</p></{t}>" for t in [pick("div", "li", "article")] for _ in range(int(r.integers(1, 8)))),
            "share": lambda: links(2, 6),
            "form": lambda: f"<label>{words(1, 3)}</label><input name=q><button>{words(1, 2)}</button>" + f"<p>{words(4, 20)}</p>" * maybe(0.4),
        }[kind]()
        return f"<{tag}{named}>{body}</{tag}>"

    def paragraph() -> str:
        kind = int(r.integers(12))
        if kind < 7:
            inner = words(3, 120)
            if maybe(0.25):
                inner += f" <a href='/y'>{words(1, 4)}</a> {words(2, 20)}"
            if maybe(0.25):
                inner = f"<b>{words(1, 8)}</b><br>{inner}"
            return f"<p data-main>{inner}</p>" if maybe(0.9) else f"<p data-main>{inner}"
        if kind == 7:
            return f"<h2 data-main>{words(2, 8)}</h2>"
        if kind == 8:
            return "<ul data-main>" + "".join(f"<li data-main>{words(2, 25)}</li>" for _ in range(int(r.integers(2, 7)))) + "</ul>"
        if kind == 9:
            return f"<blockquote data-main><p data-main>{words(8, 50)}</p></blockquote>"
        if kind == 10:
            return f"<div data-main>{words(10, 90)}</div>"
        return f"<p data-main>{words(1, 4)}</p>"

    for _ in range(n):
        parts = [f"<h1 data-main>{words(2, 14)}</h1>"] * maybe(0.85)
        for _ in range(int(r.integers(1, 16))):
            parts.append(paragraph())
            if maybe(0.08):
                parts.append(junk(pick("advert", "share", "side", "notice")))
        tag = pick("article", "article", "main", "div", "section")
        article = f"<{tag}{names('content', 1.0 if tag in ('div', 'section') else 0.4)} data-main>{''.join(parts)}</{tag}>"
        before = [junk(k) for k in ("header", "navigation", "advert", "notice", "form") if maybe(0.55)]
        after = [junk(k) for k in ("share", "comment", "side", "advert", "form", "footer") if maybe(0.5)]
        if maybe(0.2):
            before.append(junk("side"))
        middle = article
        if maybe(0.4):
            wrap = pick("div", "main", "section")
            cut = int(r.integers(0, len(after) + 1))
            middle = f"<{wrap}{names('content', 0.5)}>{article}{''.join(after[:cut])}</{wrap}>"
            after = after[cut:]
        yield f"<!DOCTYPE html><html><head><title>{words(1, 6)}</title><style>p{{}}</style></head><body>{''.join(before)}{middle}{''.join(after)}</body></html>"


def labelled(page: Page) -> np.ndarray:
    """1 where main text lies in a node: marked elements, their runs and inline children, and what holds them."""
    n = len(page.parent)
    inline = {_TAG["b"], _TAG["a"], _TAG["#"]}
    y = np.zeros(n, bool)
    for i in range(1, n):
        p = page.parent[i]
        y[i] = page.marks[i] or (y[p] and page.tag[i] in inline and (page.marks[p] or page.tag[p] in inline))
    for i in range(n - 1, 0, -1):
        if y[i]:
            y[page.parent[i]] = True
    return y


@lru_cache(maxsize=1)
def node_model() -> Trees:
    pages = [parse(p) for p in training_pages()]
    return fit_trees(np.concatenate([features(p) for p in pages]), np.concatenate([labelled(p) for p in pages]).astype(float), trees=40, bins=16)


# --------------------------------------------------------------------------- operator


def main_text(sources: list[str], model: Trees) -> list[str]:
    """The main text of each page. Small pages are scored together, so that what is held stays bounded."""
    out: list[str] = []
    held: list[tuple[Page, np.ndarray]] = []

    def score() -> None:
        logit = model.logit(np.concatenate([f for _, f in held])) if held else np.zeros(0)
        at = 0
        for page, f in held:
            out.append(block_text(page, decode(page.parent, logit[at : at + len(f)])))
            at += len(f)
        held.clear()

    for source in sources:
        page = parse(source)
        if len(page.parent) > 4096:
            score()
            out.append(block_text(page, decode(page.parent, np.concatenate([model.logit(f) for f in feature_slices(page)]))))
            continue
        held.append((page, features(page)))
        if sum(len(f) for _, f in held) > 1 << 15:
            score()
    score()
    return out


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    model = node_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 64):
            text = main_text(batch.column(2).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), text_or_empty(html_col).alias("html"))
    return source.mapInArrow(run, f"page_id {dict(source.dtypes)['page_id']}, url string, text string, n_chars long")
