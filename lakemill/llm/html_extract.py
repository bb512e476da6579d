"""Main-text extraction with gradient-boosted trees over DOM-node features.

Each page is parsed into a tree of block elements. Boosted trees score every
block from its tag, the tokens of its class, id and role, its depth, its
subtree's text, link and tag densities, and its siblings. Decoding is
hierarchical: over all ways to keep or drop blocks in which nothing inside a
dropped block is kept, the one with the highest summed score wins, found
bottom-up in one pass over the tree.

The trees are fitted on made pages (`made_page`, MADE of them), whose blocks'
truth is known; no page of the corpus is used.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.llm import boost
from lakemill.llm.common import in_batches

MADE = 700

#: Fixed values of HTML: elements by how their text counts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER = frozenset("script style textarea title xmp iframe noembed noframes template svg math canvas object audio video select option datalist button head noscript dialog".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output progress q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr br img picture source map area input".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split())
#: Start tag to the open elements that it ends, and where the search for them stops.
ENDS = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "tbody": (frozenset({"thead", "tbody", "tfoot"}), frozenset({"table"})),
    "tfoot": (frozenset({"thead", "tbody", "tfoot"}), frozenset({"table"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist"})),
    "body": (frozenset({"head"}), frozenset()),
}
#: Start tags that leave an open head open.
METADATA = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
_SCOPE = frozenset("table td th caption template object button".split())

#: Attribute tokens that speak for boilerplate, by sort, and for content.
TOKENS = {
    "menu": frozenset("nav navbar navigation menu menus breadcrumb breadcrumbs toc tabs pagination pager skip topbar toolbar links".split()),
    "frame": frozenset("header masthead footer foot copyright colophon legal banner contentinfo site logo branding".split()),
    "side": frozenset("sidebar side aside rail related recommended widget widgets promo teaser complementary trending popular tags".split()),
    "advert": frozenset("ad ads advert adverts advertisement sponsor sponsored adsbygoogle dfp commercial promotion".split()),
    "notice": frozenset("cookie cookies consent gdpr notice notices alert popup modal overlay subscribe newsletter signup paywall disclaimer notification".split()),
    "talk": frozenset("comment comments reply replies discussion disqus respond feedback reviews share sharing social follow".split()),
    "form": frozenset("form search login register input contact field fieldset".split()),
    "text": frozenset("article content main post story entry body text page document prose blog column paragraph".split()),
}
TAGS = ("p", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "table", "blockquote", "pre", "figure", "dl", "details")
FEATURES = (*(f"tag_{t}" for t in TAGS), "heading", "other_tag", *(f"token_{k}" for k in TOKENS), *(f"under_{k}" for k in TOKENS), "under_article", "under_boiler_tag", "depth", "log_text", "link_share", "own_share", "text_per_tag", "log_tags", "paragraphs", "stops", "siblings", "place", "same_tag", "share_of_page", "inputs", "has_heading")

_COMMENT = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))", re.S)
_NAME = re.compile(r"<(/?)([a-zA-Z])")
_NAME_STOP, _TAG_STOP = re.compile(r"[\s/>]"), re.compile(r"[>\"']")
_ATTR = re.compile(r"(?:class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_TOKEN = re.compile(r"[a-z]+")
_HEADING = re.compile(r"h[1-6]$")
_BOILER_TAGS = frozenset("nav footer aside form".split())


class Block:
    """A block element: its pieces are blocks below it and runs of inline text."""

    __slots__ = ("tag", "tokens", "parent", "depth", "parts", "text", "links", "tags", "stops", "paragraphs", "inputs", "own", "headings", "row")

    def __init__(self, tag: str, tokens: frozenset, parent: Block | None):
        self.tag, self.tokens, self.parent = tag, tokens, parent
        self.depth = parent.depth + 1 if parent else 0
        self.parts: list = []
        self.text = self.links = self.tags = self.stops = self.paragraphs = self.inputs = self.own = self.headings = self.row = 0


_NO_TOKENS: frozenset = frozenset()


class Tags:
    """Where the tags of a page end, in time that grows with the page: no stretch
    is searched twice, and a quote that opens no end is remembered."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in ">\"'"}
        self.found = {_NAME_STOP: (0, -1), _TAG_STOP: (0, -1)}
        self.dead: set[int] = set()

    def _next(self, stop: re.Pattern, at: int) -> int:
        lo, hi = self.found[stop]
        if not lo <= at <= hi:
            m = stop.search(self.page, at)
            self.found[stop] = lo, hi = at, m.start() if m else len(self.page)
        return hi

    def end(self, at: int) -> tuple[int, int]:
        """Of the tag whose name begins at `at`: behind the name, and its `>`,
        which quotes may hide; -1 if there is none."""
        name = at = self._next(_NAME_STOP, at)
        met = []
        while (at := self._next(_TAG_STOP, at)) <= self.last[">"]:
            sign = self.page[at]
            if sign == ">":
                return name, at
            if at in self.dead:
                break
            met.append(at)
            if at >= self.last[sign]:
                break
            at = self.page.find(sign, at + 1) + 1
        self.dead.update(met)
        return name, -1


def parse(page: str) -> Block:
    """The page as blocks. Scripts, styles, comments, markup and the other
    elements of NEVER leave nothing."""
    root = Block("", _NO_TOKENS, None)
    block = root
    stack: list[tuple[str, Block | None]] = []  # open elements; blocks with the one they opened
    n_open: Counter = Counter()  # of each name, so that a search for none costs nothing
    run: list[str] = []
    links = never = 0
    at, tags, size = 0, Tags(page), len(page)

    def flush() -> None:
        nonlocal run
        if run:
            if text := " ".join(html.unescape("".join(run)).split()):
                block.parts.append(text)
                block.own += len(text)
                block.stops += sum(map(text.count, ".,;:!?"))
            run = []

    def pop(to: int) -> None:
        nonlocal block, links, never
        while len(stack) > to:
            name, own = stack.pop()
            n_open[name] -= 1
            if own is not None:
                flush()
                block = own.parent
            links -= name == "a"
            never -= name in NEVER

    def opened(names: frozenset, stop: frozenset) -> int:
        if not any(n_open[x] for x in names):
            return -1
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                return k
            if stack[k][0] in stop:
                return -1
        return -1

    while at < size:
        begin = at
        if page[at] != "<":
            at = page.find("<", at)
            at = size if at < 0 else at
        elif page.startswith("<!--", at):
            at = _COMMENT.match(page, at).end()
            continue
        else:
            m, end = _NAME.match(page, at) if at < tags.last[">"] else None, -1
            if m:
                behind, end = tags.end(m.start(2))
            if end < 0 and at < tags.last[">"] and page[at + 1] in "!?/":
                at = page.find(">", at + 2 - (page[at + 1] == ">")) + 1
                continue
            at = end + 1 if end >= 0 else at + 1
        if page[begin] != "<" or end < 0:  # text, or a sign that opens nothing
            text = page[begin:at]
            if stack and stack[-1][0] == "head" and text.strip(" \t\n\r\f"):
                pop(len(stack) - 1)
            if not never:
                run.append(text)
                if links:
                    block.links += len(text.strip())
            continue
        name, attributes = page[m.start(2) : behind].lower(), page[behind:end]
        if m[1]:
            if name == "br":
                run.append(" ")
            elif (k := opened(frozenset({name}), _SCOPE if name not in _SCOPE else frozenset({"table"} - {name}))) >= 0:
                pop(k)
            continue
        if stack and stack[-1][0] == "head" and name not in METADATA:
            pop(len(stack) - 1)
        if name in RAW:
            close = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at) if at < tags.last[">"] else None
            at = close.end() if close else size
            continue
        if name in CLOSES_P and (k := opened(frozenset({"p"}), _SCOPE)) >= 0:
            pop(k)
        if name in ENDS and (k := opened(*ENDS[name])) >= 0:
            pop(k)
        block.tags += 1
        if name in VOID:
            if name == "br":
                run.append(" ")
            elif name == "hr":
                flush()
            block.inputs += name == "input"
            continue
        own = None
        if name not in INLINE and not never:
            flush()
            tokens = frozenset(t for a in _ATTR.findall(attributes) for t in _TOKEN.findall("".join(a).lower())) if attributes else _NO_TOKENS
            own = Block(name, tokens, block)
            block.parts.append(own)
            block = own
        block.inputs += name in ("select", "button", "textarea")
        links += name == "a"
        never += name in NEVER
        if page[end - 1] == "/" and name in ("svg", "math"):
            never -= 1
            continue
        stack.append((name, own))
        n_open[name] += 1
    pop(0)
    flush()
    return root


def walk(root: Block) -> list[Block]:
    """All blocks, each after the one it is in; sums of subtrees are filled in."""
    out = [root]
    for b in out:
        b.row = 0
        out.extend(p for p in b.parts if isinstance(p, Block))
    for b in reversed(out):
        b.text += b.own
        b.paragraphs += b.tag == "p"
        b.headings += bool(_HEADING.match(b.tag))
        if b.parent is not None:
            p = b.parent
            p.text += b.text
            p.links += b.links
            p.tags += b.tags + 1
            p.stops += b.stops
            p.paragraphs += b.paragraphs
            p.inputs += b.inputs
            p.headings += b.headings
    return out


_TAG_AT = {t: k for k, t in enumerate(TAGS)}


def features(blocks: list[Block]) -> np.ndarray:
    """One row of FEATURES for each block but the root, blocks[0]."""
    rows = []
    page = max(1, blocks[0].text)
    under: dict[int, tuple] = {id(blocks[0]): ((0,) * len(TOKENS), 0, 0)}
    sibs: dict[int, tuple] = {}
    for b in blocks:
        kids = [p for p in b.parts if isinstance(p, Block)]
        same: dict[str, int] = {}
        for k in kids:
            same[k.tag] = same.get(k.tag, 0) + 1
        for j, k in enumerate(kids):
            sibs[id(k)] = (len(kids), j / max(1, len(kids) - 1), same[k.tag] / len(kids))
        if b.parent is None:
            continue
        above, in_article, in_boiler = under[id(b.parent)]
        tokens = tuple(len(b.tokens & words) for words in TOKENS.values()) if b.tokens else (0,) * len(TOKENS)
        under[id(b)] = (tuple(map(int.__or__, above, (int(t > 0) for t in tokens))), in_article or b.tag in ("article", "main"), in_boiler or b.tag in _BOILER_TAGS)
        tag = [0.0] * len(TAGS)
        if b.tag in _TAG_AT:
            tag[_TAG_AT[b.tag]] = 1.0
        heading = bool(_HEADING.match(b.tag))
        n, place, alike = sibs[id(b)]
        text = max(1, b.text)
        rows.append((
            *tag, heading, not heading and b.tag not in _TAG_AT, *tokens, *above, in_article, in_boiler, b.depth, np.log1p(b.text), min(1.0, b.links / text), b.own / text, min(500.0, b.text / (b.tags + 1)), np.log1p(b.tags),
            b.paragraphs / (b.tags + 1), b.stops / text, n, place, alike, b.text / page, b.inputs, b.headings > 0,
        ))
    return np.array(rows, dtype=np.float64).reshape(-1, len(FEATURES))


def decode(blocks: list[Block], logit: np.ndarray) -> str:
    """The kept blocks' text, one line a run, in page order."""
    n = len(blocks)
    at = {id(b): k for k, b in enumerate(blocks)}
    score = np.r_[0.0, logit] / 2  # the root is kept
    keep, drop, choice = [0.0] * n, [0.0] * n, [True] * n
    for k in range(n - 1, -1, -1):
        own, b = float(score[k]), blocks[k]
        up, down = own, -own
        for p in b.parts:
            if isinstance(p, Block):
                j = at[id(p)]
                up += max(keep[j], drop[j])
                down += drop[j]
        keep[k], drop[k] = up, down
        choice[k] = up > down
    choice[0] = True
    lines: list[str] = []
    todo: list = [blocks[0]]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            lines.append(x)
        elif choice[at[id(x)]]:
            todo.extend(reversed(x.parts))
    return "\n".join(lines)


def _made(rnd: random.Random) -> str:
    """A made page, whose content runs begin with the sign ¤."""
    words = "ther on ing re la que ei nder und sta ment over ick tion al ora".split()
    w = lambda: "".join(rnd.choice(words) for _ in range(rnd.randint(1, 3)))
    phrase = lambda lo, hi: " ".join(w() for _ in range(rnd.randint(lo, hi))).capitalize()
    # Sentences of all sorts, alike inside and outside the main text.
    say = lambda lo, hi: " ".join(phrase(1, 12) + rnd.choice([".", ".", ",", "!", "?", ""]) for _ in range(rnd.randint(1, max(1, rnd.choice([lo, hi, hi]) // 6))))
    body = lambda lo, hi: f"¤ {say(lo, hi)}{rnd.choice(['', '', '***', ' &amp;&amp;'])}"
    link = lambda: f'<a href="/{w()}">{phrase(1, 3)}</a>'
    ul = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rnd.randint(2, 9))) + "</ul>"
    named = lambda tag, names, inner: f'<{tag} {rnd.choice(["class", "id"])}="{rnd.choice(names)}{rnd.choice(["", " box", "-1", " x2"])}">{inner}</{tag}>'
    noise = [
        lambda: f"<nav>{ul()}</nav>",
        lambda: named("div", ["menu", "navbar", "breadcrumbs", "main-nav", "top-links"], ul()),
        lambda: f"<header><h1>{say(1, 4)}</h1><p>{say(2, 8)}</p></header>",
        lambda: named("div", ["site-header", "masthead", "banner"], f"<h2>{say(1, 3)}</h2>{link()}"),
        lambda: f"<footer>{rnd.choice(['&copy; ', ''])}{say(2, 60)}{rnd.choice(['', '', link(), '<p>' + say(3, 9) + '</p>'])}</footer>",
        lambda: named("div", ["footer", "copyright", "legal"], rnd.choice([f"<p>{say(3, 30)}</p>", say(3, 40)])),
        lambda: f"<aside><h3>{say(1, 3)}</h3><p>{say(4, 25)}.</p></aside>",
        lambda: named("div", ["sidebar", "related", "widget", "side-rail"], rnd.choice([ul(), f"<h3>{say(1, 3)}</h3><p>{say(5, 25)}.</p>"])),
        lambda: named("div", ["ad", "ads", "advert", "sponsored", "ad-slot"], say(3, 40)),
        lambda: named("div", ["ad", "advertisement"], f"<p>{say(4, 20)}.</p>{link()}"),
        lambda: named(rnd.choice(["div", "section"]), ["cookie-notice", "consent", "gdpr", "newsletter", "popup", "notice", "alert"], f"<p>{say(5, 25)}.</p>" + rnd.choice(["", "<button>OK</button>"])),
        lambda: f'<form action="/{w()}"><label>{say(1, 3)}</label><input name="q"><p>{say(2, 6)}</p></form>',
        lambda: named(rnd.choice(["div", "section", "ol"]), ["comments", "comment-list", "replies", "discussion"], "".join(named(rnd.choice(["div", "li", "article"]), ["comment", "reply"], f"<p>{say(3, 40)}.</p>") for _ in range(rnd.randint(1, 5)))),
        lambda: named("div", ["share", "social", "follow"], link() + link()),
    ]
    para = [
        lambda: f"<p>{body(1, 60)}</p>",
        lambda: f"<p>{body(1, 60)}</p>",
        lambda: f"<p>{body(10, 90)} {link()} {say(2, 9)}.</p>",
        lambda: f"<p><b>{body(1, 40)}<br>",
        lambda: f"<{rnd.choice(['h2', 'h3'])}>{body(1, 6)}</{rnd.choice(['h2', 'h3'])}>",
        lambda: "<ul>" + "".join(f"<li>{body(1, 15)}</li>" for _ in range(rnd.randint(2, 5))) + "</ul>",
        lambda: f"<blockquote><p>{body(5, 30)}</p></blockquote>",
        lambda: f"<pre>{body(3, 12)}</pre>",
        lambda: "<table>" + "".join(f"<tr><td>{body(1, 3)}</td><td>{body(1, 3)}</td></tr>" for _ in range(rnd.randint(1, 4))) + "</table>",
        lambda: f"<div>{body(4, 50)}</div>",
        lambda: f"<figure><img src=x><figcaption>{body(2, 10)}</figcaption></figure>",
    ]
    inside = [rnd.choice(para)() for _ in range(rnd.choice([0, 1, 1, 2, 4, 8, 14]))]
    if rnd.random() < 0.25:
        inside.insert(rnd.randint(0, len(inside)), rnd.choice(noise[7:])())
    title = rnd.choice([f"<h1>{body(1, 8)}</h1>", f"<header><h1>{body(1, 8)}</h1></header>", f"<h1>{body(1, 8)}</h1>", ""]) if inside else f"<h1>{body(1, 8)}</h1>"
    inner = title + "".join(inside)
    wrap = rnd.choice([
        lambda x: f"<article>{x}</article>", lambda x: f"<article>{x}</article>", lambda x: f"<main>{x}</main>", lambda x: f"<main><article>{x}</article></main>",
        lambda x: named("div", ["content", "post", "entry-content", "article-body", "story", "main"], x), lambda x: f'<div id="page"><section>{x}</section></div>', lambda x: f"<div><div>{x}</div></div>", lambda x: x,
    ])
    top = [rnd.choice(noise)() for _ in range(rnd.randint(0, 3))]
    end = [rnd.choice(noise)() for _ in range(rnd.randint(0, 3))]
    page = "".join(top) + wrap(inner) + "".join(end)
    return f"<!DOCTYPE html><html><head><title>{say(1, 5)}</title><style>p{{}}</style></head><body>{rnd.choice(['', '<script>var a=1;</script>'])}{page}{rnd.choice(['</body></html>', ''])}"


def made_page(seed: int) -> tuple[str, str]:
    """A page and its main text."""
    page = _made(random.Random(seed))
    lines = [t for t in _runs(parse(page)) if "¤" in t]
    return page.replace("¤ ", ""), "\n".join(t.replace("¤ ", "") for t in lines)


def _runs(b: Block) -> Iterator[str]:
    for p in b.parts:
        if isinstance(p, str):
            yield p
        else:
            yield from _runs(p)


@lru_cache(maxsize=2)
def model(pages: int = MADE) -> boost.Boosted:
    xs, ys = [], []
    for seed in range(pages):
        marked = _made(random.Random(seed))
        truth = walk(parse(marked))
        blocks = walk(parse(marked.replace("¤ ", "")))
        xs.append(features(blocks))
        good = {id(b): any("¤" in t for t in _runs(b)) for b in truth}
        ys.append(np.array([good[id(b)] for b in truth[1:]]))
    return boost.fit(np.concatenate(xs), np.concatenate(ys), rounds=120, depth=4)


def extract(pages: list[str], trees: boost.Boosted) -> list[str]:
    parsed = [walk(parse(p)) for p in pages]
    rows = [features(b) for b in parsed]
    logit = trees.logit(np.concatenate(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for blocks, x in zip(parsed, rows):
        out.append(decode(blocks, logit[at : at + len(x)]))
        at += len(x)
    return out


def _extract(batches: Iterator[pa.RecordBatch], trees: boost.Boosted, group_chars: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts: list[str] = []
        held: list[str] = []
        size = 0
        for h in batch.column(2):
            held.append(h.as_py() or "")
            size += len(held[-1])
            if size > group_chars:
                texts += extract(held, trees)
                held, size = [], 0
        texts += extract(held, trees)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and text (lines are blocks, in page order) of each row.

    Null and empty pages, and pages without content, have the empty text.
    Unclosed and stray tags are read as browsers do. Pages of any length are
    read whole, in time that grows with their length. Of decisions that tie, a
    block is dropped. A null url stays null. Repeated rows are extracted alike,
    also under a null id, which stays null. Empty table: no rows. Other columns
    are not looked at.
    """
    trees = model()
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return in_batches(rows).mapInArrow(lambda it: _extract(it, trees), "page_id long, url string, text string")
