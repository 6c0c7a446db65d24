"""HTML extraction: flat text blocks, classified by a decision tree.

A page becomes a flat list of text blocks. Each has its word count and link density, those of its neighbours, whether it
is a heading, whether it stands in an article, and how much of the page's text stands in better places than it does: a
container that is or names itself something else, or a form, gives way to open text, and open text to an article. A
small decision tree, trained here on a labelled table, says which blocks are main text. Names are weak evidence: one
counts only if all its parts say so, and where no text is open, words, links and neighbours decide.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from dataclasses import dataclass
from functools import cache
from html import unescape

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts, pick

#: Elements whose content is no markup, elements that hold no text of the page, elements that start a
#: block, and elements that never are main text.
RAW = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes"}
SILENT = {"noscript", "template", "svg", "math", "object", "select", "canvas", "audio", "video", "datalist"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
OTHER = {"nav", "header", "footer", "aside", "menu", "dialog", "button", "label"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "dialog", "alert", "alertdialog", "form"}
NAMES = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "byline", "comment", "comments", "commentlist", "consent", "cookie", "cookies", "disqus", "footer", "form", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "paywall", "popup", "promo", "promoted", "related", "replies", "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "tags", "toolbar", "widget"}
#: Parts of such names that say nothing by themselves (``site-footer``, ``shareButtons``).
BLANK = {"area", "bar", "block", "body", "bottom", "box", "button", "buttons", "col", "column", "container", "fixed", "global", "group", "icons", "inner", "item", "items", "js", "large", "left", "link", "links", "list", "main", "media", "message", "mobile", "new", "outer", "overlay", "panel", "posts", "primary", "right", "secondary", "section", "site", "slot", "small", "sticky", "text", "title", "top", "unit", "up", "wrap", "wrapper"}
#: Names that in an article are the article's own.
IN_ARTICLE = {"byline", "tags", "header", "masthead"}
#: Names of an article that is a reader's or something beside the page's own.
NOT_ARTICLE = {"comment", "comment-body", "reply", "related", "promo", "advert", "advertisement", "ad", "sponsored", "teaser"}
#: What may stand in a head; elements of the foreign kind, which alone can end in their start tag.
IN_HEAD = {"base", "basefont", "bgsound", "head", "link", "meta", "title", "style", "script", "noscript", "template", "noframes"}
FOREIGN = {"svg", "math"}
#: Elements of tables whose start ends those named first, out to the nearest of those named last (or the page).
CELLS, ROWS, PARTS = ("td", "th"), ("tr", "td", "th"), ("tbody", "thead", "tfoot")
ENDS = {t: (CELLS, ("tr", *PARTS, "table")) for t in CELLS} | {"tr": (ROWS, (*PARTS, "table"))} | {t: ((*PARTS, *ROWS), ("table",)) for t in PARTS}
#: Elements that an end tag of another kind doesn't reach out of, and the end tags that do.
WALLS, TABLE = ("td", "th", "caption", "table", "object", "template"), {"table", "caption", "tr", *CELLS, *PARTS, "body", "html"}
#: Headings end each other; a paragraph ends where a block starts, but for these.
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
IN_PARAGRAPH = {"option", "optgroup", "body", "html", "legend", "tr", "caption", *CELLS, *PARTS}
#: Elements of lists that end a sibling across open elements of the last kind, but no others.
ITEMS, THROUGH = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}, {"address", "div", "p"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}

#: A comment, a declaration, or a tag (slash, name, attributes). A quote counts right after ``=`` only, if it is closed.
_S = r"[ \t\n\f\r]"
_KEY = r"(?:=[^ \t\n\f\r/>=]*+|[^ \t\n\f\r/>=]++)"
_VALUE = rf"""{_S}*+={_S}*+(?:"[^"]*+"|'[^']*+'|[^ \t\n\f\r>]*+)"""
_TOKEN = re.compile(rf"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^ \t\n\f\r/>]*+)((?:(?:{_S}|/)++|{_KEY}(?:{_VALUE})?+)*+)(?:>|\Z)""", re.S)
_ATTR = re.compile(rf"""({_KEY})(?:{_S}*={_S}*("[^"]*"|'[^']*'|[^ \t\n\f\r>]*))?""")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Names of main text; an element that has one is nothing else.
OWN = {"article", "content", "entry", "main", "post", "story"}
#: Where a block stands: nowhere known, in what names itself something else than main text, in an article, in an element
#: (or role) that never holds main text, in a form.
UNKNOWN, NOT_MAIN, MAIN, CHROME, FORM = range(5)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    place: int
    heading: bool = False

    @property
    def density(self) -> float:
        return min(1.0, self.linked / self.words) if self.words else 0.0


def _says_other(names: list[str], inside: int) -> bool:
    """Whether classes and ids name something else than main text: one of them does in all its parts, and none names main text."""
    parts = [{w.lower() for w in _NAME.findall(name)} for name in names]
    if any(p and p <= OWN for p in parts):
        return False
    mine = NAMES - IN_ARTICLE if inside == MAIN else NAMES
    return any(p & mine and p <= mine | BLANK for p in parts)


def _attributes(attrs: str) -> dict[str, str]:
    """Names in lower case and values; the first of a name counts."""
    out: dict[str, str] = {}
    for m in _ATTR.finditer(attrs):
        value = m[2] or ""
        if len(value) > 1 and value[0] in "\"'" and value[-1] == value[0]:
            value = value[1:-1]
        out.setdefault(m[1].lower(), unescape(value) if "&" in value else value)
    return out


def _ends_itself(attrs: str) -> bool:
    """Whether the last slash stands alone, not in a value."""
    return attrs.endswith("/") and max((m.end() for m in _ATTR.finditer(attrs)), default=0) < len(attrs)


def _place(tag: str, attrs: str, inside: int) -> int:
    """Where the content of an element stands that itself stands ``inside``."""
    if tag in OTHER and not (tag == "header" and inside == MAIN):
        return CHROME
    has = _attributes(attrs) if attrs else {}
    role = has.get("role", "").strip().lower()
    if "hidden" in has or role in ROLES or has.get("aria-hidden", "").strip().lower() == "true" or _UNSEEN.search(has.get("style", "")):
        return CHROME
    names = [x for k in ("class", "id") for x in has.get(k, "").split()]
    if inside == CHROME or tag in ("body", "html"):
        return inside
    if tag == "main" or role == "main":
        return MAIN
    if tag == "article" or role == "article":
        return NOT_MAIN if any(x.lower() in NOT_ARTICLE for x in names) else inside if inside == NOT_MAIN else MAIN
    if _says_other(names, inside):
        return NOT_MAIN
    return FORM if tag == "form" and inside != NOT_MAIN else inside


def blocks(html: str) -> list[Block]:
    """Text blocks in page order. Unclosed and stray tags are taken as they come, and no nesting is too deep.

    Inline elements that aren't main text leave their paragraph whole: their text is dropped.
    """
    out: list[Block] = []
    # Open elements that change the place or are blocks: tag; the place, link and mute outside; the nearest block (itself
    # included) that isn't in THROUGH.
    stack: list[tuple[str, int, bool, bool, int]] = []
    where: dict[str, list[int]] = defaultdict(lambda: [-1])  # where in the stack the open elements of a tag are
    place, link, mute = UNKNOWN, False, False
    text: list[str] = []
    linked: list[str] = []

    def close() -> None:
        if text and not mute:
            whole = " ".join(unescape("".join(text)).split())
            if whole:
                out.append(Block(whole, whole.count(" ") + 1, len(unescape(" ".join(linked)).split()), place, max(where[t][-1] for t in HEADINGS) >= 0))
            text.clear()
            linked.clear()

    def push(tag: str) -> None:
        wall = len(stack) if tag in BLOCKS and tag not in THROUGH else stack[-1][4] if stack else -1
        where[tag].append(len(stack))
        stack.append((tag, place, link, mute, wall))

    def leave(depth: int) -> tuple[int, bool, bool]:
        """Close all from this depth on; place, link and mute outside."""
        outside = stack[depth][1:4]
        for t, *_ in stack[depth:]:
            where[t].pop()
        del stack[depth:]
        return outside

    at, size = 0, len(html)
    while at < size:
        m = _TOKEN.search(html, at)
        start = m.start() if m else size
        if start > at and not mute:
            piece = html[at:start]
            if stack and stack[-1][0] == "head" and not piece.isspace():
                place, link, mute = leave(len(stack) - 1)
            text.append(piece)
            if link:
                linked.append(piece)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag, attrs = m[2].lower(), m[3]
        if m[1]:
            if tag == "br" and not mute:
                text.append(" ")
            depth = max(where[t][-1] for t in HEADINGS) if tag in HEADINGS else where[tag][-1]
            if tag == "a":
                link = False
            if depth >= 0 and (tag in TABLE or depth >= max(where[t][-1] for t in WALLS)):
                close()
                place, link, mute = leave(depth)
            elif tag == "p":
                close()
            continue
        if stack and stack[-1][0] == "head" and tag not in IN_HEAD:
            close()
            place, link, mute = leave(len(stack) - 1)
        if tag == "head":
            if not stack or stack[-1][0] == "html":
                close()
                push(tag)
                place = CHROME
            continue
        if tag in RAW:  # what it holds isn't markup: go to its end tag
            end = re.compile(rf"</{tag}(?=[ \t\n\f\r/>])[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else size
            continue
        if tag in SILENT:
            if tag not in FOREIGN or not _ends_itself(attrs):
                push(tag)
                mute = True
            continue
        if tag in BLOCKS:
            close()
        elif tag == "br" and not mute:
            text.append(" ")
        if tag == "a":
            link = True
        if tag in VOID:
            continue
        inside = _place(tag, attrs, place)
        if tag in BLOCKS:
            before = len(stack)
            if tag in ENDS:
                ended, wall = ENDS[tag][0], max(where[t][-1] for t in ENDS[tag][1])
                while (depth := max(where[t][-1] for t in ended)) > wall:
                    place, link, mute = leave(depth)
            elif tag in ITEMS:
                if stack and (depth := stack[-1][4]) >= 0 and stack[depth][0] in ITEMS[tag]:
                    place, link, mute = leave(depth)
            elif tag == "option" and stack and stack[-1][0] == tag:
                place, link, mute = leave(before - 1)
            if tag not in IN_PARAGRAPH and (depth := where["p"][-1]) > max(where[t][-1] for t in (*WALLS, "button")):
                place, link, mute = leave(depth)
            if len(stack) < before:
                inside = _place(tag, attrs, place)
            push(tag)
            place = inside
        elif inside != place:
            if inside == MAIN:
                close()
            push(tag)
            mute = mute or inside != MAIN
            place = inside
    mute = False
    close()
    return out


FEATURES = ("rivals", "main", "heading", "words", "density", "prev_words", "prev_density", "next_words", "next_density")
#: Pages drawn by made_page() that stand beside PAGES in the labelled table, the draw's seed, and rows a leaf has at least.
MADE, SEED, LEAF = 900, 5, 2
#: The labelled pages: ``{n}`` stands for n words, ``{+n}`` for n words of main text, ``[...]`` for a link.
PAGES = (
    "<nav><ul><li>[{1}]<li>[{2}]<li>[{1}]</ul></nav><div class=ad>{7}</div><article><h1>{+8}</h1><p>{+60}<p>{+2}<p>{+110}</article><footer>{12}</footer>",
    "<header><p>{3}</p><nav>[{1}] [{1}]</nav></header><main><h1>{+9}</h1><p>{+45} [{+3}] {+20}<ul><li>[{+2}]<li>[{+3}]</ul><p>{+80}</main><aside><h3>{2}</h3><p>{40}</p><ul><li>[{6}]<li>[{7}]</ul></aside><footer>{25}</footer>",
    "<div>[{1}] [{1}] [{2}]</div><h1>{+7}</h1><p>{+55}</p><p>{+70} [{+2}]</p><p>{+8}</p><p>{+90}</p><div>[{1}] [{2}] [{1}] {1}</div><div>{3} [{1}]</div>",
    "<table><tr><td>[{1}]<tr><td>[{2}]<tr><td>[{2}]</table><table><tr><td><p>{+40}<p>{+100}<p>{+25} [{+4}]</table><p>{4} [{2}] [{2}]",
    "<div class=notice><p>{30}</p></div><article><p>{+30}</p><p>[{+6}]</p><p>{+50}</p><aside><p>{35}</p></aside><p>{+1}</p></article><section id=comments><h2>{2}</h2><div><p>{45}</p><p>{60}</p></div></section>",
    "<p>{9}</p><article><h1>{+5}</h1><p>{+70}</p><p>{+65}</p></article><p>{30}</p><div>{14}</div>",
    "<div><h2>{3}</h2><p>{20}</p></div><main><p>{+100}</p><p>{+30}</p><p>{+150}</p></main><div><p>{50}</p></div>",
    "<article class=teaser><h3>[{5}]</h3><p>{12}</p></article><h1>{+6}</h1><p>{+80}</p><p>{+120}</p><p>{+7}</p><p>{+60}</p>",
    "<div>[{1}] [{1}]</div><div><h1>{+10}</h1><div>{+35}<br>{+30}</div><div>{+45}</div></div><form>{6}<p>{15}</p></form><div class=comments><p>{80}</p><p>{25}</p></div>",
    "<article><h1>{+3}</h1><p>{+15}</p></article><footer><p>{60}</p><p>{8}</p></footer>",
    "<article><p>{+200}</p></article><div id=sidebar><p>{90}</p><p>[{8}]</p></div><div class=related><p>[{9}]<p>[{11}]</div>",
    "<ul><li>[{2}]</li><li>[{3}]</li></ul><p>{+25}</p><p>{+18}</p><p>{+40}</p><ul><li>{+12}</li><li>{+9}</li><li>{+14}</li></ul><p>{+30}</p><p>{5} [{3}] [{2}]</p>",
    "<form><div>[{1}] [{1}]</div><article><p>{+50}</p><p>{+60}</p></article><div>{6}</div></form>",
    "<p>{+12}</p>",
    "<p>{+150}</p>",
    "<h1>{+6}</h1><p>{+28}</p>",
    "<p>[{2}]</p><p>[{1}]</p>",
    "<nav>{30}</nav><footer>{50}</footer>",
    "<article><p>[{+1}]</p><p>{+12} [{+12}]</p><p>{+12}</p></article><div class=cookie-consent><p>{70}</p></div>",
    "<div class=newsletter><p>{24}</p></div><p>{+48}</p><p>{+52}</p><div class=share>[{1}] [{1}]</div>",
    "<header><h1>{5}</h1></header><div><p>{+75}</p><blockquote><p>{+20}</p></blockquote><p>{+33}</p></div><aside>{80}</aside>",
    "<div>{2} [{2}] [{2}] [{3}]</div><div>{+60}</div><div>{4} [{2}]</div>",
)


def made_page(rng: random.Random) -> str:
    """A labelled page in the notation of PAGES: furniture, named or not, round main text whose container says so, says
    nothing, is a form, or bears a name of furniture."""
    pick, n = rng.choice, rng.randint
    links = lambda: " ".join(f"[{{{n(1, 3)}}}]" for _ in range(n(3, 7)))
    rows = lambda: "<ul>" + "".join(f"<li>[{{{n(1, 9)}}}]</li>" for _ in range(n(2, 7))) + "</ul>"
    long = lambda: f"<p>{{{n(20, 90)}}}</p>" * n(1, 2)
    said = pick(["sidebar", "widget", "site-footer", "comments", "cookieBanner", "newsletter-signup", "related-posts", "promo", "share-buttons", "login-box", "notice"])
    named = lambda body: f"<div {pick(['class', 'id'])}={said}>{body()}</div>"
    line = lambda: pick([f"<div>{{{n(5, 16)}}}</div>", f"<p>{{{n(5, 14)}}}</p>", f"<div>{{{n(2, 6)}}} [{{{n(1, 3)}}}] [{{{n(1, 3)}}}]</div>"])
    above = lambda: pick([f"<nav>{rows()}</nav>", f"<header><p>{{{n(2, 20)}}}</p></header>", f"<div>{links()}</div>", rows(), line(), line(), named(long), named(rows), "", "", "", ""])
    below = lambda: pick([f"<footer>{{{n(4, 40)}}}</footer>", f"<aside>{long()}</aside>", f"<div>{links()}</div>", rows(), line(), line(), line(), named(long), named(rows), "", "", "", ""])

    def part() -> str:
        kind = rng.random()
        if kind < 0.68:
            return f"<p>{{+{n(18, 150)}}}" + (f" [{{+{n(1, 5)}}}] {{+{n(3, 30)}}}" if rng.random() < 0.25 else "") + "</p>"
        if kind < 0.8:
            return f"<{(h := pick(['h2', 'h3']))}>{{+{n(1, 9)}}}</{h}><p>{{+{n(25, 120)}}}</p>"
        if kind < 0.9:
            return f"<p>{{+{n(2, 14)}}}</p><p>{{+{n(25, 120)}}}</p>"
        return "<ul>" + "".join(f"<li>{{+{n(3, 20)}}}</li>" for _ in range(n(2, 5))) + f"</ul><p>{{+{n(25, 90)}}}</p>"

    body = (f"<h1>{{+{n(3, 14)}}}</h1>" if rng.random() < 0.85 else "") + f"<p>{{+{n(20, 120)}}}</p>" + "".join(part() for _ in range(n(0, 5)))
    kind = rng.random()
    if kind < 0.3:
        tag = pick(["article", "main", "div role=main"])
        inner = pick(["", f"<p class=byline>{{+{n(2, 5)}}}</p>", f"<div class=tags>{{+{n(2, 5)}}}</div>", f"<p>[{{+{n(2, 7)}}}]</p>", f"<p>{{+{n(1, 8)}}}</p>"])
        inner += "".join(pick([f"<p>{{+{n(1, 15)}}}</p>", f"<p>[{{+{n(1, 9)}}}]</p>", f"<li>{{+{n(1, 6)}}} [{{+{n(1, 4)}}}]</li>", f"<h3>{{+{n(1, 6)}}}</h3>"]) for _ in range(n(0, 12)))
        body = pick([body, body, ""]) or f"<p>{{+{n(1, 12)}}}</p>"
        beside = pick(["", f"<aside>{long()}</aside>", named(long), f"<form>{{{n(2, 9)}}}<p>{{{n(5, 30)}}}</p></form>"])
        return f"{above()}{above()}<{tag}>{body}{inner}{beside}</{tag.split()[0]}>{below()}{pick([below(), below(), '', long()])}"
    wrapped = f"<div{pick(['', '', ' class=page', ' class=social-science', ' id=related-work', ' class=share-price', ' class=post-tags-news'])}>{body}</div>"
    if kind < 0.6:
        return f"{above()}{above()}{wrapped}{pick(['', f'<form>{{{n(2, 9)}}}<p>{{{n(5, 40)}}}</p></form>'])}{below()}{below()}"
    if kind < 0.75:  # a whole page in a form
        chrome = pick([f"<nav>{rows()}</nav>", f"<div>{links()}</div>", ""])
        return f"<form{pick(['', ' id=form1', ' id=aspnetForm'])}>{chrome}{wrapped}{pick([line(), f'<footer>{{{n(4, 30)}}}</footer>', ''])}</form>"
    if kind < 0.92:  # main text where a name says otherwise, and no other
        said = pick(["widget", "sidebar", "related", "social", "promo", "notice", "banner", "site-header", "share", "tags"])
        return f"{pick([f'<nav>{rows()}</nav>', f'<div>{links()}</div>', ''])}<div {pick(['class', 'id'])}={said}>{body}{pick([line(), rows(), ''])}</div>{pick([f'<footer>{{{n(4, 30)}}}</footer>', rows(), ''])}"
    return f"{pick([rows(), line(), named(rows)])}<form>{{{n(1, 4)}}}<p>{{{n(2, 12)}}}</p></form>{pick([line(), f'<footer>{{{n(4, 30)}}}</footer>'])}"


def grow(x: np.ndarray, y: np.ndarray, depth: int = 20, least: int = LEAF):
    """A CART by Gini: (feature, threshold, left, right) or a leaf's verdict. Ties go to the first feature and threshold."""
    verdict = bool(y.mean() >= 0.5)
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return verdict
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, hits = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(v))
        cost = hits[:-1] * (1 - hits[:-1] / n) + (hits[-1] - hits[:-1]) * (1 - (hits[-1] - hits[:-1]) / (len(v) - n))
        cost[(v[1:] == v[:-1]) | (n < least) | (len(v) - n < least)] = np.inf
        k = int(cost.argmin())
        if np.isfinite(cost[k]) and (best is None or cost[k] < best[0] - 1e-9):
            best = cost[k], f, float((v[k] + v[k + 1]) / 2)
    if best is None:
        return verdict
    _, f, t = best
    left = x[:, f] <= t
    a, b = grow(x[left], y[left], depth - 1, least), grow(x[~left], y[~left], depth - 1, least)
    return a if isinstance(a, bool) and a is b else (f, t, a, b)


def labelled(pages=None) -> tuple[np.ndarray, np.ndarray]:
    """The labelled table: a row of features for each block of the pages, and whether it is main text."""
    rng = random.Random(SEED)
    x, y = [], []
    for page in [*PAGES, *(made_page(rng) for _ in range(MADE))] if pages is None else pages:
        page = re.sub(r"\{(\+?)(\d+)\}", lambda m: " ".join(["main" if m[1] else "other"] * int(m[2])), page)
        found = blocks(page.replace("[", "<a>").replace("]", "</a>"))
        x += features(found)
        y += ["main" in b.text for b in found]
    return np.array(x, float), np.array(y, float)


@cache
def tree():
    return grow(*labelled())


def features(all_blocks: list[Block]) -> list[list[float]]:
    """A row of FEATURES for each block of a page. Rivals: the share of the text, up to where the block stands, in better places:
    for open text that in articles, for text in forms or under names of furniture all that is open; always 1 in chrome."""
    total = [sum(b.words for b in all_blocks if b.place == p) for p in (MAIN, UNKNOWN, NOT_MAIN, FORM)]
    opened = sum(total[:2]) / max(1, sum(total))
    rivals = {MAIN: 0.0, UNKNOWN: total[0] / max(1, sum(total[:2])), NOT_MAIN: opened, FORM: opened, CHROME: 1.0}
    near = [(0, 0.0), *((b.words, b.density) for b in all_blocks), (0, 0.0)]
    return [[rivals[b.place], float(b.place == MAIN), float(b.heading), b.words, b.density, *near[i], *near[i + 2]] for i, b in enumerate(all_blocks)]


def main_text(html: str, model=None) -> str:
    model = model or tree()
    all_blocks = blocks(html)
    kept = []
    for b, x in zip(all_blocks, features(all_blocks), strict=True):
        node = model
        while not isinstance(node, bool):
            node = node[2] if x[node[0]] <= node[1] else node[3]
        if node:
            kept.append(b.text)
    return "\n\n".join(kept)


def extract(pages: list[bytes]) -> dict:
    texts = [main_text(p.decode("utf-8", "replace")) for p in pages]
    return {"text": texts, "n_chars": [len(t) for t in texts]}


def extract_html(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page. Null, empty or text-free html gives an empty text.

    Rows are independent: repeated ids or rows give a result each; null ids and urls stay null. A page of any length
    or depth is read whole, in time linear in its length. An empty table gives an empty result. No shuffle.
    """
    return map_texts(pick(pages, page_id=id_col, url=url_col, text=html_col), lambda: extract, "text string, n_chars long").select("page_id", "url", "text", "n_chars")
