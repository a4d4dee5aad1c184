"""Main text of web pages: flat text blocks, features of each block and its neighbours, and a decision tree.

A page is cut at block-level tags into flat blocks by a scanner that reads it once. Each block has its word count and link
density, those of the blocks before and after it, whether it is a heading and stands in an article or main element, and how
strongly its open elements speak against it: a zone is opened by tags and roles (nav, footer, aside, form ...), by names of
classes and ids, or by being hidden; 2 for what plainly isn't an article's text, 1 for names that may well be (banner, related,
legal ...). Names that say how a page is laid out (with-sidebar, comments-open) open none, and a zone that turns out to hold
the article, main element or first heading of the page is none either. A decision tree (CART) over these features tells text
from the rest; it is grown here, from the labelled blocks of TRAINING, when a worker starts.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import ship

#: Elements of HTML by what they mean to the cutter.
RAW = ("script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes")
UNSEEN = ("noscript", "template", "svg", "math", "object", "select", "button", "canvas", "audio", "video")
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element that a start tag ends without an end tag of its own, and the elements beyond which it doesn't look.
_CELL, _LISTS, _TERMS, _PARTS = ("td", "th"), ("ul", "ol", "menu", "dir"), ("dd", "dt"), ("thead", "tbody", "tfoot")
ENDS = {
    "li": (("li",), _LISTS),
    **dict.fromkeys(_TERMS, (_TERMS, ("dl",))),
    **dict.fromkeys(_CELL, (_CELL, ("tr", "table"))),
    "tr": (("tr",), ("table",)),
    **dict.fromkeys(_PARTS, (_PARTS, ("table",))),
    "option": (("option",), ("select",)),
}
#: How many open elements a start tag looks through for one that it ends.
LOOK = 64
TAG_ZONES = {"nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "side", "form": "form", "fieldset": "form", "dialog": "notice"}
ROLE_ZONES = {"navigation": "nav", "menu": "nav", "menubar": "nav", "banner": "header", "contentinfo": "footer", "complementary": "side", "search": "form", "form": "form", "dialog": "notice", "alertdialog": "notice", "alert": "notice"}
#: Parts of names of classes and ids by the zone they open, first those that plainly aren't an article's, then those that may be.
STRONG = {
    "nav": "nav navbar navigation breadcrumb breadcrumbs pagination pager",
    "header": "masthead topbar header",
    "footer": "footer colophon copyright",
    "side": "sidebar",
    "notice": "ad ads adv advert adverts advertisement adsense sponsored cookie cookies consent gdpr notice notices popup modal paywall alert promo promos",
    "form": "newsletter subscribe subscription signup login searchbox",
    "comments": "comment comments disqus respond",
    "share": "share sharing",
}
WEAK = {
    "nav": "menu menus toc skip",
    "footer": "legal",
    "side": "widget widgets related recommended recommendations trending popular teaser",
    "notice": "banner sponsor overlay",
    "form": "search form",
    "comments": "reply replies discussion responses",
    "share": "social",
}
NAMED = {w: (z, strength) for strength, table in ((1, WEAK), (2, STRONG)) for z, ws in table.items() for w in ws.split()}
#: A name with one of these parts says how something is laid out, as does one that ends in one of the others.
NEGATIONS = frozenset("with has have no not without is".split())
STATES = frozenset("open opened closed enabled disabled layout free article page main content post story entry visible active".split())
OWN = frozenset("post entry article story content".split())

_ATTRS = r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+)"
TAG = re.compile(rf"<(/?)([a-zA-Z][^\s/>]*+){_ATTRS}>")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
CLOSERS = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in (*RAW, *UNSEEN)}
ATTRIBUTE = re.compile(r"""([^\s=>"'/]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""")
TELLING = re.compile(r"class|id|role|style|hidden", re.IGNORECASE)
NAME_PART = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
FEATURES = ("zone", "article", "heading", "words", "density", "words_before", "density_before", "words_after", "density_after")


@dataclass(slots=True)
class Block:
    """A flat block: its text, its words and those of them in links, its zone's strength, in an article or not, a heading or not."""

    text: str
    words: int
    linked: int
    zone: int
    article: bool
    heading: bool


@dataclass(slots=True)
class Zone:
    """An element that speaks against its blocks; ``doubtful`` ones are dropped if they hold the article."""

    kind: str
    strength: int
    parent: Zone | None
    doubtful: bool
    dropped: bool = False


def named_zone(value: str, article: bool) -> tuple[str, int] | None:
    """The zone of a class or id attribute: that of the first of its names that begins or ends with a zone's word, the stronger."""
    for name in value.split():
        parts = [x.lower() for x in NAME_PART.findall(name)]
        if not parts or not NEGATIONS.isdisjoint(parts):
            continue
        ends = [NAMED[x] for x in (parts[-1], *([] if parts[-1] in STATES else parts[:1])) if x in NAMED]
        found = max(ends, key=lambda z: z[1], default=None)
        if found and found[0] == "header" and (article or not OWN.isdisjoint(parts)):
            continue  # an article's own heading
        if found:
            return found
    return None


def zone_of(name: str, attrs: str, article: bool) -> tuple[str, int, bool] | None:
    """(kind, strength, doubtful) of the zone that an element opens, None if it opens none."""
    kind = TAG_ZONES.get(name)
    if kind and not (kind == "header" and article):
        return kind, 2, kind == "form"
    if name in ("html", "body", "main") or not TELLING.search(attrs):
        return None
    found = None
    for m in ATTRIBUTE.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        new = None
        if key == "role":
            new = (k, 2, k == "form") if (k := ROLE_ZONES.get(value.strip().lower())) else None
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and HIDING.search(value):
            new = "notice", 2, True
        elif key in ("class", "id") and (z := named_zone(value, article)):
            new = (*z, True)
        if new and (found is None or new[1] > found[1]):
            found = new
    # an article isn't a zone for its name, unless it is a reader's comment
    return found if name != "article" or found and found[0] == "comments" and found[1] == 2 else None


def blocks(page: str) -> list[Block]:
    """The flat blocks of a page that hold a word, in page order; character references decoded, white space single.

    One pass: a tag that never ends takes the rest of the page or, if there is a ``>``, ends there, and from then on quotes
    aren't looked at; a missing end tag of an unseen element is missed once.
    """
    out: list[tuple[str, int, Zone | None, bool, bool]] = []
    text: list[str] = []
    aside: list[str] = []
    linked = 0
    link = heading = article = False
    open_: list[tuple[str, Zone | None, bool]] = []
    count: Counter[str] = Counter()
    zone: Zone | None = None
    inline: tuple[str, Zone] | None = None
    depth = 0
    articles = headings = 0
    unclosed: set[str] = set()
    tag = TAG

    def add(piece: str) -> None:
        nonlocal linked
        if "&" in piece:
            piece = htmllib.unescape(piece)
        (text if inline is None else aside).append(piece)
        if link and inline is None:
            linked += len(piece.split())

    def close() -> None:
        nonlocal linked, inline, depth
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                out.append((whole, linked, zone, article, heading))
            text.clear()
        if aside:
            whole = " ".join("".join(aside).split())
            if whole:
                out.append((whole, 0, inline[1] if inline else Zone("notice", 2, zone, False), article, False))
            aside.clear()
        linked, inline, depth = 0, None, 0

    def pop(k: int) -> None:
        nonlocal zone, article
        _, zone, article = open_[k]
        count.subtract(x[0] for x in open_[k:])
        del open_[k:]

    def holds_article() -> None:
        z = zone
        while z is not None:
            z.dropped |= z.doubtful
            z = z.parent

    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            add(page[at:lt])
        if lt == end:
            break
        m = tag.match(page, lt)
        if m is None:
            nxt = page[lt + 1 : lt + 2]
            if page.startswith("<!--", lt):
                stop = lt + 5 if page.startswith("<!-->", lt) else page.find("-->", lt + 4) + 3
                at = stop if stop > 2 else end
            elif nxt in ("!", "?", "/") and nxt:
                stop = page.find(">", lt)
                at = stop + 1 if stop >= 0 else end
            elif nxt.isascii() and nxt.isalpha():
                if tag is TAG and page.find(">", lt) >= 0:
                    tag, at = PLAIN_TAG, lt
                else:
                    at = end
            else:
                add("<")
                at = lt + 1
            continue
        at = m.end()
        ending, name, attrs = m[1] == "/", m[2].lower(), m[3]
        if not ending and name in CLOSERS:
            if name not in unclosed:
                stop = CLOSERS[name].search(page, at)
                if stop:
                    at = stop.start()
                elif name in RAW:
                    at = end
                else:
                    unclosed.add(name)
            continue
        if name not in BLOCKS:
            if name == "br":
                (text if inline is None else aside).append(" ")
            elif name == "a":
                link = not ending
            if inline is not None:
                if name == inline[0]:
                    depth += -1 if ending else 1
                    if not depth:
                        inline = None
            elif not ending and name not in VOID and attrs and not attrs.endswith("/"):
                z = zone_of(name, attrs, article)
                if z and z[0] in ("notice", "share") and z[1] == 2:
                    inline, depth = (name, Zone(z[0], 2, zone, False)), 1
            continue
        close()
        heading = not ending and len(name) == 2 and name[0] == "h" and name[1].isdigit()
        if ending:
            if count[name] > 0:
                pop(next(k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == name))
            continue
        if open_ and open_[-1][0] == "p":
            pop(len(open_) - 1)
        ended, bounds = ENDS.get(name, ((), ()))
        if any(count[x] > 0 for x in ended):
            for k in range(len(open_) - 1, max(-1, len(open_) - 1 - LOOK), -1):
                if open_[k][0] in ended:
                    pop(k)
                    break
                if open_[k][0] in bounds:
                    break
        if name in VOID:
            continue
        z = zone_of(name, attrs, article)
        main = name == "main" or 'role="main"' in attrs
        if main or name == "article" and not (z and articles):
            if main or not articles:
                holds_article()
            articles += 1
            z = None
        elif name == "h1":
            if not headings:
                holds_article()
            headings += 1
        if attrs.endswith("/"):
            continue
        open_.append((name, zone, article))
        count[name] += 1
        if main:
            zone = None
        if main or name == "article":
            article = True
        if z:
            zone = Zone(z[0], z[1], zone, z[2])
    close()

    def strength(z: Zone | None) -> int:
        s = 0
        while z is not None and s < 2:
            if not z.dropped:
                s = max(s, z.strength)
            z = z.parent
        return s

    known: dict[int, int] = {}
    return [Block(t, n := len(t.split()), min(k, n), known[id(z)] if id(z) in known else known.setdefault(id(z), strength(z)), a, h) for t, k, z, a, h in out]


def rows(bs: list[Block]) -> list[tuple[float, ...]]:
    """FEATURES of each block; outside the page there are 0 words."""
    w = [0, *(b.words for b in bs), 0]
    d = [0.0, *(b.linked / b.words for b in bs), 0.0]
    return [(float(b.zone), float(b.article), float(b.heading), w[i], d[i], w[i - 1], d[i - 1], w[i + 1], d[i + 1]) for i, b in enumerate(bs, 1)]


#: Labelled blocks: a line is a page; a block is words/linked words, its zone's strength (-, w or s), A in an article, H for a
#: heading, and after the colon 1 for text. Fixed values, labelled by hand.
TRAINING = """
5/5s:0 9/0s:0 11/0-AH:1 62/0-A:1 1/0-A:1 140/0-A:1 85/3-A:1 2/0-A:1 12/0s:0
4/4s:0 3/3s:0 12/0s:0 8/0-AH:1 4/0-A:1 33/0-A:1 250/0-A:1 1/0-A:1 7/0-A:1 16/0s:0
3/0s:0 6/6s:0 14/0-AH:1 5/0-A:1 120/6-A:1 18/0-A:1 54/0s:0 23/0s:0 40/1s:0 10/3s:0
3/3s:0 25/0s:0 9/0-AH:1 77/0-A:1 64/64-A:1 91/2-A:1 6/6s:0 7/7s:0 38/0s:0 4/0s:0 11/0s:0
30/0s:0 2/2s:0 5/0-AH:1 9/0-A:1 16/1-A:1 28/0-A:1 12/12-A:1 3/0s:0 6/0s:0
2/2s:0 22/0s:0 35/1s:0 6/0-AH:1 70/0-A:1 13/2-A:1 2/0-AH:1 41/0-A:1 29/0s:0 60/2s:0
90/0s:0 110/2s:0 75/0s:0 45/0s:0 33/0s:0 52/3s:0 140/80s:0
1/0-AH:1 1/0-A:1 6/1-A:1 2/0-A:1 10/10-A:1 3/3-A:1
8/0-AH:1 26/0wA:1 44/0-A:1 9/0wA:1 60/2wA:1 12/11wA:0 6/6wA:0 31/0-A:1 7/7wA:0 18/16wA:0
5/0-AH:1 80/0wA:1 95/1wA:1 3/0wA:1 70/0wA:1 24/20wA:0 2/2wA:0 2/2wA:0
52/0-A:1 4/0s:0 30/0s:0 48/0-A:1 20/1s:0 66/0-A:1 5/5s:0
2/2-:0 2/2-:0 2/2-:0 6/0-H:1 48/1-:1 95/4-:1 130/0-:1 4/4-:0 5/5-:0 5/5-:0
1/1-:0 1/1-:0 1/1-:0 7/0-H:1 66/2-:1 74/0-:1 31/0-:1 3/3-:0 4/4-:0 6/3-:0
8/8-:0 6/6-:0 10/0-H:1 57/0-:1 44/0-:1 112/3-:1 15/15-:0 12/12-:0 20/16-:0
7/0-:1 88/0-:1 47/0-:1 203/5-:1 19/0-:1
4/4-:0 4/4-:0 3/0-:0 5/5-:0 12/0-H:1 36/0-:1 58/1-:1 26/0-:1 2/0-:1 33/0-:1 2/2-:0 3/3-:0
3/3-:0 2/0-:0 4/4-:0 3/3-:0 9/0-:0 5/5-:0 2/0-:0 6/6-:0
40/0-:1 3/0-:1 52/1-:1 1/0-:1 64/0-:1 2/0-H:1 71/2-:1 8/0-:1 39/0-:1
5/0-H:1 90/0-:1 12/9-:1 85/1-:1 7/7-:1 101/0-:1 20/14-:1 46/0-:1 5/5-:0 4/4-:0
6/6-:0 22/18-:0 7/7-:0 14/0-:0 8/8-:0 3/0-:0 9/9-:0 11/0-:0 6/6-:0
2/0-:1
6/0-:1
1/0-:1
16/0-:1
300/0-:1
3/0-H:1 21/0-:1 3/0-H:1 25/0-:1 2/0-H:1 30/1-:1
4/0-:1 6/0-:1 5/0-:1 7/0-:1 5/0-:1 6/0-:1 4/0-:1 8/0-:1
6/0-H:1 5/0-:1 7/0-:1 6/0-:1 5/0-:1 5/0-:1
1/0-:0 1/1-:0 1/0-:0 2/2-:0 1/0-:0 1/1-:0 2/0-:0 3/3-:0
5/0s:0 18/0w:1 60/0-:1 75/0-:1 9/0w:0 6/6w:0 4/0w:0 8/8w:0 30/28w:0
4/4w:0 5/5w:0 9/0-H:1 23/0w:1 84/0-:1 51/0w:1 70/0-:1 3/0w:0 10/10w:0 2/0w:0 12/0s:0
20/1w:0 3/3w:0 15/0w:0 7/7w:0 9/0w:0 5/5w:0
10/5-:0 12/6-:0 9/5-:0 6/0-H:1 50/0-:1 80/1-:1 14/7-:0 10/6-:0 18/9-:0
8/4-:0 7/0-H:1 90/0-:1 40/1-:1 12/7-:0 11/6-:0 9/4-:0
9/6-:0 16/8-:0 13/9-:0 10/4-:0 21/12-:0 12/7-:0
55/1-:1 13/7-:1 72/0-:1 16/9-:1 61/2-:1 4/0-:1 77/0-:1 18/8-:0 12/5-:0
"""


def training_rows() -> tuple[list[tuple[float, ...]], list[int]]:
    """Features and labels of TRAINING."""
    xs, ys = [], []
    for line in TRAINING.split("\n"):
        page = []
        for item in line.split():
            w, linked, marks, y = re.fullmatch(r"(\d+)/(\d+)([a-zA-Z-]*):([01])", item).groups()
            page.append(Block("", int(w), int(linked), "-ws".index(marks[0]), "A" in marks, "H" in marks))
            ys.append(int(y))
        xs += rows(page)
    return xs, ys


def grow(xs: list[tuple[float, ...]], ys: list[int], depth: int = 7, least: int = 1):
    """A binary decision tree (CART, Gini impurity): a label, or (feature, threshold, tree below or at it, tree above it)."""
    n, ones = len(ys), sum(ys)
    best = None
    if depth and 0 < ones < n:
        for f in range(len(xs[0])):
            order = sorted(range(n), key=lambda i: xs[i][f])
            left = 0
            for k in range(1, n):
                left += ys[order[k - 1]]
                a, b = xs[order[k - 1]][f], xs[order[k]][f]
                if a == b or k < least or n - k < least:
                    continue
                impurity = left * (k - left) / k + (ones - left) * (n - k - ones + left) / (n - k)
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, f, (a + b) / 2)
    if best is None or best[0] >= ones * (n - ones) / n - 1e-12:
        return int(2 * ones >= n)
    _, f, cut = best
    low = [i for i in range(n) if xs[i][f] <= cut]
    high = [i for i in range(n) if xs[i][f] > cut]
    return f, cut, grow([xs[i] for i in low], [ys[i] for i in low], depth - 1, least), grow([xs[i] for i in high], [ys[i] for i in high], depth - 1, least)


def decide(tree, x: tuple[float, ...]) -> int:
    while not isinstance(tree, int):
        f, cut, low, high = tree
        tree = low if x[f] <= cut else high
    return tree


_tree: list = []


def main_text(page: str | None) -> str:
    """The blocks of a page that the tree calls text, joined by one newline."""
    if not _tree:
        _tree.append(grow(*training_rows()))
    bs = blocks(page or "")
    return "\n".join(b.text for b, x in zip(bs, rows(bs), strict=True) if decide(_tree[0], x))


def _extracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        text = [main_text(h) for h in b["html"]]
        yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": text, "n_chars": pd.Series([len(t) for t in text], dtype="int64")})


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row.

    A null or empty page, or one without text, has the empty text. Rows are independent: repeated rows give repeated results,
    other columns are not read, and an empty table gives none.
    """
    ship(pages.sparkSession)
    kind = pages.schema[page_id].dataType.simpleString()
    d = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"))
    return d.mapInPandas(_extracted, f"page_id {kind}, url string, text string, n_chars bigint")
