"""Main text of web pages by the distribution of text over line blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 86

# Element names of HTML and words that name page furniture in class, id and role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5"
    " h6 head header hr html iframe legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td tfoot th"
    " thead title tr ul".split()
)
DROPPED = frozenset(
    "aside button canvas dialog fieldset footer form head header iframe menu nav noscript object search select svg template textarea title".split()
)
WRAPPERS = frozenset(["form", "fieldset"])  # may stand around a whole page
CLOSED = DROPPED - WRAPPERS
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())  # may stand in a head
RAW = frozenset("script style textarea title xmp".split())
CLOSES = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
SCOPES = frozenset("article aside body div footer form header html main nav section table td th ul ol dl button".split())
FURNITURE = frozenset(
    "ad ads adbox adsense advert advertisement adverts alert banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright"
    " disqus dropdown footer login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup"
    " promo promoted promotion recommended related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe"
    " toolbar topbar widget".split()
)
# Words that may follow the furniture word of a name, and words before it that say the name is of something else.
PARTS = frozenset(
    "area articles bar block body bottom box button buttons collapse container content form icons inner items label link links list message panel placeholder"
    " posts section slot slots stories text thread top unit widgets wrap wrapper x".split()
)
LAYOUTS = frozenset("category content has hide hides is no not tag with without".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S
)
FORM = re.compile(r"<(?:form|fieldset)\b", re.I)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article body div html main section".split())  # elements that hold paragraphs
NAME_PARTS = re.compile(r"[^a-z]+")


def names_furniture(token: str) -> bool:
    """Whether a class or id token names furniture: its last word does, apart from words for parts.

    cookie-notice, main-nav and ad-slot-2 do; related-work, share-enabled, no-sidebar and
    content-sidebar-wrap do not.
    """
    words = [w for w in NAME_PARTS.split(token) if w]
    while len(words) > 1 and words[-1] in PARTS and words[-1] not in FURNITURE:
        words.pop()
    return bool(words) and words[-1] in FURNITURE and not LAYOUTS.intersection(words)


def is_comment(attributes: str) -> bool:
    """Whether an article is one comment of a reader."""
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        if key.lower() in ("class", "id") and any(NAME_PARTS.split(t)[0] == "comment" for t in (a or b or c).lower().split()):
            return True
    return False


def is_furniture(name: str, attributes: str, in_article: bool, dropped: frozenset[str] = DROPPED) -> bool:
    """Whether an element holds page furniture and not main text.

    A header inside an article belongs to the article.
    """
    if name in dropped and not (name == "header" and in_article):
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if key in ("class", "id") and any(names_furniture(t) for t in value.split()):
            return True
        if key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def page_lines(html: str, dropped: frozenset[str] = DROPPED) -> list[tuple[str, int]]:
    """(text, weight) of the page's lines, one per block.

    A line weighs its characters outside links. On a page that marks its article,
    lines outside it weigh nothing and lines inside it at least 1.

    Blank lines part what does not belong together: lines with the border of an
    article or furniture between them, if they lie in different containers, and
    lines of neighbouring containers of unlike name or attributes. Lines of one
    article are never parted, nor is a heading from what follows it.

    An article inside an element that is furniture by its attributes, or inside a
    form, opens the text again, unless it is a comment or an article around them
    is open.
    """
    lines: list[tuple[str, int, int]] = []
    held = [0]  # serial numbers of the open containers
    kinds = [("", "")]  # their names and attributes
    parted = last = serial = 0
    lowest, left, entered = 1, None, None  # fewest open containers since the last line, the container closed and opened there
    text: list[str] = []
    linked = 0
    stack: list[str] = []
    dropped_at = articles = links = headings = 0  # depth at which furniture began, open articles, links and headings
    article = last_article = 0  # serial number of the outermost open article
    headed = False  # whether the last line was a heading
    marked = False
    reopened: list[tuple[int, int]] = []  # depth of an article inside furniture, depth at which that began
    gap = [("", 0, 0)] * WINDOW

    def flush() -> None:
        nonlocal linked, parted, last, lowest, left, entered, last_article, headed
        if text:
            line = " ".join("".join(text).split())
            text.clear()
            if line:
                now = article if articles else 0
                unlike = left is not None and len(held) > lowest and left != entered
                together = now == last_article and (now or headed and not parted)
                if not together and (unlike or parted and held[-1] != last):
                    lines.extend(gap)
                parted, last, last_article, headed = 0, held[-1], now, headings > 0
                lowest, left, entered = len(held), None, None
                lines.append((line, max(len(line) - linked, 0), now))
        linked = 0

    def pop(to: int) -> None:
        nonlocal dropped_at, articles, links, headings, parted, lowest, left
        flush()
        while len(stack) > to:
            if reopened and len(stack) == reopened[-1][0]:
                dropped_at = reopened.pop()[1]
            name = stack.pop()
            if name in CONTAINERS:
                held.pop()
                kind = kinds.pop()
                if len(held) < lowest:
                    lowest, left = len(held), kind
            if name in HEADINGS:
                headings -= 1
            if name in ("article", "main"):
                articles -= 1
                parted = 1
            elif name == "a":
                links -= 1
            if dropped_at and len(stack) < dropped_at:
                dropped_at = 0
                parted = 1

    at, end = 0, len(html)
    while at < end:
        found = MARKUP.search(html, at)
        stop = found.start() if found else end
        if stop > at and stack and stack[-1] == "head" and not html[at:stop].isspace():
            pop(len(stack) - 1)
        if stop > at and not dropped_at:
            part = unescape(html[at:stop])
            text.append(part)
            if links:
                linked += len(part.strip())
        if not found:
            break
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        if found[1] or found[4]:  # end tag
            if name in stack:
                place = len(stack) - 1 - stack[::-1].index(name)
                if name in BLOCK or dropped_at:
                    pop(place)
                else:
                    for other in stack[place:]:
                        links -= other == "a"
                    if not any(x in BLOCK for x in stack[place:]):
                        del stack[place:]
                    else:
                        del stack[place]
                        reopened[:] = [(a - (a > place + 1), b - (b > place + 1)) for a, b in reopened]
            elif name in BLOCK:
                flush()
            continue
        if stack and stack[-1] == "head" and name not in HEAD:
            pop(len(stack) - 1)
        elif name == "body" and "head" in stack:
            pop(stack.index("head"))
        if name in RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            at = close.end() if close else end
            if name in ("title", "textarea"):
                flush()
            continue
        if name in VOID:
            if name == "br":
                text.append(" ")
            elif name in BLOCK:
                flush()
            continue
        if name in BLOCK:
            flush()
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth] == "p" or stack[depth] in CLOSES.get(name, ()):
                    pop(depth)
                    break
                if stack[depth] in SCOPES:
                    break
        stack.append(name)
        headings += name in HEADINGS
        if name in CONTAINERS:
            kind = (name, found[3] or found[6] or "")
            if len(held) == lowest:
                entered = kind
            serial += 1
            held.append(serial)
            kinds.append(kind)
        if name in ("article", "main"):
            attributes = found[3] or found[6] or ""
            if dropped_at and not CLOSED.intersection(stack[dropped_at - 1 :]) and "article" not in stack[:-1] and not is_comment(attributes):
                reopened.append((len(stack), dropped_at))
                dropped_at = 0
            if not dropped_at:
                marked = True
                parted = 1
            if not articles:
                article = serial
            articles += 1
        elif name == "a":
            links += 1
        if not dropped_at and is_furniture(name, found[3] or found[6] or "", articles > 0, dropped):
            flush()
            dropped_at = len(stack)
            parted = 1
    flush()
    if marked:
        return [(line, max(weight, 1) if line and inside else 0) for line, weight, inside in lines]
    return [(line, weight) for line, weight, _ in lines]


def line_blocks(weights: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For every line the sum of the weights of ``window`` lines from it on."""
    total = np.concatenate([[0], np.cumsum(np.concatenate([weights, np.zeros(window - 1, dtype=np.int64)]))])
    return total[window:] - total[:-window]


def kept_lines(blocks: np.ndarray, surge: int = SURGE) -> np.ndarray:
    """Positions of the lines between surge and dive points of the line-block distribution.

    A run of blocks with text begins where the sum leaves zero and dives where it
    is zero again. A run counts if its sum surges to ``surge`` somewhere, or to
    the page's highest sum if no run reaches that. All its lines are kept.
    """
    if not blocks.any():
        return np.zeros(0, dtype=np.int64)
    least = min(surge, int(blocks.max()))
    live = np.concatenate([[0], (blocks > 0).astype(np.int8), [0]])
    begins, dives = np.flatnonzero(np.diff(live) == 1), np.flatnonzero(np.diff(live) == -1)
    peaks = np.maximum.reduceat(blocks, begins)  # blocks between runs are zero
    return np.concatenate([np.arange(a, b) for a, b, peak in zip(begins, dives, peaks) if peak >= least])


def main_text(html: str, surge: int = SURGE, window: int = WINDOW) -> str:
    """The lines that the line-block distribution keeps, joined by blank lines.

    Markup only weighs lines and parts them; marked or not, surge and dive
    points choose the text. Forms count as text if nothing outside them surges
    and something inside them does (or there is no text outside).
    """
    def measured(dropped: frozenset[str]) -> tuple[list[str], np.ndarray]:
        lines = page_lines(html, dropped)
        return [line for line, _ in lines], line_blocks(np.array([w for _, w in lines], dtype=np.int64), window)

    lines, blocks = measured(DROPPED)
    peak = blocks.max(initial=0)
    if peak < surge and FORM.search(html):
        whole, inside = measured(CLOSED)
        if peak == 0 or inside.max(initial=0) >= surge:
            lines, blocks = whole, inside
    return "\n\n".join(lines[i] for i in kept_lines(blocks, surge) if lines[i])


def extract_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without ``html_col``, with ``text`` and its length ``n_chars`` in code points.

    Markup, scripts, styles and page furniture (by element, role, class or id) are
    stripped; every block element is a line, and line-block distribution picks the
    main text. Where the page marks its article, only lines inside it have weight
    and they stay together; of several articles those without a surge go, unless
    none has one. Character references are decoded and white space inside a line
    becomes one space.

    Null, empty or text-free pages give an empty text; broken markup is read as
    far as it goes; repeated rows are extracted alike; an empty table gives no
    rows. Columns of ``pages`` called text or n_chars are replaced.
    """

    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield pa.array([main_text(h) if h else "" for h in pages.to_pylist()], pa.string())

    main = F.arrow_udf(extract, "string")
    return pages.withColumn("text", main(F.col(html_col))).drop(html_col).withColumn("n_chars", F.length("text").cast("long"))
