"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block element.  A line weighs the characters that stand outside links, and
the weights are summed over windows of ``LINES`` lines from each line on.  A window sum above the surge threshold opens a
region, at a line that itself has a window's share of it, and the first window sum below that share, the dive, closes
it.  The threshold is ``SURGE``, or half the page's largest window sum where that is less, so that short pages have a
text as well.  A region grows to the edges of the block that it lies in, so a headline, a short paragraph or a list of
links inside an article stays, and a block in which no window surges is no text.

What the markup says goes in as factors of the weights.  Lines in elements that are, or call themselves, menus,
headers, footers, sidebars, notices, adverts, forms or comments weigh nothing; a name counts when all its parts speak of
such things or of places ("site-footer", not "search-algorithms").  Blocks are the page's article elements, else its
main elements, and lines outside them weigh nothing; without either, the block is the innermost element that holds three
fifths of the weight, or the body itself, and lines outside weigh a quarter.

Defined results: null and empty html, and pages without text that has weight, give the empty text; unclosed and stray
tags and quotes are read as a browser would; equal rows give equal rows; a null page_id or url is passed on.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lumenfold.llm.common import map_batches, prepare, table

LINES, SURGE, OUTSIDE = 3, 120, 0.25
_SKIP = "script|style|noscript|template|svg|math|iframe|object|canvas|textarea|select|title|audio|video"
# what cannot match at its end runs to the end of the page, so no part of a page is tried twice
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<({_SKIP})\b[^>]*+(?:>.*?(?:</\1\s*>|\Z)|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>=]|=(?:\s*+(?:\"[^\"]*+\"|'[^']*+'))?+)*+)(?:>|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?![\w-])(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""", re.I)
_SPACE = re.compile(r"\s+")
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
_CONTAINER = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form header html li main menu nav ol section table ul".split())
_NAMED = frozenset("nav menu footer aside form dialog fieldset head".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
_WORDS = frozenset("nav navbar navigation menu header masthead topbar footer sidebar aside ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login breadcrumb breadcrumbs pagination pager social share sharing comment comments disqus respond reply replies related recommended recommendations widget form search skip".split())
#: What may stand beside these words in a name: "site-footer" is a footer, "search-algorithms" is no search.
_PLACES = frozenset("site page main top bottom left right upper lower box bar block wrapper wrap container holder section area list item items inner outer global primary secondary link links button buttons slot unit zone panel column col row group text content title label header wide fixed sticky mobile desktop small large js l r".split())
#: In a class name these speak of something beside the element: "has-sidebar", "with-ads", "no-banner".
_BESIDE = frozenset("has with without no not".split())
_REMARKS = frozenset("comment comments reply replies respond".split())
_PARTS = re.compile(r"[a-z]+")


def _boilerplate(tag: str, attributes: str, inside_article: bool) -> bool:
    if tag in _NAMED or (tag == "header" and not inside_article):
        return True
    if tag in ("html", "body", "main") or not attributes.strip():
        return False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "role" and value in _ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return True
        if name in ("class", "id"):
            for token in value.split():
                parts = set(_PARTS.findall(token))
                if parts & (_REMARKS if tag == "article" else _WORDS) and not parts & _BESIDE and parts <= _WORDS | _PLACES:
                    return True
    return False


class Line:
    """A text line: its text, the characters outside links, the containers that hold it (number and tag, outermost
    first) and whether the markup names it boilerplate."""

    __slots__ = ("text", "plain", "held", "named")

    def __init__(self, text: str, plain: int, held: tuple[tuple[int, str], ...], named: bool):
        self.text, self.plain, self.held, self.named = text, plain, held, named


def lines(page: str) -> list[Line]:
    out: list[Line] = []
    stack: list[tuple[str, int, bool]] = []  # tag, number, boilerplate
    text: list[str] = []
    link = linked = number = heading = 0
    apart = False  # the paragraph or other small block at hand is named boilerplate

    def close() -> None:
        nonlocal linked
        raw = "".join(text)
        if raw:
            line = _SPACE.sub(" ", entities.unescape(raw)).strip()
            if line:
                named = apart or any(s[2] for s in stack)
                if named and not apart and heading and all(s[0] == "header" for s in stack if s[2]):
                    named = False  # a headline in an article's own header
                share = 1 - linked / len(raw)
                out.append(Line(line, round(len(line) * share), tuple((s[1], s[0]) for s in stack), named))
        text.clear()
        linked = 0

    at = 0
    for m in _TAG.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
            if link:
                linked += m.start() - at
        at = m.end()
        tag = m[3]
        if not tag:
            continue
        tag, closing = tag.lower(), bool(m[2])
        if tag == "a":
            link = 0 if closing else 1
        elif tag in ("br", "td", "th", "img", "input", "wbr"):
            text.append(" ")
        elif tag in _BLOCK:
            close()
            link, apart = 0, not closing and tag not in _CONTAINER and _boilerplate(tag, m[4], False)
            if tag[0] == "h" and tag[1:].isdigit():
                heading = 0 if closing else 1
            elif tag in _CONTAINER:
                if closing:
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == tag:
                            del stack[k:]
                            break
                else:
                    number += 1
                    if tag == "li":  # an item ends where the next one of its list begins
                        for k in range(len(stack) - 1, -1, -1):
                            if stack[k][0] in ("ul", "ol", "menu"):
                                break
                            if stack[k][0] == "li":
                                del stack[k:]
                                break
                    article = any(s[0] == "article" for s in stack)
                    named = _boilerplate(tag, m[4], article) or tag == "header" and article
                    if tag in ("article", "main") and not named:  # no menu or form holds an article: it was left unclosed
                        while any(s[2] for s in stack):
                            stack.pop()
                    stack.append((tag, number, named))
    if at < len(page):
        text.append(page[at:])
    close()
    return out


def weights(found: list[Line]) -> tuple[list[float], list[int]]:
    """What each line weighs: characters outside links, times the markup's prior; and the block that each line is of.

    Blocks are the page's article elements, else its main elements, else the innermost element that holds three fifths
    of the weight, or the body itself; 0 for lines outside."""
    free = [x for x in found if not x.named]
    for tag in ("article", "main"):
        if any(t == tag for x in free for _, t in x.held):
            block = [0 if x.named else max((c for c, t in x.held if t == tag), default=0) for x in found]
            return [x.plain if c else 0 for x, c in zip(found, block, strict=True)], block
    mass: dict[int, int] = {}
    for x in free:
        for c, tag in x.held:
            if tag not in ("html", "body"):
                mass[c] = mass.get(c, 0) + x.plain
    most = 0.6 * sum(x.plain for x in free)
    inner = max((c for c, n in mass.items() if n >= most), default=None)  # later elements lie inside earlier ones

    def main(x: Line) -> bool:
        return any(c == inner for c, _ in x.held) if inner is not None else all(t in ("html", "body") for _, t in x.held)

    block = [0 if x.named or not main(x) else inner or -1 for x in found]
    return [0 if x.named else x.plain * (1 if c else OUTSIDE) for x, c in zip(found, block, strict=True)], block


def regions(weight: list[float], surge: float = SURGE) -> list[tuple[int, int]]:
    """Line ranges [from, to) between surge and dive of the window sums."""
    n = len(weight)
    sums, found, at = [sum(weight[i : i + LINES]) for i in range(n)], [], 0
    least = min(surge, max(sums, default=0) / 2)
    while at < n:
        if sums[at] > least and weight[at] * LINES > least:
            end = at
            while end < n and sums[end] * LINES > least:
                end += 1
            found.append((at, end))
            at = end
        at += 1
    return found


def grown(found: list[tuple[int, int]], block: list[int]) -> list[int]:
    """The lines of regions and of the blocks that regions lie in, in page order."""
    inside = {block[k] for a, b in found for k in range(a, b)} - {0}
    own = {k for a, b in found for k in range(a, b)}
    return [k for k in range(len(block)) if block[k] in inside or k in own]


def main_text(page: str, surge: float = SURGE) -> str:
    """The page's main text: blocks in page order, one a line."""
    found = lines(page)
    weight, block = weights(found)
    return "\n".join(found[k].text for k in grown(regions(weight, surge), block) if not found[k].named and (weight[k] or block[k]))


def extract(pages: DataFrame) -> DataFrame:
    """Per row of pages: page_id, url, text, n_chars."""

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts = [main_text(x or "") for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

        return each

    return map_batches(pages.select("page_id", "url", "html"), make, "page_id bigint, url string, text string, n_chars bigint")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return extract(table(spark, sf_dir, "pages"))
