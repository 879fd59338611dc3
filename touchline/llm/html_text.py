"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags; scripts, styles, controls of forms
and the like are no text.  Two passes decide every block.  Markup is evidence in
both: ``article`` and ``main`` speak for a block; menus, headers, footers,
sidebars, notices, adverts, forms, teasers and reader comments, by element or by
names in class, id and role, speak against it.  An ``article`` or ``main`` inside
a wrapper whose names only suggest boilerplate (``has-sidebar``) lifts them.

1. by link density, length and stop-word density a block is good, bad, or
   ambiguous (short, or of middling length or density).  Within ``article`` and
   ``main`` more links are usual and a lack of stop words alone makes no block
   bad; on a page almost without stop words they aren't asked.  Within marked
   elements fewer links are borne, and a block is good only at LONG_MARKED
   characters, or not at all where an element or a list of comments or teasers
   marks it.  On a page without a good block, unmarked ones of middling length and
   high density are good.
2. an ambiguous block takes the label of its nearest decided neighbours, counted
   in blocks: of two that differ, the nearer, and the good one at equal distance;
   a heading asks the next one first.  The edge of an ``article`` or ``main``
   with a good block is a neighbour too, EDGE blocks off: good to blocks inside,
   bad to those outside.  So is the edge of a marked element without a good
   block, MARK blocks off: bad to blocks inside; blocks outside don't see what is
   in it.  With no decided neighbour a block is content.

Work grows with the page: tags are looked for once, a quote that never closes
ends quoting for the rest of a page, and open elements carry what their children
need.

Semantics for odd input: null or empty html, and pages without content, give an
empty text; comments, scripts, styles and the like never count; an unclosed
element lasts to the end of its parent; a tag without an end is text; repeated
rows give a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML element names by role.
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that end with what they lie in, or at the next of their kind.
INLINE = frozenset("p span".split())
CONTAINER = frozenset("address article aside blockquote center details dialog div dl fieldset figure footer form header hgroup main menu nav ol section span table tbody td tfoot th thead tr ul p li".split())
SKIP = frozenset("script style noscript template iframe svg math select textarea button object canvas audio video head title".split())
BOILER = frozenset("nav footer aside form menu dialog".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Names in class, id and role that mark boilerplate.
MARKS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert newsletter subscribe subscription popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead comment comments commentlist disqus discussion replies related recommended share sharing social widget toolbar pagination pager login signup search complementary contentinfo".split())
#: Marks that an article inside does not lift: comments and teasers are often articles themselves.
LISTS = frozenset("comment comments commentlist disqus discussion replies related recommended".split())
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a about after all also an and are as at be been but by can could do for from had has have he her his i if in into is it its more no not of on one or our she so some than that the their them then there these they this to up was we were what when which who will with would you your "
    "aber als am an auch auf aus bei bis da das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im in ist ja mit nach nicht noch nur oder sein sich sie sind so über um und von vor war was wenn wer wie wir wird zu zum zur "
    "au aux avec ce ces cette comme dans de des du elle en est et eux il ils je la le les leur lui mais ne nous on ou où par pas plus pour qu que qui sa se ses son sont sur tout un une vous "
    "al como con de del desde donde el ella ellos en entre era es esta este fue ha hay la las le lo los más me mi muy no nos o para pero por que se ser si sin sobre su sus también un una y ya".split()
)

_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in SKIP}
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Rules:
    """Thresholds of the passes."""

    max_link: float = 0.33
    max_link_inside: float = 0.75
    max_link_marked: float = 0.2
    short: int = 70
    long: int = 200
    long_marked: int = 1600
    stop_low: float = 0.08
    stop_high: float = 0.18
    stop_none: float = 0.02
    edge: int = 3
    mark: int = 1


@dataclass
class Block:
    text: str
    linked: int
    heading: bool
    inside: int | None  # number of the outermost article or main element it lies in
    mark: int | None  # number of the outermost element around it that marks it as boilerplate
    strong: bool  # marked by an element's kind or a list of comments or teasers, not by a name alone


def _marked(attributes: str, names: frozenset[str] = MARKS) -> bool:
    if "=" not in attributes:
        return False
    for found in _NAMES.finditer(attributes):
        value = (found[1] or found[2] or found[3] or "").lower()
        if not names.isdisjoint(_SPLIT.split(value)):
            return True
    return False


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(first, past last, whether it closes, name, attributes) of each tag; comments and declarations have an empty name.

    After a tag the caller may send where to go on.
    """
    at, quoted = 0, True
    while True:
        first = page.find("<", at)
        if first < 0 or page.find(">", first) < 0:
            if first >= 0 and page.startswith("<!--", first):
                yield first, len(page), False, "", ""
            return
        if page.startswith("<!--", first):
            end = page.find("-->", first + 4)
            at = len(page) if end < 0 else end + 3
            yield first, at, False, "", ""
            continue
        found = _OPEN.match(page, first)
        if not found:
            if page[first + 1] in "!?":
                at = page.find(">", first) + 1
                yield first, at, False, "", ""
            else:
                at = first + 1
            continue
        end = found.end()
        while True:
            stop = _STOP.search(page, end) if quoted else None
            if stop is None or stop[0] == ">":
                end = stop.start() if stop else page.find(">", found.end())
                break
            close = page.find(stop[0], stop.end())
            if close < 0:
                quoted = False
            end = close + 1
        to = yield first, end + 1, bool(found[1]), found[2].lower(), page[found.end() : end]
        at = end + 1
        if to is not None:
            at = to
            yield first, at, False, "", ""  # what send gives back


@dataclass
class _Open:
    """An open element: what its children take from it, and the inline elements open in it."""

    name: str
    inside: int | None
    mark: int | None
    strong: bool
    weak: bool


def cut_blocks(page: str) -> list[Block]:
    """The non-empty blocks of a page in order."""
    blocks: list[Block] = []
    pieces: list[str] = []
    root = _Open("", None, None, False, False)
    stack = [root]
    open_ = Counter()  # containers by name
    inline: list[Counter] = [Counter()]  # inline elements by name, within each open container
    articles = marks = 0
    linked, in_link, heading = 0, False, False

    def flush() -> None:
        nonlocal pieces, linked, heading
        text = " ".join(_html.unescape("".join(pieces)).split())
        if text:
            blocks.append(Block(text, linked, heading, top.inside, top.mark, top.strong))
        pieces, linked, heading = [], 0, False

    def pop() -> str:
        name = stack.pop().name
        if name in INLINE:
            inline[-1][name] -= 1
        else:
            open_[name] -= 1
            inline.pop()
        return name

    def text_until(end: int) -> None:
        nonlocal linked
        if end > at:
            run = page[at:end]
            pieces.append(run)
            if in_link:
                linked += len(" ".join(_html.unescape(run).split()))

    top, at = root, 0
    unended: set[str] = set()
    found = tags(page)
    for first, past, closing, name, attributes in found:
        text_until(first)
        at = past
        if not name:
            continue
        if name in SKIP:
            if not closing and not attributes.endswith("/"):
                end = _END[name].search(page, at) if name not in unended else None
                if end is None:
                    unended.add(name)
                if end is None and name == "head":
                    continue
                at = end.end() if end else len(page)
                found.send(at)
            pieces.append(" ")
            continue
        if name == "a":
            in_link = not closing
        elif name == "br":
            pieces.append(" ")
        if name in BLOCK:
            flush()
            in_link = in_link and name != "a"
            heading = name in HEADING and not closing
        if name not in CONTAINER:
            continue
        if not closing:
            if attributes.endswith("/"):
                continue
            if name == "p":  # its end may be left out
                while inline[-1]["p"]:
                    pop()
            elif name == "li" and open_["li"]:
                base = len(stack) - 1 - sum(inline[-1].values())
                if stack[base].name == "li":
                    while pop() != "li":
                        pass
            above = stack[-1]
            own = name in ("article", "main")
            named = not own and _marked(attributes)
            strong = above.strong or name in BOILER or (name == "header" and above.inside is None) or (named and _marked(attributes, LISTS))
            weak = not own and (above.weak or named)
            mark = None
            if strong or weak:
                mark, marks = (marks, marks + 1) if above.mark is None else (above.mark, marks)
            inside = articles if own and above.inside is None else above.inside
            articles += own
            stack.append(_Open(name, inside, mark, strong, weak))
            if name in INLINE:
                inline[-1][name] += 1
            else:
                open_[name] += 1
                inline.append(Counter())
        elif name in INLINE:
            if inline[-1][name]:
                while pop() != name:
                    pass
        elif name == "li":
            if open_["li"] and stack[len(stack) - 1 - sum(inline[-1].values())].name == "li":
                while pop() != "li":
                    pass
        elif open_[name]:
            while pop() != name:
                pass
        top = stack[-1]
    text_until(len(page))
    flush()
    return blocks


def first_pass(blocks: list[Block], rules: Rules) -> list[bool | None]:
    """Good, bad or ambiguous (None), for each block."""
    density = [_stop_words(b.text) for b in blocks]
    free = [d for d, b in zip(density, blocks, strict=True) if b.mark is None] or density
    asked = sum(d[0] for d in free) >= rules.stop_none * sum(d[1] for d in free)
    out: list[bool | None] = []
    middling = []
    for b, (stops, words) in zip(blocks, density, strict=True):
        n, share = len(b.text), stops / max(1, words)
        marked = b.mark is not None
        most = rules.max_link_marked if marked else rules.max_link if b.inside is None else rules.max_link_inside
        label = None
        if b.linked > most * n:
            label = False
        elif n >= rules.short and not b.heading:
            if share >= rules.stop_high or not asked:
                label = True if n >= (rules.long_marked if marked else rules.long) and not b.strong else None
                if not marked:
                    middling.append(len(out))
            elif share < rules.stop_low and (marked or b.inside is None):
                label = False
        out.append(label)
    if True not in out:
        for i in middling:
            out[i] = True
    return out


def _stop_words(text: str) -> tuple[int, int]:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words), len(words)


def second_pass(blocks: list[Block], label: list[bool | None], rules: Rules) -> list[bool]:
    """Ambiguous blocks take the label of their nearest decided neighbours."""
    edges = {b.inside for b, x in zip(blocks, label, strict=True) if b.inside is not None and x}
    closed = {b.mark for b in blocks} - {b.mark for b, x in zip(blocks, label, strict=True) if x} - {None}
    before = _nearest(blocks, label, edges, closed, rules)
    after = _nearest(blocks[::-1], label[::-1], edges, closed, rules)[::-1]
    out = []
    for b, x, low, high in zip(blocks, label, before, after, strict=True):
        if x is None:
            if b.heading and high is not None:
                x = high[1]
            else:
                x = min(((d, not good) for d, good in filter(None, (low, high))), default=(0, False))[1] is False
        out.append(x)
    return out


def _nearest(blocks: list[Block], label: list[bool | None], edges: set[int], closed: set[int], rules: Rules) -> list[tuple[int, bool] | None]:
    """(distance, label) of the nearest decided block or edge passed on the way to each block.

    ``closed``: marked elements without a good block, which are passed over; distances from outside don't count their blocks.
    """
    out: list[tuple[int, bool] | None] = []
    last, outer, inside, at = None, None, None, None
    seen = 0  # blocks so far, without those of closed elements
    for i, (b, x) in enumerate(zip(blocks, label, strict=True)):
        if b.mark in closed:
            if b.mark != at:
                outer = outer if at is not None else last
                last, at = (i - rules.mark, False), b.mark
            out.append((i - last[0], last[1]))
            if x is not None:
                last = (i, x)
            continue
        if at is not None:
            last, at = outer, None
        if b.inside != inside and (b.inside in edges or inside in edges):
            last = (seen - rules.edge, b.inside in edges)  # an edge between this block and the one before it
        inside = b.inside
        out.append(last and (seen - last[0], last[1]))
        if x is not None:
            last = (seen, x)
        seen += 1
    return out


def classify(blocks: list[Block], rules: Rules) -> list[bool]:
    """Content or not, for each block."""
    return second_pass(blocks, first_pass(blocks, rules), rules)


def main_text(page: str | None, rules: Rules | None = None) -> str:
    """The content blocks of a page, joined by newlines."""
    if not page:
        return ""
    blocks = cut_blocks(page)
    return "\n".join(b.text for b, keep in zip(blocks, classify(blocks, rules or Rules()), strict=True) if keep)


def extract(pages: DataFrame, rules: Rules | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(t.as_py(), rules) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
