"""The two-pass block rules against a slow plain version, on all pages of the second smallest tables."""

from __future__ import annotations

import html.parser
import re
import time
from collections import Counter

import pyarrow.parquet as pq
import pytest

from touchline.llm import html_text
from touchline.llm.html_text import STOP_WORDS, Rules

PAGES = "/root/testdata/sf0.01/pages.parquet"
RULES = Rules()


class PlainCutter(html.parser.HTMLParser):
    """Blocks of pages that use the tags of the test tables only."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.open, self.text, self.articles, self.marks = [], [], "", 0, 0
        self.linked = 0

    def flush(self):
        text = " ".join(self.text.split())
        if text:
            self.blocks.append({
                "text": text, "linked": self.linked, "heading": any(t == "h1" for t, *_ in self.open),
                "mark": next((m for _, m, _ in self.open if m), None), "strong": any(t in ("nav", "footer") for t, *_ in self.open), "inside": next((n for t, _, n in self.open if t == "article"), None),
            })
        self.text, self.linked = "", 0

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.text += " "
        if tag in ("p", "h1", "div", "article", "nav", "ul", "li", "footer", "body"):
            self.flush()
            if tag == "p" and self.open and self.open[-1][0] == "p":
                self.open.pop()
        if tag in ("meta", "br", "b"):
            return
        self.articles += tag == "article"
        self.marks += 1
        self.open.append((tag, self.marks if tag in ("nav", "footer") or ("class", "ad") in attrs else None, self.articles if tag == "article" else None))

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "div", "article", "nav", "ul", "li", "footer", "body"):
            self.flush()
        while any(t == tag for t, *_ in self.open):
            if self.open.pop()[0] == tag:
                break

    def handle_data(self, data):
        names = [t for t, *_ in self.open]
        if not {"script", "style", "title"} & set(names):
            self.text += data
            if "a" in names:
                self.linked += len(" ".join(data.split()))


def plain_blocks(page):
    cutter = PlainCutter()
    cutter.feed(page)
    cutter.close()
    cutter.flush()
    return cutter.blocks


def stops_of(text):
    found = re.findall(r"[^\W\d_]+", text.lower())
    return len([w for w in found if w in STOP_WORDS]), len(found)


def plain_rules(blocks):
    """(labels of the first pass, labels of both)."""
    free = [b for b in blocks if not b["mark"]] or blocks
    stops, words = (sum(stops_of(b["text"])[k] for b in free) for k in (0, 1))
    asked = stops >= RULES.stop_none * words
    first, middling = [], []
    for b in blocks:
        n, (s, w) = len(b["text"]), stops_of(b["text"])
        inside, marked, dense = b["inside"] is not None, b["mark"] is not None, s / max(1, w) >= RULES.stop_high or not asked
        if b["linked"] > (RULES.max_link_marked if marked else RULES.max_link_inside if inside else RULES.max_link) * n:
            first.append("bad")
        elif n < RULES.short or b["heading"]:
            first.append("ambiguous")
        elif dense:
            if not marked:
                middling.append(len(first))
            first.append("good" if n >= (RULES.long_marked if marked else RULES.long) and not b["strong"] else "ambiguous")
        else:
            first.append("bad" if (marked or not inside) and s / max(1, w) < RULES.stop_low else "ambiguous")
    if "good" not in first:
        first = ["good" if i in middling else x for i, x in enumerate(first)]
    with_good = {b["mark"] for b, x in zip(blocks, first, strict=True) if x == "good"}
    holds = {b["inside"] for b, x in zip(blocks, first, strict=True) if x == "good"} - {None}
    outside = [i for i, b in enumerate(blocks) if b["mark"] is None or b["mark"] in with_good]
    both = list(first)
    for i, x in enumerate(first):
        if x != "ambiguous":
            continue
        closed = i not in outside
        seen = []  # (distance, 0 good or 1 bad, direction)
        for step in (-1, 1):
            path = [j for j in (range(i + 1, len(blocks)) if step > 0 else range(i - 1, -1, -1)) if closed or j in outside]
            nearer = i
            for distance, j in enumerate([*path, None], 1):
                if closed and (j is None or blocks[j]["mark"] != blocks[i]["mark"]):
                    seen.append((distance - 1 + RULES.mark, 1, step))
                    break
                if j is None:
                    break
                if not closed and blocks[j]["inside"] != blocks[nearer]["inside"] and holds & {blocks[j]["inside"], blocks[nearer]["inside"]}:
                    seen.append((distance - 1 + RULES.edge, 0 if blocks[nearer]["inside"] in holds else 1, step))
                    break
                if first[j] != "ambiguous":
                    seen.append((distance, 0 if first[j] == "good" else 1, step))
                    break
                nearer = j
        after = [s for s in seen if s[2] == 1]
        both[i] = ("good", "bad")[(after if blocks[i]["heading"] and after else sorted(seen) or [(0, 0)])[0][1]]
    return first, both


def as_plain(blocks):
    return [{"text": b.text, "linked": b.linked, "heading": b.heading, "inside": b.inside, "mark": None if b.mark is None else b.mark + 1, "strong": b.strong} for b in blocks]


NAMES = {"good": True, "bad": False, "ambiguous": None}


def test_rules_equal_the_plain_version_on_all_pages():
    pages = pq.read_table(PAGES, columns=["html"])["html"].to_pylist()
    decided = Counter()
    for page in pages:
        blocks = html_text.cut_blocks(page)
        plain = plain_blocks(page)
        assert [(b.text, b.linked, b.mark is None, b.strong, b.inside is None) for b in blocks] == [(b["text"], b["linked"], b["mark"] is None, b["strong"], b["inside"] is None) for b in plain]
        first, both = plain_rules(plain)
        own = html_text.first_pass(blocks, RULES)
        assert own == [NAMES[x] for x in first]
        assert html_text.second_pass(blocks, own, RULES) == [NAMES[x] for x in both]
        assert html_text.main_text(page) == "\n".join(b["text"] for b, x in zip(plain, both, strict=True) if x == "good")
        decided.update((2 if x == "ambiguous" else 1, y) for x, y in zip(first, both, strict=True))
    # each pass keeps and drops many: no block is settled before them
    assert all(decided[k, label] > 400 for k in (1, 2) for label in ("good", "bad")), decided


def test_markup_is_evidence_only():
    page = f"<p>{GOOD}</p><div class='ad'>The ad of the day is in it and for you.</div><p>{GOOD}</p>"
    assert html_text.main_text(page).split("\n") == [GOOD.strip()] * 2
    assert html_text.main_text(page.replace(" class='ad'", "")).count("\n") == 2  # by its text alone it is like its neighbours
    assert html_text.main_text(f"<div class='sidebar'><p>{GOOD * 6}</p><p>near</p></div>").split("\n") == [(GOOD * 6).strip(), "near"]  # long prose outweighs a name
    assert html_text.main_text(f"<div class='sidebar'><p>{GOOD}</p></div><p>{GOOD}</p>").split("\n") == [GOOD.strip()]
    assert html_text.main_text(f"<article><p>{GOOD}</p><div class='comments'><p>{GOOD * 6}</p></div><p>last</p></article>").split("\n") == [GOOD.strip(), "last"]


@pytest.mark.parametrize("piece", ["<a ", "<div>", '<div class="ad">x', "<p><div>", '<a "', "<script>", "<a '>\"", "</div>", "<li><p>", "<!-- ", "<style x"])
def test_odd_pages_take_time_in_proportion(piece):
    def took(n):
        began = time.perf_counter()
        html_text.main_text(piece * n + "</p></li></span>" * n + ">")
        return time.perf_counter() - began

    assert took(32_000) < 14 * max(took(4_000), 0.02)


GOOD = "The men of the team were in the field and that is what they had to do for all of us. " * 4
BAD = "<p><a href=1>all of it is a link and so it is long enough to be judged for itself</a></p>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<p>{GOOD}</p><p>near good</p><p>x</p><p>near bad</p>{BAD}", ["near good", "x"]),  # x is as near to either
        (f"{BAD}<h2>Head</h2><p>{GOOD}</p>", ["Head"]),
        (f"<p>out</p><article><p>in</p><p>{GOOD}</p></article><p>out</p>", ["in"]),
        (f"<article>{BAD}<p>cut off</p>{BAD}</article><p>{GOOD}</p>", []),
        (f"<article><p>{GOOD}</p>{BAD}<p>far</p>{BAD}</article>", []),
        ("<p>only short</p><p>ones</p>", ["only short", "ones"]),
        ("<p>The men of the team were in the field and that is what they had to do.</p><p>one</p>", ["The men of the team were in the field and that is what they had to do.", "one"]),
    ],
)
def test_ambiguous_blocks_take_their_neighbours_label(page, want):
    assert [x for x in html_text.main_text(page).split("\n") if x and x != GOOD.strip()] == want
    first, both = plain_rules(as_plain(html_text.cut_blocks(page)))
    assert html_text.main_text(page) == "\n".join(b.text for b, x in zip(html_text.cut_blocks(page), both, strict=True) if x == "good")


def test_a_very_long_page():
    page = "<article>" + f"<p>{GOOD}</p><p>short</p>" * 5000 + "</article>"
    assert html_text.main_text(page).count("\n") == 9999
