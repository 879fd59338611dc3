"""Rows from HTML pages: Python table functions, one call a page, for lateral joins."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

PLAYER = re.compile(r"/players/(\d{1,18})")
SEASON = re.compile(r"Season\s+(\d{2})-(\d{2})")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Anchors(HTMLParser):
    """Links whose target begins with a prefix, each with its text and the texts of elements in it by class; and the first text of ``.league-season``.

    A link ends at its end tag or at the next link, as links don't nest.
    """

    def __init__(self, prefix: str):
        super().__init__(convert_charrefs=True)
        self.prefix, self.found, self.season = prefix, [], None
        self.open: list[tuple[str, str]] = []  # elements of the link at hand, or of the season
        self.link: dict | None = None
        self.in_season = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        own = {k: v or "" for k, v in attrs}
        if tag == "a":
            self._end()
            if own.get("href", "").startswith(self.prefix):
                self.link = {"target": own["href"], "text": [], "parts": []}
            return
        if tag in _VOID:
            return
        classes = own.get("class", "").split()
        if self.in_season:
            self.in_season += 1
        elif "league-season" in classes and self.season is None:
            self.season, self.in_season = "", 1
        if self.link is not None:
            self.open.append((tag, classes))
            self.link["parts"].append(([c for _, x in self.open for c in x], classes, []))

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self._end()
            return
        if self.in_season and tag not in _VOID:
            self.in_season -= 1
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self.in_season:
            self.season += data
        if self.link is not None:
            self.link["text"].append(data)
            depth = len(self.open)
            for above, _, text in self.link["parts"][::-1][:1] if depth else []:
                text.append(data)

    def _end(self) -> None:
        if self.link is not None:
            self.found.append(self.link)
        self.link, self.open = None, []


def _read(html: str | None, prefix: str) -> _Anchors:
    page = _Anchors(prefix)
    page.feed(html or "")
    page.close()
    page._end()
    return page


@udtf(returnType="pos int, target string, label string")
class LinkRows:
    """Links of a page whose target begins with ``prefix``, in page order."""

    def eval(self, html: str, prefix: str) -> Iterator[tuple]:
        for pos, link in enumerate(_read(html, prefix).found):
            yield pos, link["target"], "".join(link["text"]).strip()


@udtf(returnType="pos int, player_id long, last_name string, first_name string, positions array<string>, season int")
class RosterRows:
    """Players of a roster page: the first link of each id that has a last name, and the year the page's season begins."""

    def eval(self, html: str) -> Iterator[tuple]:
        page = _read(html, "/players/")
        told = SEASON.search(page.season or "")
        seen: set[int] = set()
        for pos, link in enumerate(page.found):
            number = PLAYER.fullmatch(link["target"])
            first = lambda c: next(("".join(text).strip() for _, own, text in link["parts"] if c in own), "")  # noqa: B023, E731
            last = first("team-player-last-name")
            if not number or not last or int(number[1]) in seen:
                continue
            seen.add(int(number[1]))
            places = ["".join(text).strip() for above, own, text in link["parts"] if "player-position" in own and "team-player-position" in above]
            yield pos, int(number[1]), last, first("team-player-first-name"), places, 2000 + int(told[1]) if told else None


def register(spark: SparkSession) -> None:
    """Make the table functions known to SQL."""
    spark.udtf.register("link_rows", LinkRows)
    spark.udtf.register("roster_rows", RosterRows)


def links(pages: DataFrame, prefix: str) -> DataFrame:
    """(all columns but html, pos, target, label): the first link of each target of each page."""
    register(pages.sparkSession)
    others = [c for c in pages.columns if c != "html"]
    names = ", ".join(f"p.`{c}`" for c in others)
    rows = pages.sparkSession.sql(f"select {names}, r.pos, r.target, r.label from {{pages}} p, lateral link_rows(p.html, {{prefix}}) r", pages=pages, prefix=prefix)
    first = F.min(F.struct("pos", "label")).alias("f")
    return rows.groupBy(*others, "target").agg(first).select(*others, "f.pos", "target", "f.label")


def rosters(pages: DataFrame, season: int | None) -> DataFrame:
    """(all columns but html, pos, player_id, last_name, first_name, positions, is_current) of roster pages; ``season``: the year the current one began."""
    register(pages.sparkSession)
    names = ", ".join(f"p.`{c}`" for c in pages.columns if c != "html")
    rows = pages.sparkSession.sql(f"select {names}, r.* from {{pages}} p, lateral roster_rows(p.html) r", pages=pages)
    return rows.withColumn("is_current", F.coalesce(F.col("season") == F.lit(season), F.lit(False))).drop("season")
