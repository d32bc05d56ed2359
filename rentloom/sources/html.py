"""HTML pages to listing rows. Parsing is Python per page; pages are spread over tasks and nothing else is."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentloom.functions import text as X

VOID = {"br", "img", "input", "meta", "link", "hr", "source", "area", "base", "col", "embed", "track", "wbr"}


class _Node:
    __slots__ = ("attrs", "parts", "tag")

    def __init__(self, tag, attrs):
        self.tag, self.attrs, self.parts = tag, dict(attrs), []

    def text(self) -> str:
        return re.sub(r"\s+", " ", "".join(p if isinstance(p, str) else f" {p.text()} " for p in self.parts)).strip()

    def all(self, selector: str):
        """Descendants that match "tag", ".class" or "tag.class", in order."""
        tag, _, cls = selector.partition(".")
        for p in self.parts:
            if not isinstance(p, str):
                if (not tag or p.tag == tag) and (not cls or cls in (p.attrs.get("class") or "").split()):
                    yield p
                yield from p.all(selector)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("", [])
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, attrs)
        self.open[-1].parts.append(node)
        if tag not in VOID and len(self.open) < 400:
            self.open.append(node)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        self.open[-1].parts.append(data)


def parse(html: str | None) -> _Node:
    tree = _Tree()
    tree.feed(html or "")
    return tree.root


def listing_cards(pages: DataFrame, layouts: list[dict], base: str, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page, position, title, url, price_text, place): cards of the first layout that finds any, else all links.

    A layout names selectors: card, title, price, place. A card without a title is named
    by the last part of its link; cards without a link, or without either, are dropped.
    """
    kind = pages.schema[id_col].dataType.simpleString()

    def task(batches):
        for pdf in batches:
            out = []
            for page, html in zip(pdf[id_col], pdf[html_col], strict=True):
                root = parse(html)
                found = []
                for layout in layouts:
                    for card in root.all(layout["card"]):
                        link = next(iter(card.all("a")), None)
                        part = lambda k, card=card, layout=layout: next((t for n in card.all(layout[k]) if (t := n.text())), None) if layout.get(k) else None
                        title = part("title") or (link.text() if link is not None else None)
                        if link is not None and link.attrs.get("href"):
                            found.append((title or None, link.attrs["href"], part("price"), part("place")))
                    if found:
                        break
                if not found:
                    found = [(a.text(), a.attrs["href"], None, None) for a in root.all("a") if a.attrs.get("href") and a.text()]
                out += [(page, k, *row) for k, row in enumerate(found)]
            yield pd.DataFrame(out, columns=["page", "position", "title", "url", "price_text", "place"])

    rows = pages.select(id_col, html_col).mapInPandas(task, f"page {kind}, position long, title string, url string, price_text string, place string")
    card = X.split_card("title")
    split = rows.withColumn("title", F.coalesce("title", X.title_from_slug("url"))).where("title IS NOT NULL").withColumn("c", card)
    return split.select(
        F.col("page").alias(id_col),
        "position",
        F.col("c.title").alias("title"),
        X.absolute_url("url", base).alias("url"),
        F.coalesce(X.money("price_text"), F.col("c.rent")).alias("rent"),
        F.coalesce("place", F.col("c.place")).alias("place"),
    )


def amenities(pages: DataFrame, selectors: list[str], id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page, amenities): texts of the selectors in order, each once whatever its case, joined by " | "."""
    kind = pages.schema[id_col].dataType.simpleString()

    def task(batches):
        for pdf in batches:
            out = []
            for page, html in zip(pdf[id_col], pdf[html_col], strict=True):
                root = parse(html)
                seen = {}
                for s in selectors:
                    for node in root.all(s):
                        if t := node.text():
                            seen.setdefault(t.lower(), t)
                out.append((page, " | ".join(seen.values())))
            yield pd.DataFrame(out, columns=[id_col, "amenities"])

    return pages.select(id_col, html_col).mapInPandas(task, f"{id_col} {kind}, amenities string")


def links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page, position, href) of all anchors with a quoted link, by pattern alone."""
    found = F.regexp_extract_all(F.coalesce(html_col, F.lit("")), F.lit(r'<a [^>]*href="([^"]*)"'), F.lit(1))
    return pages.select(id_col, F.posexplode(found).alias("position", "href"))
