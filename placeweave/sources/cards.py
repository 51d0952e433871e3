"""Listing cards of travel pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeweave.functions import hours as H
from placeweave.functions import text as T
from placeweave.sources.feeds import absolute_url

# Sections whose listings are places, with their category.
SECTIONS = {"see": "attraction", "do": "attraction", "eat": "restaurant", "drink": "bar", "sleep": "hotel", "buy": "shopping"}
FIELDS = {"listing-name": "name", "listing-content": "content", "listing-address": "address", "listing-hours": "hours_text", "listing-price": "price_text", "latitude": "latitude", "longitude": "longitude"}
COLUMNS = ["target_id", "base_url", "section", "name", "content", "address", "hours_text", "price_text", "latitude", "longitude", "data_lat", "data_lon", "href"]
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class CardParser(HTMLParser):
    """Collects the cards of a page with the heading of the section around them, or else the last heading before."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.cards: list[dict] = []
        self.open: list[tuple[str, str | None]] = []
        self.sections: list[dict] = []
        self.heading: list[str] | None = None
        self.last = ""
        self.card: dict | None = None
        self.depth = 0
        self.pages: list[tuple[dict, dict | None]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        classes = a.get("class", "").split()
        if tag == "section":
            self.sections.append({"title": None})
        if tag in ("h2", "h3"):
            self.heading = []
        field = next((FIELDS[c] for c in classes if c in FIELDS), None)
        if self.card is None and "vcard" in classes:
            self.card, self.depth = {"around": list(self.sections), "before": self.last}, len(self.open)
        if self.card is not None:
            if "data-lat" in a and "data-lon" in a:
                self.card.setdefault("data_lat", a["data-lat"])
                self.card.setdefault("data_lon", a["data-lon"])
            if tag == "a" and a.get("href") and ("external" in classes or any(f == "url" for _, f in self.open)):
                self.card.setdefault("href", a["href"])
            if field and field not in self.card:
                self.card[field] = ""
            else:
                field = None
        if tag not in _VOID:
            self.open.append((tag, "url" if "listing-url" in classes else field))

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, _ in self.open):
            return
        while self.open:
            t, _ = self.open.pop()
            if t in ("h2", "h3") and self.heading is not None:
                self.last = " ".join(" ".join(self.heading).split()).lower()
                for s in self.sections:
                    s["title"] = self.last if s["title"] is None else s["title"]
                self.heading = None
            if t == "section" and self.sections:
                self.sections.pop()
            if self.card is not None and len(self.open) == self.depth:
                self.cards.append(self.card)
                self.card = None
            if t == tag:
                break

    def handle_data(self, data: str) -> None:
        if self.heading is not None:
            self.heading.append(data)
        if self.card is not None:
            for _, field in self.open:
                if field and field != "url":
                    self.card[field] += data + " "

    def close(self) -> None:
        super().close()
        if self.card is not None:
            self.cards.append(self.card)
            self.card = None


def section_of(card: dict) -> str | None:
    """The section's name if it is one of SECTIONS, else the heading's first word."""
    around = [s["title"] for s in card["around"] if s["title"] is not None]
    title = around[-1] if around else card["before"]
    return next((k for k in SECTIONS if title.startswith(k)), (title.split() or [None])[0]) if title else None


def cards(pages: DataFrame) -> DataFrame:
    """One row a card of pages(target_id, url, html), fields as they stand."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for page in frame.itertuples(index=False):
                parser = CardParser()
                parser.feed(page.html or "")
                parser.close()
                for c in parser.cards:
                    known = c | {"target_id": page.target_id, "base_url": page.url, "section": section_of(c)}
                    rows.append([known.get(k) for k in COLUMNS])
            yield pd.DataFrame(rows, columns=COLUMNS, dtype=object)

    return pages.select("target_id", "url", "html").mapInPandas(run, ", ".join(f"{c} string" for c in COLUMNS))


def card_places(found: DataFrame, city: str, country: str) -> DataFrame:
    """Raw places of cards; one needs a name, coordinates and a section of places."""
    number = lambda c: F.trim(c).try_cast("double")
    geo_ok = number("latitude").isNotNull() & number("longitude").isNotNull()
    category = None
    for name, kind in SECTIONS.items():
        category = F.when(F.col("section") == name, kind) if category is None else category.when(F.col("section") == name, kind)
    p = found.select(
        "target_id", "section", T.tidy_name(F.col("name")).alias("name"), F.when(geo_ok, number("latitude")).otherwise(number("data_lat")).alias("lat"), F.when(geo_ok, number("longitude")).otherwise(number("data_lon")).alias("lng"),
        category.alias("category"), *(F.nullif(T.tidy(F.col(c)), F.lit("")).alias(c) for c in ("content", "address", "hours_text", "price_text")), F.coalesce(absolute_url(F.col("href"), F.col("base_url")), "base_url").alias("url"),
    )
    p = p.where((F.col("name") != "") & F.col("lat").isNotNull() & F.col("lng").isNotNull() & F.col("category").isNotNull())
    where = F.format_string("%.5f,%.5f", "lat", "lng")
    return p.select(
        F.lit("blog").alias("source"), T.synthetic_id("blog", F.col("target_id"), F.lower("name"), where).alias("source_place_id"), "name", F.lit(city).alias("city"), F.lit(country).alias("country_code"), "category", "lat", "lng", "address",
        T.price_tier(F.col("price_text")).alias("price_tier"), H.parse_text(F.col("hours_text")).alias("hours"), "url", "section", F.col("content").alias("evidence_text"),
        F.when(F.col("content").isNotNull(), F.array(F.struct(F.col("content").alias("text"), F.col("url").alias("url"), F.lit(1.0).alias("weight")))).alias("evidence"),
    )
