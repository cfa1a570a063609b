"""Links of landed pages with the date that stands beside them."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from datetime import datetime
from html import unescape
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_engine.functions.text import canonical_url, domain_of
from evidence_engine.params import NOISE_TITLES
from evidence_engine.plans.ordered import first_per_key
from evidence_engine.sources.feeds import path_allowed

#: What a link is, which tags end a block, the forms of a date, the reach beside a link.
ANCHOR = re.compile(r"""<a\b[^>]*?href\s*=\s*["']([^"']+)["'][^>]*>""", re.I | re.S)
CLOSE = re.compile("</a>", re.I)
BLOCK_END = re.compile(r"</(?:article|li|tr|section|div|p)\s*>", re.I)
# Names of months.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_MONTH = r"(january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec)"
#: Forms of a date, tried in this order; the groups of each are put into year, month, day by the letters.
DATES = (
    ("dmy", re.compile(rf"\b(\d{{1,2}})[\s./-]+{_MONTH}[\s,./-]+(20\d{{2}})\b", re.I)),
    ("mdy", re.compile(rf"\b{_MONTH}\s+(\d{{1,2}})(?:st|nd|rd|th)?[,\s]+(20\d{{2}})\b", re.I)),
    ("ymd", re.compile(r"\b(20\d{2})-(\d{2})-(\d{2})\b")),
    # a date before a time: the form above asks for an end of word after the day
    ("ymd", re.compile(r"\b(20\d{2})-(\d{2})-(\d{2})T\d{2}:\d{2}")),
)
#: Characters beside a link that count as its surroundings where no block ends.
REACH = 220


def plain(html: str) -> str:
    """Text of a piece of HTML without scripts, styles and tags."""
    body = re.sub(r"(?is)<(script|style)\b.*?</\1>", " ", html)
    return " ".join(unescape(re.sub(r"<[^>]+>", " ", body)).split())


def date_in(text: str) -> str | None:
    """The first date of the first form that has one, as yyyy-mm-dd; days that do not exist are no dates."""
    for order, form in DATES:
        found = form.search(text)
        if found:
            part = dict(zip(order, found.groups()))
            month = part["m"] if part["m"].isdigit() else MONTHS.index(part["m"][:3].lower()) + 1
            try:
                return datetime(int(part["y"]), int(month), int(part["d"])).strftime("%Y-%m-%d")
            except ValueError:
                continue
    return None


def anchors(html: str, base: str) -> Iterator[tuple[int, str, str, str | None]]:
    """(nth, address, title, date) of each link: the date is sought from the end of the block before to the end of its own.

    A link reaches to the next closing tag; opening and closing tags are found in one pass each, so broken pages take no longer.
    """
    ends = [m.end() for m in BLOCK_END.finditer(html)]
    seen: dict[tuple[int, int], str | None] = {}
    closes = [m.span() for m in CLOSE.finditer(html)]
    nth, done, k = -1, 0, 0
    for m in ANCHOR.finditer(html):
        if m.start() < done:
            continue  # within the link before
        while k < len(closes) and closes[k][0] < m.end():
            k += 1
        if k == len(closes):
            break  # no link is closed from here on
        nth, done = nth + 1, closes[k][1]
        before, after = bisect_right(ends, m.start()), bisect_left(ends, done)
        span = ends[before - 1] if before else max(0, m.start() - REACH), ends[after] if after < len(ends) else done + REACH
        if span not in seen:
            seen[span] = date_in(plain(html[span[0] : span[1]]))
        try:
            link = urljoin(base, unescape(m.group(1)))
        except ValueError:
            continue
        yield nth, link, re.sub(r"\s*[|·]\s*$", "", plain(html[m.end() : closes[k][0]])), seen[span]


def page_links(pages: DataFrame, include: list[str], exclude: list[str], title_chars: tuple[int, int] = (18, 240), newest: int = 30) -> DataFrame:
    """pages(page_id, url, html) -> page_id, domain, link, title, published_on, nth: dated links of a page to its own site.

    The first of each address counts, ordered by page_id and place; the newest so many of each domain stay. Null pages have none.
    """
    kind = pages.schema["page_id"].dataType.simpleString()

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for page, url, html in zip(batch["page_id"], batch["url"], batch["html"]):
                found = [(page, url, *a) for a in anchors(html, url)]
                if found:
                    yield pd.DataFrame(found, columns=["page_id", "url", "nth", "href", "title", "day"])

    rows = pages.select("page_id", "url", "html").filter("page_id IS NOT NULL AND url IS NOT NULL AND html IS NOT NULL").mapInPandas(find, f"page_id {kind}, url string, nth int, href string, title string, day string")
    rows = rows.filter(F.col("day").isNotNull() & F.length("title").between(*title_chars) & ~F.lower("title").isin(*NOISE_TITLES))
    rows = rows.select("page_id", domain_of(F.col("url")).alias("domain"), F.col("href"), canonical_url(F.col("href")).alias("link"), "title", F.col("day").cast("date").alias("published_on"), "nth")
    rows = rows.filter(F.col("href").rlike("^https?://") & path_allowed(F.col("href"), F.col("domain"), include, exclude))
    first = rows.groupBy("domain", "link").agg(F.min(F.struct("page_id", "nth", "title", "published_on")).alias("f")).select("domain", "link", "f.*")
    kept = first_per_key(first, ["domain"], [F.col("published_on").desc(), "page_id", "nth"], newest, F.struct("page_id", "nth"))
    return kept.select("page_id", "domain", "link", "title", "published_on", "nth")
