"""Sheets, pasted lists and rows of HTML pages."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How a sheet's own words map to statuses.
SHEET_STATUS = {"applied": "Applied", "shortlisted": "Resume Shortlisted", "interview": "Interview Scheduled", "in progress": "Interview In Progress", "offer": "Offer", "joined": "Joined", "rejected": "Rejected", "withdrawn": "Withdrawn"}

# The portal of a row that names none.
NO_PORTAL = "Direct/Consultancy"


def sheet(rows: DataFrame) -> DataFrame:
    """Rows of a sheet as text (company, role, portal, status, applied): unknown statuses
    are Applied, a missing portal has a name of its own. A date is a cell's time or ISO; a row
    of which it can't be read is an error, as an application without its date would be lost in every
    report."""
    known = F.create_map(*[F.lit(x) for pair in SHEET_STATUS.items() for x in pair])
    when = F.coalesce(*[F.try_to_timestamp(F.col("applied"), F.lit(f)) for f in ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss")]).cast("date")
    wrong = F.raise_error(F.concat(F.lit("no applied date can be read from: "), F.coalesce("applied", F.lit("nothing")))).cast("date")
    return rows.filter(F.trim(F.coalesce("company", F.lit(""))) != "").select(
        F.trim("company").alias("company"), F.nullif(F.trim("role"), F.lit("")).alias("role"), F.coalesce(F.nullif(F.trim("portal"), F.lit("")), F.lit(NO_PORTAL)).alias("portal"),
        F.coalesce(known[F.lower(F.trim("status"))], F.lit("Applied")).alias("status"), F.coalesce(when, wrong).alias("applied_on"),
    )


class _Links(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[str, str]] = []
        self.href: str | None = None
        self.words: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a":
            self.href, self.words = dict(attrs).get("href"), []

    def handle_data(self, data: str) -> None:
        if self.href is not None:
            self.words.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag == "a" and self.href is not None:
            self.rows.append((self.href, " ".join("".join(self.words).split())))
            self.href = None


def page_links(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """(key, n, href, label) of every link of each page, in order."""

    def run(frames):
        for frame in frames:
            out = []
            for k, page in zip(frame[key], frame[column]):
                parser = _Links()
                parser.feed(page or "")
                out += [(k, n, href, label) for n, (href, label) in enumerate(parser.rows)]
            yield pd.DataFrame(out, columns=[key, "n", "href", "label"])

    return pages.select(key, column).mapInPandas(run, f"{key} long, n long, href string, label string")


def page_state(html: Column, url: Column) -> Column:
    """What kind of page it is; the first that fits."""
    low = F.lower(F.coalesce(html, F.lit("")))
    return F.when(low.rlike("captcha|verify you are human"), "challenge").when(low.rlike("too many requests|rate limit"), "rate_limited").when(low.rlike("cookie consent|accept all cookies"), "consent").when(low.rlike("sign in to|log in to continue"), "signed_out").when(~url.rlike("^https?://[^/]+"), "unexpected_host").when(low == "", "empty").otherwise("list")
