"""Dates from raw text. All parsing is in UTC; what no pattern reads is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns tried in order (fixed list); brackets are optional parts.
PATTERNS = (
    "yyyy-MM-dd[['T'][ ]HH:mm:ss[.SSS][XXX]]",
    "[MMMM][MMM] d, yyyy",
    "d [MMMM][MMM] yyyy[ HH:mm:ss Z]",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
)


def parse_date(raw: Column) -> Column:
    """Timestamp of a trimmed text by the first pattern that reads it, else null."""
    text = F.regexp_replace(F.trim(raw), r"^[A-Z][a-z]{2}, (?=\d)", "")  # a weekday says nothing more
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(p)) for p in PATTERNS))


def iso_date(raw: Column) -> Column:
    """YYYY-MM-DD, or null."""
    return F.date_format(parse_date(raw), "yyyy-MM-dd")


def clamp_future(raw: Column, now: Column) -> Column:
    """The day of now where raw is later than now and one day, else raw as it is."""
    return F.when(parse_date(raw) > now + F.expr("INTERVAL 1 DAY"), F.date_format(now, "yyyy-MM-dd")).otherwise(raw)


def effective_date(published: Column, extracted: Column) -> Column:
    """The parsed publication day, else the day of extraction."""
    return F.coalesce(F.to_date(parse_date(published)), F.to_date(extracted))


def at_floor(date: Column, since: Column, curated: Column | None = None) -> Column:
    """FL14, FL16: undated rows and rows at or after the floor pass, and curated ones always."""
    keep = date.isNull() | (date >= since)
    return keep if curated is None else keep | curated


def clamped_floor(since: Column, least: Column) -> Column:
    """FL15: the given floor, not below the least one, which is also the default."""
    return F.greatest(F.coalesce(since, least), least)


def issue_date(listing: Column, curated: Column, page: Column) -> Column:
    """The first of the three that can be parsed."""
    return F.coalesce(*(F.when(parse_date(c).isNotNull(), c) for c in (listing, curated, page)))


def anchor_date(issue_url: Column, issue: Column, target: Column) -> Column:
    """Items of an issue take the issue's date alone."""
    return F.when(issue_url.isNotNull(), issue).otherwise(target)


def shown_date(iso: Column) -> Column:
    """dd/MM/yyyy without a shift by time zone."""
    return F.date_format(F.to_date(iso), "dd/MM/yyyy")
