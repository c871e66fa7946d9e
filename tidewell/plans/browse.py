"""Filtered browsing: one plan in place of a query for each row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import effective_date
from ..functions.text import raw_snippet
from ..operators import filters, joins
from ..operators.aggregates import tag_map
from ..operators.ordering import page


def dated(articles: DataFrame) -> DataFrame:
    return articles.withColumn("date_iso", effective_date(F.col("published_at"), F.col("extracted_at")))


def filtered(articles: DataFrame, tags: DataFrame, *, sources=None, since=None, until=None, facets=None, kind=None, status=None, query=None, every_tag=False) -> DataFrame:
    """The rows that pass all given filters; those that are not given cost nothing."""
    out = filters.scope(articles, sources, since, until)
    if status:
        out = filters.by_status(out, status)
    if facets:
        out = (filters.by_facets_all if every_tag else filters.by_facets_any)(out, tags, facets)
    if kind:
        out = filters.by_kind(out, tags, kind).drop("is_tool")
    if query:
        out = filters.by_terms(out, query, "title", "content")
    return out


def browse(articles: DataFrame, tags: DataFrame, sources: DataFrame, limit: int | None = None, offset: int | None = None, **given) -> DataFrame:
    """A page of cards, newest first: the page is cut before sources and tags are joined to it."""
    limit, offset = filters.page_limits(limit, offset)
    rows = page(filtered(articles, tags, **given), limit, offset, F.desc("date_iso"), F.desc("id"))
    cards = rows.select("id", "source_id", "url", "title", "date_iso", "kind", "verify_status", raw_snippet(F.col("blurb"), F.col("content")).alias("snippet"))
    own_tags = tags.join(F.broadcast(cards.select(F.col("id").alias("article_id"))), "article_id", "left_semi")  # a page of ids
    maps = tag_map(own_tags).withColumnRenamed("article_id", "id")
    return joins.with_source(cards.join(maps, "id", "left"), sources).orderBy(F.desc("date_iso"), F.desc("id"))
