"""Filters: optional predicates, facets, text terms and scopes."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tags import effective_kind, kind_matches, tool_tag
from ..functions.text import fold


def all_of(*conditions: Column | None) -> Column:
    """FL1: the conjunction of the given predicates; absent ones leave no trace in the plan."""
    return reduce(and_, [c for c in conditions if c is not None], F.lit(True))


def scope(df: DataFrame, sources: list[int] | None = None, since: str | None = None, until: str | None = None, date: str = "date_iso") -> DataFrame:
    """FL2, FL3, FL6: a set of sources (none given: all) and an inclusive range of dates."""
    return df.where(
        all_of(
            F.col("source_id").isin(*sources) if sources else None,
            F.col(date) >= F.lit(since).cast("date") if since else None,
            F.col(date) <= F.lit(until).cast("date") if until else None,
        )
    )


def clean_facets(facets: dict[str, list]) -> dict[str, list[str]]:
    """FL31: entries that are no text, or empty, are dropped, and facets without any."""
    kept = {f: [t for t in tags if isinstance(t, str) and t] for f, tags in facets.items()}
    return {f: tags for f, tags in kept.items() if tags}


def by_facets_any(df: DataFrame, tags: DataFrame, facets: dict[str, list[str]]) -> DataFrame:
    """FL4: one tag of each facet at least. A relational division as one aggregation and a semi-join."""
    facets = clean_facets(facets)
    if not facets:
        return df
    wanted = reduce(lambda a, b: a | b, ((F.col("facet") == f) & F.col("tag").isin(*t) for f, t in facets.items()))
    hit = tags.where(wanted).groupBy("article_id").agg(F.count_distinct("facet").alias("n")).where(F.col("n") == len(facets))
    return df.join(hit, df["id"] == hit["article_id"], "left_semi")


def by_facets_all(df: DataFrame, tags: DataFrame, facets: dict[str, list[str]]) -> DataFrame:
    """FL5: every selected tag."""
    facets = clean_facets(facets)
    if not facets:
        return df
    wanted = reduce(lambda a, b: a | b, ((F.col("facet") == f) & F.col("tag").isin(*t) for f, t in facets.items()))
    hit = tags.where(wanted).groupBy("article_id").agg(F.count_distinct("facet", "tag").alias("n")).where(F.col("n") == sum(len(set(t)) for t in facets.values()))
    return df.join(hit, df["id"] == hit["article_id"], "left_semi")


def with_tool_flag(df: DataFrame, tags: DataFrame) -> DataFrame:
    """FL10: is_tool, true where a tag says so."""
    flags = tags.where(tool_tag(F.col("facet"), F.col("tag"))).select(F.col("article_id").alias("id")).distinct().withColumn("is_tool", F.lit(True))
    return df.join(flags, "id", "left").withColumn("is_tool", F.coalesce("is_tool", F.lit(False)))


def by_kind(df: DataFrame, tags: DataFrame, wanted: str) -> DataFrame:
    """FL7."""
    return with_tool_flag(df, tags).where(kind_matches(wanted, F.col("kind"), F.col("is_tool")))


def with_effective_kind(df: DataFrame, tags: DataFrame) -> DataFrame:
    """FL9."""
    return with_tool_flag(df, tags).withColumn("effective_kind", effective_kind(F.col("kind"), F.col("is_tool")))


def by_status(df: DataFrame, status: str) -> DataFrame:
    """FL8."""
    return df.where(F.col("verify_status") == status)


def by_terms(df: DataFrame, query: str, *columns: str, accents: bool = True) -> DataFrame:
    """FL12: every space-separated term occurs in the joined columns, without case; accents fold unless told otherwise."""
    hay = F.concat_ws(" ", *columns)
    if accents:
        folded, terms = fold(hay), [t for t in (query or "").split() if t]
        conditions = [F.contains(folded, fold(F.lit(t))) for t in terms]
    else:
        conditions = [F.contains(F.lower(hay), F.lit(t.lower())) for t in (query or "").split()]
    return df.where(all_of(*conditions))


def url_contains(df: DataFrame, part: str, most: int = 50, order: str = "id") -> DataFrame:
    """FL13: a substring of the URL without case."""
    return df.where(F.col("url").ilike(f"%{part}%")).orderBy(order).limit(most)


def select_sources(sources: DataFrame, names: list[str]) -> tuple[DataFrame, list[str]]:
    """FL27: the sources with one of the names (without case), and the names that none has."""
    wanted = sources.where(F.lower("name").isin(*[n.lower() for n in names])) if names else sources
    known = {r.n for r in wanted.select(F.lower("name").alias("n")).distinct().collect()} if names else set()  # at most len(names)
    return wanted, [n for n in names if n.lower() not in known]


def find_one(sources: DataFrame, part: str):
    """FL28: the one source whose name holds the part; none or several are an error."""
    found = sources.where(F.col("name").ilike(f"%{part}%")).orderBy("id").limit(2).collect()
    if len(found) != 1:
        raise LookupError(f"{'no' if not found else 'more than one'} source matches {part!r}")
    return found[0]


def external_links(links: DataFrame) -> DataFrame:
    """FL30: http(s) links (page_url, url, pos) to other hosts, the first for each page and URL."""
    from ..functions.urls import host_of

    away = links.where(F.col("url").rlike("(?i)^https?://") & (host_of(F.col("url")) != host_of(F.col("page_url"))))
    return away.groupBy("page_url", "url").agg(F.min("pos").alias("pos"))


def active_filters(params: dict) -> int:
    """FL32: how many filters are set."""
    return sum(len(v) if isinstance(v, (list, tuple)) else sum(map(len, v.values())) if isinstance(v, dict) else v not in (None, "", False) for v in params.values())


def normalized_scope(params: dict) -> dict:
    """FL33: a single old-style source id as a list."""
    out = {k: v for k, v in params.items() if k != "sourceId"}
    if not out.get("sourceIds") and params.get("sourceId") is not None:
        out["sourceIds"] = [params["sourceId"]]
    return out


def page_limits(limit: int | None, offset: int | None, default: int = 24, most: int = 100) -> tuple[int, int]:
    """OR2."""
    return min(max(int(limit) if limit else default, 1), most), max(int(offset or 0), 0)
