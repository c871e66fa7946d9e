"""Tags, kinds and verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: the vocabulary words that decide kinds, and each facet's limits ----
TOOL_TYPES = ("tool-release", "tooling", "library-release", "product-launch")
RELEASE_TYPES = ("version-release", "release-announcement")
TOOL_FACET = "framework-library-tool"
FACETS = ("domain", "content-type", "topic-technology", "difficulty", "ecosystem-language", "company-vendor-model", "framework-library-tool", "concept-theme", "trending-emerging")
LIMITS = {"domain": 2, "content-type": 2, "topic-technology": 6, "difficulty": 1, "ecosystem-language": 3, "company-vendor-model": 5, "framework-library-tool": 6, "concept-theme": 4, "trending-emerging": 4}
MANDATORY = FACETS[:3]


def tool_tag(facet: Column, tag: Column) -> Column:
    """FL10 for one tag row."""
    return (facet == TOOL_FACET) | ((facet == "content-type") & tag.isin(*TOOL_TYPES))


def release_tag(facet: Column, tag: Column) -> Column:
    return (facet == "content-type") & tag.isin(*RELEASE_TYPES)


def effective_kind(kind: Column, is_tool: Column) -> Column:
    """FL9: the stored kind decides, tags only where there is none."""
    return F.when(kind.isin("tool", "release"), "tool").when(kind == "news", "news").otherwise(F.when(is_tool, "tool").otherwise("news"))


def kind_matches(wanted: str, kind: Column, is_tool: Column) -> Column:
    """FL7: release is exact, tool and news follow effective_kind."""
    return F.coalesce(kind == "release", F.lit(False)) if wanted == "release" else effective_kind(kind, is_tool) == wanted


def valid_tags(raw: Column, vocabulary: Column, aliases: Column, most: int) -> Column:
    """Struct of the accepted tags and of those dropped. vocabulary: array; aliases: map."""
    clean = F.transform(F.coalesce(raw, F.array().cast("array<string>")), lambda t: F.lower(F.trim(t)))

    def canonical(t):
        other = F.try_element_at(aliases, t)
        return F.when(F.array_contains(vocabulary, t), t).when(F.array_contains(vocabulary, F.coalesce(other, F.lit("\0"))), other)

    found = F.array_distinct(F.filter(F.transform(clean, canonical), lambda t: t.isNotNull()))
    return F.struct(F.slice(found, 1, most).alias("tags"), F.filter(clean, lambda t: canonical(t).isNull()).alias("dropped"))


def clamp_relation(relation: Column) -> Column:
    """X24."""
    return F.when(relation.isin("direct", "similar"), relation).otherwise("none")


def clamp_kind(kind: Column) -> Column:
    """X24."""
    return F.when(kind == "tool", "tool").otherwise("news")


def clamp_verify(status: Column) -> Column:
    """X24."""
    return F.when(status.isin("ok", "junk"), status).otherwise("suspect")


def relation_rank(relation: Column) -> Column:
    """OR6."""
    return F.when(relation == "direct", 0).when(relation == "similar", 1).otherwise(2)


def kind_rank(kind: Column) -> Column:
    """OR8."""
    return F.when(kind == "news", 0).when(kind == "tool", 1).when(kind == "release", 2).otherwise(3)


def source_type(internal: Column, external: Column, issues: Column, prose: Column) -> Column:
    """Many issue-like internal links and little prose make an index."""
    return F.when((issues >= 5) & (internal >= external), "index").when((external > internal) | (prose > 1500), "listing").otherwise("index")


def wrong_language(title: Column, summary: Column) -> Column:
    """Any CJK in a title, or over a quarter of a summary."""
    from .text import cjk_ratio, has_cjk

    return has_cjk(title) | (cjk_ratio(summary) > 0.25)


def classification_status(errored: Column, counts: Column) -> Column:
    """Null (not stored) where a mandatory facet errored, else partial or done.

    errored: array of facet names; counts: map of facet to number of tags.
    """
    must = F.array(*map(F.lit, MANDATORY))
    empty = F.exists(must, lambda f: F.coalesce(F.try_element_at(counts, f), F.lit(0)) == 0)
    return F.when(F.arrays_overlap(errored, must), F.lit(None).cast("string")).when((F.size(errored) > 0) | empty, "partial").otherwise("done")
