"""Roundup curation and the article guards, as compositions of column functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import pages, text, urls
from .joins import missing_from
from .ordering import first_of

SAVED_KINDS = ("news", "tool", "release")


def sections(docs: DataFrame, most_chars: int = 12_000, most_sections: int = 12) -> DataFrame:
    """(id, part, section, body) of docs(id, markdown).

    Two to `most_sections` labelled lines cut a text into sections, with what is
    before the first as one of its own; bodies under 20 characters go. Other texts
    are cut by size. Longer bodies are cut by size too (H17).
    """
    lines = docs.select("id", "markdown", F.posexplode(F.split(F.coalesce("markdown", F.lit("")), "\n")).alias("n", "line"))
    marked = lines.withColumn("title", text.section_title(F.col("line")))
    marks = marked.groupBy("id").agg(F.count("title").alias("marks"))
    # one text's lines meet in one window; a text is the unit that the split needs whole
    order = Window.partitionBy("id").orderBy("n")
    numbered = marked.withColumn("part", F.count("title").over(order))
    bodies = numbered.groupBy("id", "part").agg(F.first("title", ignorenulls=True).alias("section"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("body"))
    many = F.col("marks").between(2, most_sections)
    cut = bodies.join(marks, "id").where(many & (F.length(F.trim("body")) >= 20)).select("id", "part", "section", F.trim("body").alias("body"))
    whole = docs.join(marks, "id").where(~many).select("id", F.lit(0).cast("long").alias("part"), F.lit(None).cast("string").alias("section"), F.col("markdown").alias("body"))
    return cut.union(whole).select("id", "part", "section", F.explode(chunked(F.col("body"), F.lit(most_chars))).alias("body"))


@F.pandas_udf(ArrayType(StringType()))
def chunked(body: pd.Series, most: pd.Series) -> pd.Series:
    """Pieces that end at blank lines."""
    return pd.Series([pages.chunks(b, int(n)) for b, n in zip(body, most)])


def consolidated(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """items(issue_url, pos, url, title, kind, section, blurb) → the kept ones and counts of skip reasons by issue.

    URLs are normalised, links to the issue's own host and invalid ones go,
    advert and job marks override the kind, and the first of each URL stays.
    """
    there = urls.normalize_url(F.col("url"))
    kind = F.when(text.is_sponsor(F.col("title"), F.col("section"), F.col("blurb")), "sponsor").when((F.col("kind") != "job") & text.is_job(F.col("section")), "job").otherwise(F.col("kind"))
    marked = items.withColumns({"url": there, "kind": kind})
    reason = (
        F.when(F.col("url").isNull() | ~F.col("url").rlike("(?i)^https?:"), "invalid")
        .when(urls.host_of(F.col("url")) == urls.host_of(F.col("issue_url")), "internal")
        .when(~F.col("kind").isin(*SAVED_KINDS), F.when(F.col("kind").isin("sponsor", "job"), F.col("kind")).otherwise("other"))
    )
    judged = marked.withColumn("reason", reason)
    kept = first_of(judged.where("reason IS NULL").drop("reason"), ["issue_url", "url"], "pos")
    tidy = kept.withColumns({"title": text.squeezed(F.col("title")), "section": F.nullif(text.squeezed(F.col("section")), F.lit("")), "blurb": F.nullif(text.squeezed(F.col("blurb")), F.lit(""))})
    return tidy, judged.where("reason IS NOT NULL").groupBy("issue_url", "reason").agg(F.count("*").alias("n"))


def leftovers(links: DataFrame, items: DataFrame, most: int = 40) -> DataFrame:
    """ST4, OR12: up to `most` links of each page that no item has."""
    rest = missing_from(links, items, "url")
    return rest.withColumn("__n", F.row_number().over(Window.partitionBy("page_url").orderBy("pos"))).where(F.col("__n") <= most).drop("__n")


def repaired(content: Column, release: Column) -> Column:
    """The release text where the content ends at a button and the other is longer, else the content without it."""
    bare = text.without_trigger(content)
    return F.when(text.ends_truncated(content), F.when(F.length(release) > F.length(bare), release).otherwise(bare)).otherwise(content)


def article_outcome(title: Column, content: Column) -> Column:
    """The guards of an article in their order: blocked, error, json, thin, else stored."""
    return (
        F.when(text.is_blocked_page(title, content), "blocked")
        .when(text.is_error_page(title, content), "error")
        .when(text.is_json_page(content), "json")
        .when(text.is_thin(content), "thin")
        .otherwise("stored")
    )


def new_articles(fetched: DataFrame, known: DataFrame, order: str = "pos") -> DataFrame:
    """Fetched rows (url, content, …) whose canonical URL and content are new, the first of each."""
    keyed = fetched.withColumns({"url": urls.normalize_url(F.col("url")), "content_hash": text.content_hash(F.col("content"))}).where("url IS NOT NULL")
    once = first_of(first_of(keyed, ["url"], order), ["content_hash"], order)
    return missing_from(missing_from(once, known, "url"), known, "content_hash")


def allowed(requests: DataFrame, robots: DataFrame) -> DataFrame:
    """SC16: requests whose path no rule (host, disallow) starts; each URL is kept or not once."""
    path = F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit("/"))
    rules = robots.where("disallow <> ''").groupBy(F.col("host").alias("__host")).agg(F.collect_set("disallow").alias("__rules"))
    joined = requests.withColumn("__own", urls.host_of(F.col("url"))).join(rules, F.col("__own") == F.col("__host"), "left")
    return joined.where(~F.coalesce(F.exists("__rules", lambda r: F.startswith(path, r)), F.lit(False))).select(*requests.columns)


def with_host_fact(rows: DataFrame, facts: DataFrame, fact: str, default) -> DataFrame:
    """SC14, SC15: a remembered fact of the URL's host (kind of source, needs a browser)."""
    known = facts.select(F.col("host").alias("__host"), fact)
    return rows.withColumn("__own", urls.host_of(F.col("url"))).join(known, F.col("__own") == F.col("__host"), "left").drop("__own", "__host").withColumn(fact, F.coalesce(fact, F.lit(default)))
