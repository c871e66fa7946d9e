"""Exports: snapshot, public corpus and files for each article. Equal inputs give equal bytes but for one stamp."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import redact, slugify, snippet
from ..operators.aggregates import counts_by, tag_map


def markdown_file(articles: DataFrame, tags: DataFrame) -> DataFrame:
    """SK12: (id, slug, value): front matter of the tags, then the text."""
    maps = tag_map(tags).withColumnRenamed("article_id", "id")
    lines = F.transform(F.map_entries("tags"), lambda e: F.concat(e["key"], F.lit(": ["), F.array_join(e["value"], ", "), F.lit("]")))
    front = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("title: "), "title"), F.concat(F.lit("url: "), "url"), F.array_join(F.coalesce(lines, F.array().cast("array<string>")), "\n"), F.lit("---"))
    return articles.join(maps, "id", "left").select("id", slugify(F.col("title")).alias("slug"), F.concat_ws("\n\n", front, redact(F.col("content"))).alias("value"))


def as_json(articles: DataFrame, *columns: str) -> DataFrame:
    """SK13, SK15: one JSON text a row; keys of nulls stay."""
    return articles.select("id", F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"))


def camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(map(str.title, rest))


def public_corpus(articles: DataFrame) -> DataFrame:
    """SK15: the contract's keys in camel case, all of them present."""
    return articles.select(*(F.col(c).alias(camel(c)) for c in ("id", "source_id", "url", "title", "date_iso", "kind", "verify_status")), redact(snippet(F.col("content"), 400)).alias("snippet"))


def by_kind(articles: DataFrame) -> DataFrame:
    """AG13."""
    return counts_by(articles, "kind")


def snapshot(articles: DataFrame, tags: DataFrame) -> dict[str, DataFrame]:
    """SK14: meta, articles and contents; contents apart, so lists are read without them."""
    rows = articles.select("id", "source_id", "url", "title", "date_iso", "kind", redact(snippet(F.col("content"), 400)).alias("snippet"))
    meta = articles.agg(F.count("*").alias("articles"), F.count_distinct("source_id").alias("sources"), F.min("date_iso").alias("min_date"), F.max("date_iso").alias("max_date"))
    return {"meta": meta, "articles": rows, "contents": articles.select("id", redact(F.col("content")).alias("content"))}


def write_snapshot(parts: dict[str, DataFrame], folder: str) -> None:
    for name, df in parts.items():
        out = df.sortWithinPartitions("id") if "id" in df.columns else df
        out.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/{name}")


def write_markdown(files: DataFrame, folder: str) -> None:
    """One text file for each slug folder, written by the tasks that hold its rows."""
    files.select("slug", "value").repartition("slug").write.mode("overwrite").partitionBy("slug").text(folder)


def changed(old: DataFrame, new: DataFrame, key: str, volatile: tuple[str, ...]) -> DataFrame:
    """Keys whose rows differ in more than the volatile columns."""
    kept = [c for c in new.columns if c not in volatile and c != key]
    digest: Column = F.xxhash64(*kept)
    a, b = old.select(key, digest.alias("a")), new.select(key, digest.alias("b"))
    return a.join(b, key, "full").where("NOT a <=> b").select(key)


def deploy_plan(data: bool, code: bool, ahead: bool, live: bool, force: bool = False) -> str:
    """X39."""
    if force:
        return "publish"
    if not (data or code or ahead):
        return "nothing" if live else "publish"
    return "push" if ahead and not (data or code) else "publish"
