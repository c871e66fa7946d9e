"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import slotted, with_earlier


def with_source(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """JN1: source_name, null where the source is unknown. The optimizer broadcasts sources while they are small."""
    return articles.join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id", "left")


def source_counts(sources: DataFrame, articles: DataFrame) -> DataFrame:
    """JN3: articles of every source, zero included; counted before the join."""
    counts = articles.groupBy("source_id").agg(F.count("*").alias("n"))
    return sources.join(counts, sources["id"] == counts["source_id"], "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("n"))


def missing_from(left: DataFrame, right: DataFrame, left_key: str, right_key: str | None = None) -> DataFrame:
    """JN4, JN15, SC7, ST4: rows of left whose key right lacks."""
    keys = right.select(F.col(right_key or left_key).alias("__key")).where("__key IS NOT NULL")
    return left.join(keys, F.col(left_key) == F.col("__key"), "left_anti")


def with_key_in(left: DataFrame, keys: DataFrame, left_key: str, right_key: str | None = None) -> DataFrame:
    """JN5, JN7."""
    keys = keys.select(F.col(right_key or left_key).alias("__key"))
    return left.join(keys, F.col(left_key) == F.col("__key"), "left_semi")


def fetch_in_order(articles: DataFrame, ids: DataFrame) -> DataFrame:
    """SC5, JN11: the articles of rows (ids: JSON array text) in the order of the ids, pos from 0."""
    wanted = ids.select(F.posexplode(F.from_json("ids", "array<long>")).alias("pos", "id"))
    return wanted.join(articles, "id").select("pos", *articles.columns)


def per_run_cost(runs: DataFrame, ledger: DataFrame) -> DataFrame:
    """JN9: each run's cost, 0 without usage; summed once before the join."""
    cost = ledger.groupBy("run_id").agg(F.sum("cost_usd").alias("cost_usd"), F.count("*").alias("calls"))
    return runs.join(cost, "run_id", "left").withColumns({"cost_usd": F.coalesce("cost_usd", F.lit(0.0)), "calls": F.coalesce("calls", F.lit(0))})


def rehydrate(searches: DataFrame, articles: DataFrame) -> DataFrame:
    """JN10, R20: frozen hits with their current articles; `gone` where one no longer exists."""
    hits = searches.select("search_id", F.inline("hits"))
    now = articles.select("id", "title", F.lit(False).alias("gone"))
    return hits.join(now, "id", "left").withColumn("gone", F.coalesce("gone", F.lit(True)))


def merge_verdicts(batch: DataFrame, results: DataFrame) -> DataFrame:
    """JN13: a verdict for each id of the batch: the first returned one, else none/news. Unknown ids go."""
    first = results.groupBy("id").agg(F.min_by(F.struct("relation", "kind"), "pos").alias("v"))
    return batch.select("id").join(first, "id", "left").select(
        "id",
        F.coalesce("v.relation", F.lit("none")).alias("relation"),
        F.coalesce("v.kind", F.lit("news")).alias("kind"),
        F.col("v").isNull().alias("missing"),
    )


def sibling_dates(articles: DataFrame) -> DataFrame:
    """JN14: (issue_url, issue_date): the date of the dated article with the smallest id."""
    return articles.where("issue_url IS NOT NULL AND published_at IS NOT NULL").groupBy("issue_url").agg(F.min_by("published_at", "id").alias("issue_date"))


def known_urls(*parts: DataFrame) -> DataFrame:
    """ST1: distinct URLs of the given one-column frames."""
    out = parts[0].toDF("url")
    for part in parts[1:]:
        out = out.union(part.toDF("url"))
    return out.where("url IS NOT NULL").distinct()


def harvested(items: DataFrame, harvest: DataFrame, since: str) -> DataFrame:
    """ST5: items and the dated harvest of the page's own host that they lack."""
    from ..functions.urls import host_of

    own = harvest.where((host_of(F.col("url")) == host_of(F.col("page_url"))) & (F.col("date") >= since))
    return items.select("url", "date").union(missing_from(own.dropDuplicates(["url"]), items, "url").select("url", "date"))


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """The last value of right at or before each row of left, by one union and a window instead of a range join.

    The window is of a slot of a key's time; a slot takes over the last value of the slots before it.
    """
    marked = left.select(key, time, F.lit(1).alias("__left"), F.lit(None).cast(right.schema[value].dataType).alias(value), *[c for c in left.columns if c not in (key, time)])
    facts = right.select(key, time, F.lit(0).alias("__left"), value, *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in (key, time)])
    order = Window.partitionBy("__at").orderBy(time, "__left").rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col(value).isNotNull(), F.struct(time))
    both = with_earlier(slotted(marked.union(facts), key, time), {"__end": F.max_by(value, known)}, {"__before": F.last("__end", ignorenulls=True)})
    return both.withColumn(value, F.coalesce(F.last(value, ignorenulls=True).over(order), "__before")).where("__left = 1").drop("__left", "__at", "__before")


def vocabulary_union(*vocabularies: DataFrame) -> DataFrame:
    """ST2, ST3: each tag of vocabularies(tag) once, with the place of the first vocabulary that has it."""
    placed = [v.select("tag", F.lit(k).alias("place")) for k, v in enumerate(vocabularies)]
    out = placed[0]
    for other in placed[1:]:
        out = out.union(other)
    return out.groupBy("tag").agg(F.min("place").alias("place"))
