"""Writes as rewrites of a snapshot: each takes the old rows and returns the new ones.

Tables here are versioned folders; a new version is written whole and read from
then on, so a lost executor or a repeated run cannot leave half a change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import missing_from
from .ordering import first_of


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """SK1: rows whose key is new, the first of each."""
    marked = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return first_of(marked, keys, "__new", order).drop("__new")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """SK2, SK19: the last row of each key wins."""
    marked = old.withColumn("__old", F.lit(1)).unionByName(new.withColumn("__old", F.lit(0)), allowMissingColumns=True)
    return first_of(marked.withColumn("__at", -F.col(order).cast("long")), keys, "__old", "__at").drop("__old", "__at")


def merge_fields(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """SK3: new values where they are not null, else the old ones."""
    a, b = old.alias("a"), new.alias("b")
    fields = [F.coalesce(f"b.{c}", f"a.{c}").alias(c) if c in new.columns else F.col(f"a.{c}") for c in old.columns if c != key]
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *fields)


def update_where(old: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """SK4."""
    return old.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def fill_nulls(old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """SK5: a value only where there is none."""
    other = new.select(F.col(key).alias("__key"), F.col(column).alias("__new"))
    joined = old.join(other, F.col(key) == F.col("__key"), "left")
    return joined.withColumn(column, F.coalesce(column, "__new")).select(*old.columns)


def date_siblings(old: DataFrame, anchors: DataFrame) -> DataFrame:
    """SK6, T16: every row of an issue takes the issue's date (issue_url, issue_date) where it differs or is null."""
    joined = old.join(anchors, "issue_url", "left")
    change = F.col("issue_date").isNotNull() & ~F.col("published_at").eqNullSafe(F.col("issue_date"))
    return joined.withColumn("published_at", F.when(change, F.col("issue_date")).otherwise(F.col("published_at"))).select(*old.columns)


def delete_where(old: DataFrame, condition: Column) -> DataFrame:
    """SK7: a null condition deletes nothing."""
    return old.where(~F.coalesce(condition, F.lit(False)))


def delete_keys(old: DataFrame, gone: DataFrame, key: str, gone_key: str | None = None) -> DataFrame:
    """SK7, SK8: children of deleted rows go the same way."""
    return missing_from(old, gone, key, gone_key)


def wiped(*tables: DataFrame) -> list[DataFrame]:
    """SK9: empty versions."""
    return [t.limit(0) for t in tables]


def without_source(source: int, articles: DataFrame, children: dict[str, DataFrame], searches: DataFrame) -> dict[str, DataFrame]:
    """SK10, SK11: a source's articles, their children by article_id, and the searches whose hits were all of it."""
    gone = articles.where(F.col("source_id") == source).select("id")
    hits = searches.select("search_id", F.explode("hits.id").alias("id")).join(gone.withColumn("own", F.lit(True)), "id", "left")
    orphans = hits.groupBy("search_id").agg(F.bool_and(F.coalesce("own", F.lit(False))).alias("all_own")).where("all_own")
    out = {name: delete_keys(df, gone, "article_id", "id") for name, df in children.items()}
    return out | {"articles": articles.where(~F.col("source_id").eqNullSafe(F.lit(source))), "searches": delete_keys(searches, orphans, "search_id")}


def requeued(frontier: DataFrame, articles: DataFrame, cap: int = 3) -> DataFrame:
    """Flagged articles under the cap whose job is done or failed go back to pending."""
    flagged = articles.where(F.col("needs_enrich") & (F.col("enrich_attempts") < cap)).select(F.col("url").alias("__url"), F.lit(True).alias("__again"))
    joined = frontier.join(flagged, F.col("url") == F.col("__url"), "left")
    again = F.coalesce("__again", F.lit(False)) & F.col("state").isin("done", "failed")
    return joined.withColumn("state", F.when(again, "pending").otherwise(F.col("state"))).select(*frontier.columns)


def bumped(articles: DataFrame, frontier: DataFrame) -> DataFrame:
    """One more attempt for flagged articles whose job failed."""
    failed = frontier.where("state = 'failed'").select(F.col("url").alias("__url"), F.lit(True).alias("__failed")).distinct()
    joined = articles.join(failed, F.col("url") == F.col("__url"), "left")
    up = F.col("needs_enrich") & F.coalesce("__failed", F.lit(False))
    return joined.withColumn("enrich_attempts", F.col("enrich_attempts") + up.cast("int")).select(*articles.columns)


def refreshed(frontier: DataFrame) -> DataFrame:
    """Finished listings are pending again."""
    return update_where(frontier, (F.col("kind") == "listing") & F.col("state").isin("done", "failed"), state=F.lit("pending"))


def settled(frontier: DataFrame, outcomes: DataFrame, most: int = 3) -> DataFrame:
    """States after (id, outcome): done; budget back to pending; timeout of a curated row done; else retry or failed."""
    o = outcomes.select("id", "outcome", F.coalesce("curated", F.lit(False)).alias("__curated"))
    joined = frontier.join(o, "id", "left")
    error, again = F.col("outcome").isin("error", "timeout"), F.col("retries") < most
    state = (
        F.when(F.col("outcome") == "success", "done")
        .when(F.col("outcome") == "budget", "pending")
        .when((F.col("outcome") == "timeout") & F.col("__curated"), "done")
        .when(error & again, "pending")
        .when(error, "failed")
        .otherwise(F.col("state"))
    )
    retry = error & again & ~((F.col("outcome") == "timeout") & F.col("__curated"))
    return joined.withColumn("__state", state).withColumn("retries", F.col("retries") + F.coalesce(retry, F.lit(False)).cast("int")).withColumn("state", F.col("__state")).select(*frontier.columns)


def resumed(frontier: DataFrame) -> DataFrame:
    """What was in progress when a run ended is pending."""
    return update_where(frontier, F.col("state") == "in_progress", state=F.lit("pending"))


def opened_run(runs: DataFrame, run_id: int, command: str, args: str, budget: float, now: str) -> DataFrame:
    """SK23."""
    row = runs.sparkSession.range(1).select(F.lit(run_id).alias("id"), F.lit(command).alias("command"), F.lit(args).alias("args"), F.lit(budget).alias("budget_usd"), F.lit("running").alias("status"), F.lit(now).cast("timestamp").alias("started_at"))
    return runs.unionByName(row, allowMissingColumns=True)


def closed_run(runs: DataFrame, run_id: int, status: str, new_count: int, now: str) -> DataFrame:
    """SK23."""
    return update_where(runs, F.col("id") == run_id, status=F.lit(status), new_count=F.lit(new_count).cast("long"), finished_at=F.lit(now).cast("timestamp"))


def frozen_hits(hits: DataFrame) -> DataFrame:
    """SK18: (search_id, hits_json): ids and verdicts in order."""
    listed = F.array_sort(F.collect_list(F.struct("pos", "id", "relation", "kind")))
    return hits.groupBy("search_id").agg(F.to_json(F.transform(listed, lambda h: F.struct(h["id"].alias("id"), h["relation"].alias("relation"), h["kind"].alias("kind")))).alias("hits_json"))
