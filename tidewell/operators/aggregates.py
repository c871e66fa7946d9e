"""Aggregations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts_by(df: DataFrame, *keys: str, label: str = "unknown") -> DataFrame:
    """AG3: counts by keys, null keys under a label."""
    return df.groupBy(*(F.coalesce(F.col(k).cast("string"), F.lit(label)).alias(k) for k in keys)).agg(F.count("*").alias("n"))


def tag_catalogue(tags: DataFrame) -> DataFrame:
    """AG4."""
    return tags.groupBy("facet", "tag").agg(F.count("*").alias("n"))


def facet_counts(articles: DataFrame, tags: DataFrame) -> DataFrame:
    """AG12: tag counts of the rows that are already filtered."""
    return tag_catalogue(tags.join(articles.select(F.col("id").alias("article_id")), "article_id", "left_semi"))


def tag_matches(tags: DataFrame, wanted: list[str]) -> DataFrame:
    """AG5: distinct wanted tags of each article; one tag under two facets counts once."""
    return tags.where(F.col("tag").isin(*wanted)).groupBy("article_id").agg(F.count_distinct("tag").alias("matches"))


def date_bounds(df: DataFrame, date: str = "date_iso") -> DataFrame:
    """AG6."""
    return df.agg(F.min(date).alias("min_date"), F.max(date).alias("max_date"))


def cost_by(ledger: DataFrame, *keys: str) -> DataFrame:
    """AG7, AG8."""
    return ledger.groupBy(*keys).agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"), F.count("*").alias("calls"))


def mean_positive_cost(ledger: DataFrame, least: int = 3) -> DataFrame:
    """AG9: the mean of positive costs of stages with at least `least` of them."""
    return ledger.where("cost_usd > 0").groupBy("stage").agg(F.avg("cost_usd").alias("mean_cost"), F.count("*").alias("n")).where(F.col("n") >= least)


def cost_ema(ledger: DataFrame, order: str, seed: float = 0.005, alpha: float = 0.2, most: float = 0.25) -> DataFrame:
    """AG20: the moving average of all costs by stage, from the seed, and the reserve clamp(2 * ema, seed / 10, most).

    A cost's weight is alpha * (1 - alpha) ^ (costs after it). Only costs whose weight is zero as a
    double are left before the shuffle, so no stage's whole history meets in one task. 0 < alpha < 1.
    """
    last = math.ceil(math.log(5e-324) / math.log1p(-alpha)) + 1
    recent = ledger.where("cost_usd is not null").withColumn("__rn", F.row_number().over(Window.partitionBy("stage").orderBy(F.desc(order)))).where(F.col("__rn") <= last)
    weight = F.lit(alpha) * F.pow(F.lit(1 - alpha), F.col("__rn") - 1)
    ema = F.sum(F.col("cost_usd") * weight) + F.lit(float(seed)) * F.pow(F.lit(1 - alpha), F.count("*"))
    return recent.groupBy("stage").agg(ema.alias("ema")).withColumn("reserve", F.least(F.greatest(2 * F.col("ema"), F.lit(seed / 10)), F.lit(most)))


def token_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """AG19: cost of (model, hit_tokens, miss_tokens, out_tokens) under prices by million tokens."""
    cost = (F.col("hit_tokens") * F.col("price_hit") + F.col("miss_tokens") * F.col("price_in") + F.col("out_tokens") * F.col("price_out")) / 1e6
    return usage.join(F.broadcast(prices) if prices.isLocal() else prices, "model", "left").withColumn("cost_usd", cost)


def search_estimate(n: Column, mean: Column, deep: Column, batch: int = 40, server: bool = True) -> Column:
    """AG18: calls and cost; the server adds one call for the spec and asks above 200 deep or 4000 soft rows, the client always for deep."""
    calls = F.when(deep, n).otherwise(F.ceil(n / batch)) + F.lit(1 if server else 0)
    confirm = F.when(deep, n > 200).otherwise(n > 4000) if server else deep
    return F.struct(calls.cast("long").alias("calls"), (calls * mean).alias("cost_usd"), confirm.alias("confirm"))


def tag_map(tags: DataFrame) -> DataFrame:
    """AG14: (article_id, tags: map of facet to tags in rank order)."""
    per_facet = tags.groupBy("article_id", "facet").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "tag"))), lambda x: x["tag"]).alias("tags"))
    return per_facet.groupBy("article_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("facet", "tags")))).alias("tags"))


def progress(items: DataFrame, now: str, since: str | None) -> DataFrame:
    """AG21: percent of the way from now to the floor by source; null without a floor or dated item."""
    per = items.groupBy("source_id").agg(F.min("date").alias("oldest"), F.max(F.coalesce("floor_hit", F.lit(False))).alias("floor_hit"))
    if since is None:
        return per.withColumn("pct", F.lit(None).cast("int"))
    span = F.datediff(F.lit(now).cast("date"), F.lit(since).cast("date"))
    share = F.round(100 * F.datediff(F.lit(now).cast("date"), "oldest") / span).cast("int")
    return per.withColumn("pct", F.when(F.col("floor_hit"), 100).when(F.col("oldest").isNotNull(), F.least(F.greatest(share, F.lit(0)), F.lit(100))))


def status_rollup(articles: DataFrame, done: DataFrame) -> DataFrame:
    """AG16: totals, done and pending = max(0, total - done), as one row."""
    total, finished = articles.agg(F.count("*").alias("total")), done.agg(F.count_distinct("id").alias("done"))
    return total.join(finished, F.lit(True)).withColumn("pending", F.greatest(F.col("total") - F.col("done"), F.lit(0)))


def phases(frontier: DataFrame) -> DataFrame:
    """AG28: done, open and percent of each phase of the queue."""
    phase = F.when(F.col("kind") == "listing", "discovery").when(F.col("kind") == "roundup", "curation").otherwise("articles")
    rolled = frontier.groupBy(phase.alias("phase")).agg(F.count_if(F.col("state") == "done").alias("done"), F.count_if(F.col("state").isin("pending", "in_progress")).alias("open"), F.count_if(F.col("state") == "failed").alias("failed"))
    return rolled.withColumn("pct", F.least(F.lit(100), F.greatest(F.lit(0), F.round(100 * F.col("done") / F.greatest(F.col("done") + F.col("open") + F.col("failed"), F.lit(1))).cast("int"))))


def page_signals(links: DataFrame) -> DataFrame:
    """AG27: internal, external and issue-like links of each page, by its id, as pages may share a URL."""
    from ..functions.urls import host_of

    own = host_of(F.col("url")) == host_of(F.col("page_url"))
    issue = F.col("url").rlike(r"(?i)/(issues?|editions?|archive|p)/|\d{2,}")
    return links.groupBy("page_id").agg(F.count_if(own).alias("internal"), F.count_if(~own).alias("external"), F.count_if(own & issue).alias("issue_like"))


def relevance_scores(records: DataFrame, strict: bool = False) -> DataFrame:
    """AG22: precision, recall and F1 by scenario from (scn, gt_rel, pred_rel); broad counts direct and similar."""
    hit = (lambda c: F.col(c) == "direct") if strict else (lambda c: F.col(c).isin("direct", "similar"))
    per = records.groupBy("scn").agg(
        F.count_if(hit("gt_rel") & hit("pred_rel")).alias("tp"),
        F.count_if(~hit("gt_rel") & hit("pred_rel")).alias("fp"),
        F.count_if(hit("gt_rel") & ~hit("pred_rel")).alias("fn"),
        F.avg((F.col("gt_rel") == F.col("pred_rel")).cast("double")).alias("accuracy3"),
    )
    precision, recall = (F.when(F.col("tp") + F.col(c) > 0, F.col("tp") / (F.col("tp") + F.col(c))).otherwise(F.lit(0.0)) for c in ("fp", "fn"))
    per = per.withColumn("precision", precision).withColumn("recall", recall)
    total = F.col("precision") + F.col("recall")
    return per.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(F.lit(0.0)))


def macro(scores: DataFrame) -> DataFrame:
    """AG22: the mean over scenarios."""
    return scores.agg(*(F.avg(c).alias(c) for c in ("precision", "recall", "f1", "accuracy3")))


def misses(records: DataFrame) -> DataFrame:
    """AG23: records whose broad relevance is wrong, and how."""
    truth, said = (F.col(c).isin("direct", "similar") for c in ("gt_rel", "pred_rel"))
    return records.withColumn("miss", F.when(truth & ~said, "false_negative").when(~truth & said, "false_positive")).where("miss IS NOT NULL")


def over_rounds(scores: DataFrame, *keys: str) -> DataFrame:
    """AG24: mean and population deviation of f1."""
    return scores.groupBy(*keys).agg(F.avg("f1").alias("mean_f1"), F.stddev_pop("f1").alias("sd_f1"))


def top(df: DataFrame, key: str, most: int, value: str | None = None) -> DataFrame:
    """AG11, AG24, AG29: the `most` largest groups by count or by a summed value, ties by key."""
    score = F.sum(value) if value else F.count("*")
    return df.groupBy(key).agg(score.alias("n")).orderBy(F.desc("n"), key).limit(most)


def skip_reasons(items: DataFrame) -> DataFrame:
    """AG17: one row of counts by reason."""
    return items.agg(*(F.count_if(F.col("reason") == r).alias(r) for r in ("sponsor", "job", "other", "internal", "invalid")))


def summary_line(frontier: DataFrame, ledger: DataFrame) -> DataFrame:
    """AG30: queue states and the largest stages in one line."""
    states = counts_by(frontier, "state").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "state", F.col("n").cast("string")))), " ").alias("queue"))
    stages = top(ledger, "stage", 5).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "stage", "n"))), lambda x: F.concat_ws("=", x["stage"], x["n"].cast("string"))), " ").alias("stages"))
    return states.join(stages, F.lit(True)).select(F.concat_ws(" | ", "queue", "stages").alias("line"))


def host_share(articles: DataFrame) -> DataFrame:
    """AG25: how many sources share each host of articles(url, source_id)."""
    from ..functions.urls import host_of

    return articles.groupBy(host_of(F.col("url")).alias("host")).agg(F.countDistinct("source_id").alias("sources"))
