"""Run inspection, history and status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators.joins import missing_from, per_run_cost


def run_report(run: int, articles: DataFrame, ledger: DataFrame) -> dict[str, DataFrame]:
    """Kinds, statuses, stages, cost and issues of one run; verified articles are given."""
    own, spent = articles.where(F.col("run_id") == run), ledger.where(F.col("run_id") == run)
    issues = own.groupBy("issue_url").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("kind", "id"))), lambda x: x["id"]).alias("ids"))
    return {
        "kinds": agg.counts_by(own, "kind"),
        "statuses": agg.counts_by(own, "verify_status", label="pending"),
        "stages": agg.counts_by(spent, "stage"),
        "cost": agg.cost_by(spent, "stage"),
        "issues": issues,
    }


def latest_scope(articles: DataFrame, everything: bool = False) -> DataFrame:
    """The rows of the last run that produced any, or all."""
    if everything:
        return articles
    return articles.join(articles.agg(F.max("run_id").alias("run_id")), "run_id", "left_semi")


def history(searches: DataFrame, ledger: DataFrame) -> DataFrame:
    """Searches with their real cost, newest first."""
    return per_run_cost(searches, ledger).orderBy(F.desc("search_id"))


def resumed_verdicts(candidates: DataFrame, prior: DataFrame) -> tuple[DataFrame, DataFrame]:
    """R17, JN15: what is still to be judged, and the verdicts kept from before."""
    return missing_from(candidates, prior, "id"), prior.join(candidates.select("id"), "id", "left_semi")


def translated(usage: DataFrame, names: DataFrame) -> DataFrame:
    """A provider's model name, the given one where the dimension (model, native) has none."""
    return usage.join(names, "model", "left").withColumn("native", F.coalesce("native", "model"))


def stage_line(ledger: DataFrame, most: int = 5) -> DataFrame:
    """AG29."""
    return agg.top(ledger, "stage", most, "cost_usd")


def furthest_behind(progress: DataFrame, most: int = 3) -> DataFrame:
    """AG29: the sources furthest from the floor."""
    return progress.where("pct IS NOT NULL").orderBy("pct", "source_id").limit(most)
