"""Small controllers as ordered folds over an array of events: one expression, no Python.

They steer a crawler, so their inputs are short; each key's events are folded
where they are, after one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def folded(events: DataFrame, key: str, order: str, start: Column, step) -> DataFrame:
    """(key, state) after folding each key's rows in order; step(state, row) → state."""
    fields = [c for c in events.columns if c not in (key, order)]
    listed = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("e"))
    return listed.select(key, F.aggregate("e", start, step).alias("state"))


def scroll_decision(events: DataFrame, since: str, checks: int = 3) -> DataFrame:
    """(page, seq, grew, new, oldest) → the first reason to stop scrolling: floor, plateau or stalled."""

    def step(s, e):
        stall = F.when(e["grew"] | (e["new"] > 0), 0).otherwise(s["stall"] + 1)
        why = F.when(s["why"].isNotNull(), s["why"]).when(e["oldest"] < since, "floor").when(~e["grew"] & (e["new"] == 0) & (stall >= checks), F.when(s["seen"] > 0, "plateau").otherwise("stalled"))
        return F.struct(why.alias("why"), stall.alias("stall"), (s["seen"] + e["new"]).alias("seen"))

    start = F.struct(F.lit(None).cast("string").alias("why"), F.lit(0).alias("stall"), F.lit(0).cast("long").alias("seen"))
    return folded(events, "page", "seq", start, step).select("page", F.col("state.why").alias("why"))


def lane_limit(events: DataFrame, most: int, least: int = 1, calm_ms: int = 10_000) -> DataFrame:
    """(lane, at_ms, limited) → the width: halved on a limit, one more for each calm spell."""

    def step(s, e):
        calm = e["at_ms"] - s["at"] >= calm_ms
        width = F.when(e["limited"], F.greatest(F.lit(least), F.floor(s["width"] / 2).cast("int"))).when(calm, F.least(F.lit(most), s["width"] + 1)).otherwise(s["width"])
        return F.struct(width.alias("width"), F.when(e["limited"] | calm, e["at_ms"]).otherwise(s["at"]).alias("at"))

    start = F.struct(F.lit(most).alias("width"), F.lit(0).cast("long").alias("at"))
    return folded(events, "lane", "at_ms", start, step).select("lane", F.col("state.width").alias("width"))


def penalty_ms(strikes: Column, retry_after_ms: Column, jitter: Column, most: int = 60_000) -> Column:
    """2^k seconds with jitter up to a cap, or what the answer asks for if that is more."""
    return F.greatest(F.coalesce(retry_after_ms, F.lit(0)), F.least(F.lit(most), F.pow(F.lit(2), strikes) * 1000 * (1 + jitter))).cast("long")


def work_time(phases: DataFrame, budget_ms: int) -> DataFrame:
    """(job, phase, start_ms, end_ms) → work without waits, and whether it is over the budget."""
    worked = phases.where("phase <> 'wait'").groupBy("job").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("work_ms"))
    return worked.withColumn("over", F.col("work_ms") > budget_ms)
