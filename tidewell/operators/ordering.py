"""Windows, ordered computations, sorting and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, TimestampNTZType, TimestampType

#: Numbers of a sequence that one slot holds.
SLOT_NUMBERS = 1 << 16


def slotted(df: DataFrame, by: str, order: str) -> DataFrame:
    """df with __at = (key, slot): a day of a time, the first 10 characters of a string, 65,536 numbers of a sequence.

    A hot key's rows so meet in many tasks. As a struct the pair equals itself where the key or the slot is null.
    """
    kind = df.schema[order].dataType
    if isinstance(kind, TimestampType | TimestampNTZType | DateType):
        slot = F.to_date(order)
    else:
        slot = F.substring(order, 1, 10) if isinstance(kind, StringType) else F.floor(F.col(order) / SLOT_NUMBERS)
    return df.withColumn("__at", F.struct(F.col(by).alias("by"), slot.alias("slot")))


def with_earlier(rows: DataFrame, totals: dict[str, Column], earlier: dict[str, Column]) -> DataFrame:
    """Slotted rows with what the earlier slots of their key hold: aggregates `earlier`, each over the `totals` of the slots before."""
    slots = rows.groupBy("__at").agg(*(c.alias(name) for name, c in totals.items()))
    before = Window.partitionBy("__at.by").orderBy("__at.slot").rowsBetween(Window.unboundedPreceding, -1)
    for name, c in earlier.items():
        slots = slots.withColumn(name, c.over(before))
    return rows.join(slots.select("__at", *earlier), "__at")


def round_robin(df: DataFrame, date: str = "date_iso", source: str = "source_name") -> DataFrame:
    """WN1: date first, then the k-th row of each source in turn; undated rows last."""
    nth = F.row_number().over(Window.partitionBy(date, source).orderBy("id"))
    return df.withColumn("round", nth - 1).orderBy(F.desc_nulls_last(date), "round", source, "id")


def grouped_order(df: DataFrame, date: str = "date_iso", source: str = "source_name") -> DataFrame:
    """WN2."""
    return df.orderBy(F.desc_nulls_last(date), source, "id")


def first_of(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """WN3, T17: the first row of each key. A min_by over the whole row: partial results meet, no key's rows do."""
    rows = F.struct(*df.columns)
    return df.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(F.min_by(rows, F.struct(*order)).alias("__row")).select("__row.*")


def reciprocal_ranks(ranked: DataFrame, keep: DataFrame | None = None, k: int = 60) -> DataFrame:
    """R6, WN4: fuse (list, id, rank from 0): score, and ties by list then rank. Ids outside `keep` go but hold their ranks."""
    if keep is not None:
        ranked = ranked.join(keep.select("id"), "id", "left_semi")
    fused = ranked.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("seen"))
    return fused.orderBy(F.desc("score"), "seen.list", "seen.rank")


def recent(df: DataFrame, most: int, *order: str) -> DataFrame:
    """WN5, SK21."""
    return df.orderBy(*(F.desc(c) for c in order)).limit(most)


def coalesced(events: DataFrame, within_ms: int = 1200, by: str = "run_id") -> DataFrame:
    """WN6: runs of equal neighbours less than `within_ms` after the one before, within each `by`: first time, last time, count."""
    order = Window.partitionBy("__at").orderBy("ts", "event_id")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = slotted(events, by, "ts").withColumn("__row", F.struct(ms.alias("ms"), F.col("stage").alias("stage")))
    rows = with_earlier(rows, {"__end": F.max_by("__row", F.struct("ts", "event_id"))}, {"__last": F.last("__end")})
    rows = rows.withColumn("__last", F.coalesce(F.lag("__row").over(order), "__last"))
    gap = F.col("__row.ms") - F.col("__last.ms") > within_ms
    new = F.when(F.col("__last.stage").isNull() | (F.col("__last.stage") != F.col("stage")) | gap, 1).otherwise(0)
    runs = rows.withColumn("__new", new).withColumn("island", F.sum("__new").over(order))
    runs = with_earlier(runs, {"__n": F.sum("__new")}, {"__before": F.sum("__n")}).withColumn("island", F.col("island") + F.coalesce("__before", F.lit(0)))
    return runs.groupBy(by, "island").agg(F.first("stage").alias("stage"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


def host_timeline(requests: DataFrame, host: str = "host") -> DataFrame:
    """WN7, T8: start = max(arrival, the host's previous start + its gap), from (host, seq, arrival, gap).

    start_i = G_i + max over j up to i of (arrival_j - G_j), with G the gaps before: running sums and maxima of
    a slot, and those of the slots before it.
    """
    order = Window.partitionBy("__at").orderBy("seq")
    before, until = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    summed = slotted(requests, host, "seq").withColumn("__g", F.coalesce(F.sum("gap").over(before), F.lit(0)))
    summed = summed.withColumn("__lead", F.col("arrival") - F.col("__g"))
    base = F.coalesce("__base", F.lit(0))
    whole = with_earlier(summed, {"__gaps": F.sum("gap"), "__most": F.max("__lead")}, {"__base": F.sum("__gaps"), "__ahead": F.max(F.col("__most") - base)})
    start = F.col("__g") + F.greatest(F.max("__lead").over(until), F.col("__ahead") + base)
    return whole.withColumn("start", start).select(*requests.columns, "start")


def host_gap(crawl_delay: Column, base: Column, u: Column) -> Column:
    """WN7: gap = max(min(crawl_delay, 30 s), base * (0.5 + u)), in milliseconds."""
    return F.greatest(F.least(F.coalesce(crawl_delay, F.lit(0)), F.lit(30_000)), base * (0.5 + u))


def paging_stop(pages: DataFrame, max_pages: int) -> DataFrame:
    """WN8, T5: the first page at which an archive walk stops, and why.

    pages: (source_id, page, hash, links, known, below_floor, new_links, has_next).
    """
    seen = F.row_number().over(Window.partitionBy("source_id", "hash").orderBy("page")) > 1
    why = (
        F.when(F.col("__seen"), "repeated page")
        .when(F.col("links") == 0, "no links")
        .when(F.col("known") == F.col("links"), "all known")
        .when(F.col("below_floor"), "below floor")
        .when(F.col("new_links") == 0, "nothing new")
        .when(F.col("page") >= max_pages, "page limit")
        .when(~F.col("has_next"), "no next page")
    )
    marked = pages.withColumn("__seen", seen).withColumn("reason", why).where("reason IS NOT NULL")
    return marked.groupBy("source_id").agg(F.min("page").alias("page"), F.min_by("reason", "page").alias("reason"))


def admitted(calls: DataFrame, limit: float) -> DataFrame:
    """WN9 without reservations: calls by run whose spend so far and estimate stay within the limit; the first always.

    Sums of slots round otherwise than one sum in order. Where that could decide a call, its run is summed in order
    up to there: those rows make one slot, which comes first.
    """
    order = Window.partitionBy("__at").orderBy("seq")
    until = order.rowsBetween(Window.unboundedPreceding, 0)

    def summed(rows: DataFrame) -> DataFrame:
        spent = F.coalesce(F.sum("cost_usd").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        rows = rows.withColumns({"spent": spent, "__nth": F.row_number().over(order), "__size": F.sum(F.abs("cost_usd")).over(until)})
        totals = {"__cost": F.sum("cost_usd"), "__sizes": F.sum(F.abs("cost_usd")), "__rows": F.count(F.lit(1))}
        rows = with_earlier(rows, totals, {"__before": F.sum("__cost"), "__past": F.sum("__sizes"), "__n": F.sum("__rows")})
        return rows.withColumn("spent", F.coalesce("__before", F.lit(0.0)) + F.col("spent"))

    slots = slotted(calls, "run_id", "seq")
    first, total = summed(slots), F.col("spent") + F.col("cost_usd")
    # two sums of n terms in any order differ by less than 2 n 2^-53 times the sum of their sizes; twice that is allowed
    n, size = F.coalesce("__n", F.lit(0)) + F.col("__nth"), F.coalesce("__past", F.lit(0.0)) + F.col("__size")
    close = first.where(F.abs(total - limit) <= n * size * 2.0**-51).groupBy(F.struct(F.col("run_id").alias("by")).alias("__run")).agg(F.max("seq").alias("__until"))
    again = slots.withColumn("__run", F.struct(F.col("run_id").alias("by"))).join(close, "__run", "left")
    slot = F.when(F.col("seq") <= F.col("__until"), F.lit(None)).otherwise(F.col("__at.slot"))
    rows = summed(again.withColumn("__at", F.struct(F.col("run_id").alias("by"), slot.alias("slot"))))
    is_first = F.col("__n").isNull() & (F.col("__nth") == 1)
    return rows.withColumn("admitted", is_first | (total <= limit)).select(*calls.columns, "spent", "admitted")


def remaining_ms(elapsed: Column, scanned: Column, total: Column) -> Column:
    """WN10."""
    return F.when(scanned > 0, elapsed / scanned * (total - scanned))


def page(df: DataFrame, limit: int, offset: int, *order) -> DataFrame:
    """OR1, OR13."""
    return df.orderBy(*order).offset(offset).limit(limit)


def limited(df: DataFrame, most: int) -> DataFrame:
    """LIMIT -1 is no limit."""
    return df if most < 0 else df.limit(most)


def claims(frontier: DataFrame, most: int, articles: bool) -> DataFrame:
    """OR9: the pending jobs that are next, fewest retries first; articles have a pool of their own."""
    pool = F.col("kind") == "article" if articles else F.col("kind") != "article"
    return frontier.where((F.col("state") == "pending") & pool).orderBy("retries", "id").limit(most)


def facet_order(names: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """OR10: known facets in their order, the others after, by name."""
    place = F.array_position(F.array(*map(F.lit, known)), F.col("facet"))
    return names.withColumn("place", F.when(place > 0, place).otherwise(999)).orderBy("place", "facet")


def chips(catalogue: DataFrame, selected: list[str], most: int = 14) -> DataFrame:
    """OR14: of each facet the first tags by count, and every selected one."""
    nth = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "tag"))
    return catalogue.withColumn("nth", nth).where((F.col("nth") <= most) | F.col("tag").isin(*selected))


def by_spec(df: DataFrame, words: list[str], title: str = "title", summary: str = "blurb") -> DataFrame:
    """OR11: rows with more of the words as substrings first, ties as they were (pos); fewer than two words change nothing."""
    if len(words) < 2:
        return df.withColumn("overlap", F.lit(0)).orderBy("pos")
    hay = F.lower(F.concat_ws(" ", title, summary))
    found = F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(hay, w)))
    return df.withColumn("overlap", found).orderBy(F.desc("overlap"), "pos")


def in_batches(df: DataFrame, size: int, key: str, *order: str) -> DataFrame:
    """Consecutive batches within each key."""
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1) / size))
