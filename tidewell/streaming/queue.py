"""Stateful operators on Structured Streaming: the work queue, breaker, ledger and milestones.

Every state is a small row for each key. Order within a key is by `seq`; a
micro-batch is sorted before it is folded, and state carries over batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _ordered(frames: Iterator[pd.DataFrame]):
    """A key's rows of one micro-batch in order; a batch holds few events of one key."""
    rows = pd.concat(list(frames))
    return rows.sort_values("seq").itertuples()


def frontier_states(events: DataFrame, most: int = 3) -> DataFrame:
    """(url, seq, event) → (url, seq, state, retries). Events: enqueue, claim, success, error, budget, resume."""

    def fold(key, frames, state: GroupState):
        now, retries = state.get if state.exists else ("", 0)
        out = []
        for e in _ordered(frames):
            if e.event == "enqueue" and not now:
                now = "pending"
            elif e.event == "claim" and now == "pending":
                now = "in_progress"
            elif e.event == "success":
                now = "done"
            elif e.event in ("budget", "resume") and now == "in_progress":
                now = "pending"
            elif e.event == "error" and now == "in_progress":
                retries, now = (retries + 1, "pending") if retries < most else (retries, "failed")
            out.append((key[0], e.seq, now, retries))
        state.update((now, retries))
        yield pd.DataFrame(out, columns=["url", "seq", "state", "retries"])

    return events.groupBy("url").applyInPandasWithState(fold, "url string, seq long, state string, retries int", "state string, retries int", "append", GroupStateTimeout.NoTimeout)


def breaker_states(calls: DataFrame, threshold: int = 5, base_ms: int = 60_000, most_ms: int = 900_000) -> DataFrame:
    """(host, seq, at_ms, ok) → (host, seq, admitted, state). Opens after `threshold` errors in a row; one probe after the cooldown, which doubles."""

    def fold(key, frames, state: GroupState):
        errors, until, cooldown = state.get if state.exists else (0, 0, base_ms)
        out = []
        for c in _ordered(frames):
            admitted = c.at_ms >= until
            if admitted:
                probe = until > 0
                if c.ok:
                    errors, until, cooldown = 0, 0, base_ms
                else:
                    errors += 1
                    if probe:
                        cooldown = min(2 * cooldown, most_ms)
                    if probe or errors >= threshold:
                        until = c.at_ms + cooldown
            out.append((key[0], c.seq, bool(admitted), "open" if until else "closed"))
        state.update((errors, until, cooldown))
        yield pd.DataFrame(out, columns=["host", "seq", "admitted", "state"])

    return calls.groupBy("host").applyInPandasWithState(fold, "host string, seq long, admitted boolean, state string", "errors int, until long, cooldown long", "append", GroupStateTimeout.NoTimeout)


def ledger_states(calls: DataFrame, budget: float) -> DataFrame:
    """(run_id, seq, op, amount), op reserve, commit or cancel → (run_id, seq, admitted, spent, reserved, stopped).

    The first call ever is admitted; else spent + reserved + amount must fit, or the ledger stops for good.
    """

    def fold(key, frames, state: GroupState):
        spent, reserved, calls_, stopped = state.get if state.exists else (0.0, 0.0, 0, False)
        out = []
        for c in _ordered(frames):
            admitted = None
            if c.op == "reserve":
                admitted = not stopped and (budget == 0 or calls_ == 0 or spent + reserved + c.amount <= budget)
                stopped = stopped or not admitted
                if admitted:
                    reserved, calls_ = reserved + c.amount, calls_ + 1
            else:
                reserved = max(0.0, reserved - c.amount)
                spent += c.amount if c.op == "commit" else 0.0
            out.append((key[0], c.seq, admitted, round(spent, 9), round(reserved, 9), stopped))
        state.update((spent, reserved, calls_, stopped))
        yield pd.DataFrame(out, columns=["run_id", "seq", "admitted", "spent", "reserved", "stopped"])

    return calls.groupBy("run_id").applyInPandasWithState(fold, "run_id long, seq long, admitted boolean, spent double, reserved double, stopped boolean", "spent double, reserved double, calls int, stopped boolean", "append", GroupStateTimeout.NoTimeout)


def milestones(events: DataFrame, within_ms: int = 1200) -> DataFrame:
    """T14, WN6 as a stream: (run_id, seq, ts_ms, stage) → a row whenever a run of equal stages grows, with its count."""

    def fold(key, frames, state: GroupState):
        stage, last, island, n = state.get if state.exists else ("", 0, 0, 0)
        out = []
        for e in _ordered(frames):
            same = n > 0 and e.stage == stage and e.ts_ms - last <= within_ms
            island, n = (island, n + 1) if same else (island + 1, 1)
            stage, last = e.stage, e.ts_ms
            out.append((key[0], island, stage, n, e.seq))
        state.update((stage, last, island, n))
        yield pd.DataFrame(out, columns=["run_id", "island", "stage", "n", "seq"])

    return events.groupBy("run_id").applyInPandasWithState(fold, "run_id long, island long, stage string, n long, seq long", "stage string, last long, island long, n long", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling counts by stage with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "stage").agg(F.count("*").alias("n"), F.sum("cost_usd").alias("cost_usd")).select(F.col("w.start").alias("start"), "stage", "n", "cost_usd")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a run."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "run_id").agg(F.count("*").alias("n")).select("run_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(urls: DataFrame, late: str = "1 day") -> DataFrame:
    """Each URL once within the watermark."""
    return urls.withWatermark("ts", late).dropDuplicatesWithinWatermark(["url"])


def appended(stream: DataFrame, folder: str, checkpoint: str):
    """SK16, T12: append each micro-batch once; the batch id names its folder, so a replay overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def collected(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run an available-now stream to its end into a named table; for tests and small reports."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
