"""The link selector of each page template, kept in a stream, checked on every page and found anew when it fails.

Runs on `transformWithStateInPandas`, so the session needs the RocksDB state store
(`STORE`). A template's state is one row, its selector and how it came, which
expires when no page of the template has come for a while.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The setting that these operators need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

_OUT = "sig string, seq long, action string, selector string, attribute string, links int"
_STATE = "selector string, attribute string, since_seq long"


class _Keeper(StatefulProcessor):
    def __init__(self, count: Callable, derive: Callable, least: int, idle_ms: int):
        self.count, self.derive, self.least, self.idle_ms = count, derive, least, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("selector", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pages = pd.concat(list(rows)).sort_values("seq")  # one template's pages of one micro-batch
        state = self.known.get() if self.known.exists() else None
        kept, out = state, []
        for page in pages.itertuples():
            action, links = "kept", self.count(page.html, state[0], state[1], page.url) if state else 0
            if links < self.least:  # none yet, or it no longer fits
                action = "replaced" if state else "derived"
                found = self._derived(page.html)
                links = self.count(page.html, *found, page.url) if found else 0
                if links >= self.least:
                    state = (*found, int(page.seq))
                else:
                    action, links = "failed", 0  # what was known stays for the pages after it
            selector, attribute = state[:2] if state and action != "failed" else (None, None)
            out.append((key[0], page.seq, action, selector, attribute, links))
        if state and state != kept:
            self.known.update(tuple(state))
        if self.idle_ms and state:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=["sig", "seq", "action", "selector", "attribute", "links"])

    def _derived(self, html: str) -> tuple[str, str] | None:
        try:
            return self.derive(html)
        except Exception:  # noqa: BLE001 - a model without an answer is as good as none
            return None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.known.exists():
            selector, attribute, since = self.known.get()
            self.known.clear()
            yield pd.DataFrame([(key[0], since, "expired", selector, attribute, 0)], columns=["sig", "seq", "action", "selector", "attribute", "links"])
        else:
            yield pd.DataFrame([], columns=["sig", "seq", "action", "selector", "attribute", "links"])

    def close(self) -> None:
        pass


def selectors(pages: DataFrame, count: Callable[[str, str, str, str], int], derive: Callable[[str], tuple[str, str] | None], least: int = 3, idle_ms: int = 0) -> DataFrame:
    """(sig, seq, action, selector, attribute, links) for each page (sig, seq, url, html), in the order of seq within a micro-batch.

    `count(html, selector, attribute, url)` tells how many links a selector finds,
    `derive(html)` gives a candidate. action: kept, derived (the first of its
    template), replaced, or failed, when no candidate finds `least` links; then the
    selector known before is kept for the next pages. With `idle_ms`, a template of
    which no page came for so long is forgotten, and a row `expired` tells it.
    """
    keeper = _Keeper(count, derive, least, idle_ms)
    return pages.groupBy("sig").transformWithStateInPandas(keeper, _OUT, "Append", "ProcessingTime" if idle_ms else "None")
