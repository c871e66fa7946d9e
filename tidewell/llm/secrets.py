"""Secret spans: three fixed patterns, and random strings found by Markov models.

Two character models, one of random strings and one of ordinary identifiers,
give the log-likelihood ratio of each part of long runs of identifier characters.
The best parts whose ratio, in all and for each character, passes its threshold
are added to the pattern spans unless they overlap one. Spans are (kind, start, end) in code
points, end exclusive. Null text is empty and has none. A text is read whole, however
long, one at a time. Rows that repeat a doc_id are scanned each, with equal spans for
equal texts; a null doc_id stays null. Of equally good segments the first is taken.
"""

from __future__ import annotations

import hashlib
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import row_runs, text_bytes, word_spans
from .shared import identified, restored, small_batches, trimmed

# Fixed patterns; a match counts when the named part is long enough.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")

ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
_CODE = np.full(256, len(ALPHABET), np.int64)
_CODE[list(ALPHABET)] = np.arange(len(ALPHABET))
_OUTSIDE = _CODE == len(ALPHABET)
#: Codes of letters and digits come first.
_ALNUM = 62


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


@dataclass
class RandomStringModel:
    """ratio[a, b]: log P(b after a | random) - log P(b after a | ordinary); the last row is a run's start."""

    ratio: np.ndarray
    shortest: int = 20
    total: float = 20.0
    each: float = 0.8

    def candidates(self, data: np.ndarray, offsets: np.ndarray):
        """Row, start and end (bytes in the row) of the runs that pass."""
        starts, ends, bounds = word_spans(data, offsets, _OUTSIDE)
        row = np.searchsorted(bounds, np.arange(len(starts)), "right") - 1
        long = ends - starts >= self.shortest
        starts, ends, row = starts[long], ends[long], row[long]
        if not len(starts):
            return row, starts, ends
        code = _CODE[data]
        steps = np.append(0.0, self.ratio[code[:-1], np.minimum(code[1:], len(ALPHABET) - 1)])
        steps[starts] = self.ratio[len(ALPHABET), code[starts]]
        gains = np.concatenate([[0.0], np.cumsum(np.maximum(steps, 0))])
        out = []
        for k in np.flatnonzero(gains[ends] - gains[starts] >= self.total).tolist():
            out += [(int(row[k]), a, z) for a, z in self._segments(steps, code, int(starts[k]), int(ends[k]))]
        row, starts, ends = np.array(out, np.int64).reshape(-1, 3).T
        return row, starts - offsets[row], ends - offsets[row]

    def _passes(self, steps: np.ndarray, a: int, z: int) -> bool:
        score = steps[a:z].sum()
        return z - a >= self.shortest and score >= self.total and score >= self.each * (z - a)

    def _segments(self, steps: np.ndarray, code: np.ndarray, start: int, end: int) -> list[tuple[int, int]]:
        """The best segment of a run, widened to the letters and digits around it, and those beside it; else the run."""
        out, rest = [], [(start, end)]
        while rest:
            lo, hi = rest.pop()
            if hi - lo < self.shortest:
                continue
            sums = np.concatenate([[0.0], np.cumsum(steps[lo:hi] - self.each)])
            z = int(np.argmax(sums - np.minimum.accumulate(sums)))
            a = lo + int(np.argmin(sums[: z + 1]))
            z += lo
            first, last = a, z
            while a > lo and code[a] < _ALNUM and code[a - 1] < _ALNUM:
                a -= 1
            while lo < z < hi and code[z - 1] < _ALNUM and code[z] < _ALNUM:
                z += 1
            for x, y in ((a, z), (first, last)):
                if self._passes(steps, x, y):
                    out.append((x, y))
                    rest += [(lo, x), (y, hi)]
                    break
            else:
                rest += [(lo, first), (last, hi)] if last > first else []
        if not out and self._passes(steps, start, end):
            out.append((start, end))
        return out


def transitions(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Counts [a, b] of the characters b after a in the runs; the last row is a run's start."""
    size = len(ALPHABET)
    step = np.zeros(len(data) + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    at = np.flatnonzero(np.cumsum(step)[:-1])
    code = _CODE[data]
    before = np.append(size, code[:-1])
    before[starts] = size
    return np.bincount(before[at] * size + code[at], minlength=(size + 1) * size).reshape(size + 1, size)


def train(ordinary: np.ndarray, found: np.ndarray, smoothing: float = 0.5) -> RandomStringModel:
    """From transition counts of ordinary runs and of those found by pattern; drawn random strings stand beside the latter.

    The found ones weigh no more than the drawn ones, however often a secret is repeated.
    """
    data, offsets = text_bytes(pa.array([s for s, _ in random_samples()]))
    drawn = transitions(data, offsets[:-1], offsets[1:])
    counts = np.stack([ordinary, drawn + found * min(1.0, drawn.sum() / max(1, found.sum()))]) + smoothing
    logs = np.log(counts / counts.sum(axis=2, keepdims=True))
    return RandomStringModel(logs[1] - logs[0])


def random_samples(count: int = 4000, seed: int = 11) -> list[tuple[str, int]]:
    """Strings drawn evenly from the alphabets of keys and tokens, labelled 1."""
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    sets = ["0123456789abcdef", "0123456789" + letters.upper(), "0123456789" + letters + letters.upper(), "0123456789+/" + letters + letters.upper(), "0123456789_-" + letters + letters.upper()]
    return [("".join(rng.choices(sets[k % len(sets)], k=rng.randint(20, 48))), 1) for k in range(count)]


def fit_random_strings(docs: DataFrame) -> RandomStringModel:
    """Train on the transitions of characters of all documents.

    Runs of 16 characters or more inside pattern spans count as random, all
    others of 6 or more as ordinary. Tasks and Spark add them up: only one table
    of counts for each of the two reaches the driver.
    """
    size = len(ALPHABET)

    def run(batches):
        counts = np.zeros((2, size + 1, size), np.int64)
        for batch in batches:
            column = batch.column("text")
            data, offsets = text_bytes(column)
            texts = column.to_pylist()
            for lo, hi in row_runs(offsets):
                part = data[offsets[lo] : offsets[hi]]
                starts, ends, _ = word_spans(part, offsets[lo : hi + 1] - offsets[lo], _OUTSIDE)
                long = ends - starts >= 6
                starts, ends = starts[long], ends[long]
                inside = np.zeros(len(starts), bool)
                for k in range(lo, hi):
                    text = texts[k] or ""
                    for a, _, z in base_spans(text):
                        a, z = (int(offsets[k] - offsets[lo]) + len(text[:x].encode()) for x in (a, z))
                        inside[np.searchsorted(ends, a, "right") : np.searchsorted(starts, z, "left")] = True
                counts[0] += transitions(part, starts[~inside], ends[~inside])
                inside &= ends - starts >= 16
                counts[1] += transitions(part, starts[inside], ends[inside])
        label, before, after = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(before.astype(np.int32)), pa.array(after.astype(np.int32)), pa.array(counts[label, before, after])], ["label", "before", "after", "n"])

    told = small_batches(docs).select("text").mapInArrow(trimmed(run), "label int, before int, after int, n long")
    counts = np.zeros((2, size + 1, size))
    for r in told.groupBy("label", "before", "after").agg(F.sum("n").alias("n")).collect():
        counts[r.label, r.before, r.after] = r.n
    return train(*counts)


def _code_points(raw: bytes, at: int) -> int:
    return len(raw[:at].decode("utf-8", "ignore"))


def text_spans(column: pa.Array, model: RandomStringModel):
    """All spans of each text, in row order, as sorted (start, kind, end)."""
    texts = [t or "" for t in column.to_pylist()]
    added: dict[int, list[tuple[int, int]]] = {}
    data, offsets = text_bytes(column)
    for lo, hi in row_runs(offsets):
        rows, starts, ends = model.candidates(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        for row, a, z in zip((lo + rows).tolist(), starts.tolist(), ends.tolist()):
            added.setdefault(row, []).append((a, z))
    for k, text in enumerate(texts):
        spans = base_spans(text)
        if k in added:
            raw, more = text.encode(), []
            for a, z in added[k]:
                a = _code_points(raw, a) if len(raw) != len(text) else a
                z = _code_points(raw, z) if len(raw) != len(text) else z
                if not any(s < z and a < e for s, _, e in spans):
                    more.append((a, 3, z))
            spans = sorted(spans + more)
        yield text, spans


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in spans)


def secret_report(docs: DataFrame, model: RandomStringModel) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random) of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"]

    def run(batches):
        for batch in batches:
            counts, base, all_spans = [], [], []
            for _, spans in text_spans(batch.column("text"), shared.value):
                kinds = [k for _, k, _ in spans]
                counts.append([kinds.count(k) for k in range(4)])
                base.append(hashlib.sha256(joined(s for s in spans if s[1] < 3).encode()).hexdigest())
                all_spans.append(joined(spans))
            n = list(zip(*counts)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in n[:3]), pa.array(base, pa.string()), pa.array(all_spans, pa.string()), pa.array(n[3], pa.int64())], names)

    out = identified(docs, "text").mapInArrow(trimmed(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")
    return out.withColumn("doc_id", restored())


def redacted(docs: DataFrame, model: RandomStringModel, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of text replaced by the mark; overlapping spans by one. Null stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            out = []
            for text, spans in text_spans(batch.column("text"), shared.value):
                parts, at = [], 0
                for a, _, z in spans:
                    if a >= at:
                        parts += [text[at:a], mark]
                    at = max(at, z)
                out.append("".join([*parts, text[at:]]) if spans else text)
            where = batch.schema.get_field_index("text")
            old = batch.column(where)
            new = pa.array([None if null else t for t, null in zip(out, old.is_null().to_pylist())], old.type)
            yield batch.set_column(where, batch.schema.field(where), new)

    return small_batches(docs).mapInArrow(trimmed(run), docs.schema)
