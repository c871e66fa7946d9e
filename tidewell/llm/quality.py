"""Quality statistics of texts, and learned decision lists over them.

A list is grown by sequential covering: while labelled bad rows remain, a rule
is grown as a conjunction of thresholds on statistics (each step takes the test
with the best gain on two thirds of the rows), pruned on the held third by
dropping tests from its end, and kept if its precision there is high enough.
The rules become one ordered Spark CASE expression: the first that fits decides.

Words are `[^\\x20\\x09-\\x0D]+` of the whole text. Null text has none, so all
its statistics are 0. Texts are read whole, one at a time; rows that repeat a
doc_id are judged each. Ties in gain take the test that comes first by name,
threshold and direction, so equal inputs give equal lists.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .flat import SPACE, text_bytes
from .shared import agreed_labels, hash_sample, labelled_texts, small_batches, trimmed

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Ratios that rules may test, as SQL over the counts and a few more (fixed list).
FEATURES = {
    "n_words": "n_words",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(n_words, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "variety": "ln(n_distinct + 1) / ln(n_words + 2)",
}
MORE_COUNTS = ("n_upper", "n_marks", "n_digits", "n_distinct")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?|")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def repeated_words(codes: np.ndarray, width: int) -> int:
    """Words that lie in a window of `width` words found at least twice."""
    n = len(codes) - width + 1
    if n < 2:
        return 0
    key, distinct = codes[:n].astype(np.int64), int(codes.max()) + 1
    size = distinct
    for k in range(1, width):
        if size > (1 << 62) // distinct:
            _, key = np.unique(key, return_inverse=True)
            size = int(key.max()) + 1
        key = key * distinct + codes[k : k + n]
        size *= distinct
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, np.int64)
    twice[order[1:][same]] = 1
    twice[order[:-1][same]] = 1
    step = np.zeros(len(codes) + 1, np.int64)
    step[:n] += twice
    step[width : width + n] -= twice
    return int((np.cumsum(step[:-1]) > 0).sum())


def text_counts(raw: bytes, window: int = 5) -> tuple[int, ...]:
    """COUNTS and MORE_COUNTS of one text."""
    words = raw.split()  # of bytes: exactly the six ASCII separators
    if not words:
        return (0,) * 9
    data = np.frombuffer(raw, np.uint8)
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    chars = int((((data & 0xC0) != 0x80) & ~SPACE[data]).sum())
    seen, dup = set(), 0
    if b"\n" in raw:
        for line in raw.split(b"\n"):
            if line in seen:
                dup += bool(line.split())
            else:
                seen.add(line)
    return (len(words), chars, int(_SYMBOL[data].sum()), dup, repeated_words(codes, window), int(_UPPER[data].sum()), int(_MARK[data].sum()), int(_DIGIT[data].sum()), len(ids))


def with_counts(docs: DataFrame, keep: tuple[str, ...], as_struct: str = "stats") -> DataFrame:
    """The kept columns of docs, and a struct of counts; the text is read whole."""
    names = (*COUNTS, *MORE_COUNTS)
    own = "text" in keep  # then the text travels once, inside the row
    base = small_batches(docs).select(F.struct(*keep).alias("row"), *[] if own else [F.col("text").alias("__text")])
    stats = T.StructType([T.StructField(n, T.LongType()) for n in names])

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(pc.struct_field(batch.column("row"), "text") if own else batch.column("__text"))
            ends = offsets.tolist()
            columns = list(zip(*(text_counts(data[a:z].tobytes()) for a, z in zip(ends, ends[1:])))) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], list(names))], ["row", as_struct])

    return base.mapInArrow(trimmed(run), T.StructType([base.schema["row"], T.StructField(as_struct, stats)]))


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def hits(self, values: dict[str, np.ndarray]) -> np.ndarray:
        return values[self.feature] >= self.threshold if self.above else values[self.feature] < self.threshold

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>=' if self.above else '<'} {self.threshold!r}D"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order, each a conjunction; a row that one fits is rejected."""

    rules: tuple[tuple[Test, ...], ...]

    def sql(self, stats: str = "stats") -> str:
        """A CASE with one branch for each rule, true for rejected rows."""
        if not self.rules:
            return "false"
        branches = " ".join(f"WHEN {' AND '.join(t.sql() for t in rule)} THEN true" for rule in self.rules)
        for name in (*COUNTS, *MORE_COUNTS):
            branches = re.sub(rf"\b{name}\b", f"{stats}.{name}", branches)
        return f"CASE {branches} ELSE false END"

    def rejects(self, stats: str = "stats") -> Column:
        return F.expr(self.sql(stats))

    def hits(self, values: dict[str, np.ndarray]) -> np.ndarray:
        out = np.zeros(len(next(iter(values.values()))), bool)
        for rule in self.rules:
            out |= np.logical_and.reduce([t.hits(values) for t in rule])
        return out


def _best_test(values, bad, covered) -> Test | None:
    """The test with the highest information gain (as in FOIL) on the covered rows."""
    p0, n0 = int((bad & covered).sum()), int((~bad & covered).sum())
    if not p0 or not n0:
        return None
    best, base = (1e-9, None), np.log2(p0 / (p0 + n0))
    for name in sorted(values):
        v, y = values[name][covered], bad[covered]
        order = np.argsort(v, kind="stable")
        v, y = v[order], y[order]
        cuts = np.flatnonzero(v[1:] > v[:-1]) + 1
        if not len(cuts):
            continue
        below = np.cumsum(y)[cuts - 1]
        for above in (True, False):
            p = p0 - below if above else below
            n = (len(v) - cuts - p) if above else cuts - p
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / np.maximum(p + n, 1)) - base), 0)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], Test(name, above, float((v[cuts[k]] + v[cuts[k] - 1]) / 2)))
    return best[1]


def learn_list(values: dict[str, np.ndarray], bad: np.ndarray, held: np.ndarray, most_rules: int = 12, most_tests: int = 3, precision: float = 0.95, least: int = 3) -> DecisionList:
    """Sequential covering; `held` rows prune and accept rules, the others grow them."""
    rules, left = [], np.ones(len(bad), bool)
    while len(rules) < most_rules:
        covered, tests = left & ~held, []
        while len(tests) < most_tests and (test := _best_test(values, bad, covered)):
            tests.append(test)
            covered = covered & test.hits(values)

        def score(tests):
            hit = np.logical_and.reduce([left & held, *(t.hits(values) for t in tests)])
            p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
            return (p + 0.5) / (p + n + 1), p

        if not tests:
            break
        tests = max((tests[:k] for k in range(1, len(tests) + 1)), key=lambda t: (score(t)[0], -len(t)))
        share, hits = score(tests)
        grown = np.logical_and.reduce([left & ~held, *(t.hits(values) for t in tests)])
        if share < precision - 0.5 / (hits + 1) or hits < least or (grown & bad).sum() < precision * grown.sum():
            break
        rules.append(tuple(tests))
        left = left & ~np.logical_and.reduce([t.hits(values) for t in tests])
    return DecisionList(tuple(rules))


def fit_list(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> DecisionList:
    """Learn from labels.quality = 0 on at most `sample` labelled documents, the first by a hash of doc_id.

    The bound is for the fit alone: statistics and verdicts cover all rows. Of
    each document only its nine numbers reach the driver, after rows that repeat
    a doc_id have become one (see `labelled_texts`). Ids with both labels, and
    rows without a label, id or text are not learned from.
    """
    chosen = hash_sample(agreed_labels(labels, "quality"), sample, 7)
    stats = with_counts(labelled_texts(docs, chosen).withColumnRenamed("label", "__quality"), ("doc_id", "__quality"))
    flat = stats.select("row.doc_id", F.col("row.__quality").alias("quality"), "stats.*").selectExpr("doc_id", "quality", *(f"double({sql}) AS f_{n}" for n, sql in FEATURES.items())).toPandas()
    if flat.empty:
        return DecisionList(())
    flat = flat.sort_values(list(flat.columns)).reset_index(drop=True)
    values = {n: flat[f"f_{n}"].to_numpy() for n in FEATURES}
    held = np.array([int(i) * 2654435761 % (1 << 32) % 3 == 0 for i in flat["doc_id"]])
    return learn_list(values, (flat["quality"] == 0).to_numpy(), held)


BASE_FAILED = "stats.n_words < 10 OR 100 * stats.n_repeat_words > 20 * stats.n_words"


def verdicts(docs: DataFrame, rules: DecisionList, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """row (the kept columns), stats, base_failed and kept."""
    counted = with_counts(docs, keep).withColumn("base_failed", F.expr(BASE_FAILED))
    return counted.withColumn("kept", ~F.col("base_failed") & ~rules.rejects())
