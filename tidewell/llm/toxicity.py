"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams.

Features of a text are the hashes of its words, word pairs and pairs with one
word between (skip-grams), each counted once a text. Training walks through the
labelled texts in a fixed order with per-coordinate learning rates; L1 keeps
most weights at exactly zero, so the model is a short list of (feature, weight)
whose size is bounded by `bits`, and is broadcast.

Words here are runs of ASCII letters, digits and bytes of other scripts, A-Z
lowered. Null or empty texts have the bias alone. Repeated rows are scored each,
with equal scores for equal texts; a null doc_id stays null. Texts of any length
are scored whole, in runs of 256 KiB or one text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import LOWER, mix, prefix_sums, row_runs, span_hash, text_bytes, word_spans
from .shared import agreed_labels, hash_sample, identified, labelled_texts, restored

_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_PAIR, _SKIP = np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)


def text_features(column: pa.Array, bits: int):
    """(row, feature) of all grams of each run of rows; a feature may come more than once."""
    data, offsets = text_bytes(column)
    shift = np.uint64(64 - bits)
    for lo, hi in row_runs(offsets):
        part = LOWER[data[offsets[lo] : offsets[hi]]]
        starts, ends, bounds = word_spans(part, offsets[lo : hi + 1] - offsets[lo], _SEPARATOR)
        words = span_hash(prefix_sums(part), starts, ends)
        row = np.repeat(np.arange(lo, hi), np.diff(bounds))
        rows, grams = [row], [words]
        for gap, factor in ((1, _PAIR), (2, _SKIP)):
            same = row[gap:] == row[:-gap]
            rows.append(row[gap:][same])
            grams.append(mix(words[:-gap][same] * factor + words[gap:][same]))
        yield np.concatenate(rows), (np.concatenate(grams) >> shift).astype(np.int64)


@dataclass
class ToxicityModel:
    bits: int
    bias: float
    features: np.ndarray
    weights: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.features] = self.weights
        return out


@dataclass
class Ftrl:
    """FTRL-proximal state for one pass or more over texts of distinct features."""

    bits: int
    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 20.0
    l2: float = 0.0

    def __post_init__(self):
        self.z, self.n = np.zeros((1 << self.bits) + 1), np.zeros((1 << self.bits) + 1)

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)

    def learn(self, features: np.ndarray, label: int, importance: float) -> None:
        at = np.append(features, len(self.z) - 1)
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = importance * (p - label)
        root = np.sqrt(self.n[at])
        sigma = (np.sqrt(self.n[at] + g * g) - root) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g

    def model(self) -> ToxicityModel:
        w = self.weights(np.arange(len(self.z)))
        kept = np.flatnonzero(w[:-1])
        return ToxicityModel(self.bits, float(w[-1]), kept, w[kept])


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 10_000, sample_bytes: int = 128 << 20, bits: int = 20, passes: int = 5, min_texts: int = 3) -> ToxicityModel:
    """Train on labels(doc_id, toxic): at most `sample` documents of each label, the first by a hash of doc_id.

    The bounds are for the fit alone. One task walks through the sample; it
    holds `sample_bytes` of features at most (4 bytes for each distinct gram of
    a text), the first texts in hash order that fit. A doc_id counts once (see
    `labelled_texts`); ids with both labels, and rows without an id, a 0/1 label
    or a text are not learned from. Texts are read whole. Equal hashes are
    walked in the order of doc_id, so the fit does not depend on the order of rows.
    Features of fewer than `min_texts` sampled texts are left out, and both labels
    weigh the same in all.
    """
    known = agreed_labels(labels, "toxic")
    chosen = hash_sample(known.where("label = 1"), sample, 5).union(hash_sample(known.where("label = 0"), sample, 5))

    def grams(batches):
        for batch in batches:
            features: list[bytes] = [b""] * len(batch)
            for rows, found in text_features(batch.column("text"), bits):
                if len(rows):
                    both = np.unique(rows * np.int64(1 << bits) + found)
                    rows, found = both >> bits, (both & ((1 << bits) - 1)).astype(np.int32)
                    heads = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
                    for a, z in zip(heads, [*heads[1:], len(rows)]):
                        features[rows[a]] = found[a:z].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(features, pa.binary())], ["doc_id", "label", "features"])

    def walk(batches):
        labels, parts, sizes, room = [], [], [], sample_bytes // 4
        for batch in batches:
            column = batch.column("features")
            each = np.diff(np.frombuffer(column.buffers()[1], np.int32, len(batch) + 1, 4 * column.offset)) // 4
            fit = int(np.searchsorted(np.cumsum(each), room, "right"))
            if fit:
                first = column.slice(0, fit)
                start = np.frombuffer(first.buffers()[1], np.int32, 1, 4 * first.offset)[0]
                parts.append(np.frombuffer(first.buffers()[2], np.int32, int(each[:fit].sum()), int(start)).copy())
                labels.append(batch.column("label").to_numpy()[:fit])
                sizes.append(each[:fit])
                room -= len(parts[-1])
            if fit < len(batch):
                break
        if not labels:
            return
        labels, sizes = np.concatenate(labels), np.concatenate(sizes)
        features = np.concatenate(parts)
        parts.clear()
        keep = np.bincount(features, minlength=1 << bits)[features] >= min_texts  # distinct within a text
        ends = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(sizes)])]
        features = features[keep]
        del keep
        positive = int(labels.sum())
        importance = max(1.0, (len(labels) - positive) / max(1, positive))
        state = Ftrl(bits)
        for _ in range(passes):
            for label, a, z in zip(labels.tolist(), ends.tolist(), ends[1:].tolist()):
                state.learn(features[a:z], label, importance if label else 1.0)
        model = state.model()
        yield pa.RecordBatch.from_arrays([pa.array([model.bias], pa.float64()), pa.array([model.features.astype(np.int64).tobytes()], pa.binary()), pa.array([model.weights.tobytes()], pa.binary())], ["bias", "features", "weights"])

    spread = labelled_texts(docs, chosen).select("doc_id", "label", "text").mapInArrow(grams, "doc_id long, label int, features binary")
    walked = spread.repartition(1).sortWithinPartitions(F.xxhash64("doc_id", F.lit(9)), "doc_id")
    found = walked.mapInArrow(walk, "bias double, features binary, weights binary").collect()
    if not found:
        return ToxicityModel(bits, 0.0, np.zeros(0, np.int64), np.zeros(0))
    return ToxicityModel(bits, found[0].bias, np.frombuffer(found[0].features, np.int64), np.frombuffer(found[0].weights, np.float64))


def scored(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        weights = model.dense()
        for batch in batches:
            total = np.full(len(batch), model.bias)
            for rows, found in text_features(batch.column("text"), model.bits):
                w = weights[found]
                hit = w != 0
                if hit.any():
                    both = np.unique(rows[hit] * np.int64(1 << model.bits) + found[hit])
                    np.add.at(total, both >> model.bits, weights[both & ((1 << model.bits) - 1)].astype(np.float64))
            score = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return identified(docs, "text").mapInArrow(run, "doc_id long, score double, predicted int").withColumn("doc_id", restored())
