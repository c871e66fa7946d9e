"""Fill-in-the-middle: texts cut in prefix, middle and suffix and put in another order.

A text's units are runs of ASCII letters and single other code points. While the
units of a batch are counted, byte and code-point offsets are recorded every
`every` units, a sparse index of checkpoints. Each cut then finds the checkpoint
before it by binary search and scans the few bytes from there on again, so no
offset of every unit is ever held.

Cuts and forms follow from a hash of doc_id alone: a repeated row is cut in the
same way, and a lost task gives the same rows again. A null doc_id hashes as an
empty one and stays null. Null text is empty; empty texts, and texts that hold a
mark, stay plain. Texts of any length are scanned whole, CHUNK_BYTES at a time.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .flat import CHUNK_BYTES, text_bytes
from .shared import small_batches, trimmed

# Fixed marks before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_POINT = np.ones(256, bool)
_POINT[0x80:0xC0] = False


def _unit_starts(data: np.ndarray, after_letter: bool) -> np.ndarray:
    letter = _LETTER[data]
    return _POINT[data] & ~(letter & np.append(after_letter, letter[:-1]))


class UnitIndex:
    """Checkpoints of the units of all texts of a flat batch, counted from its first byte.

    `first[k]` and `points[k]` are the units and code points before row k.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, every: int = 256):
        self.data, self.every = data, every
        self.first, self.points = np.zeros(len(offsets), np.int64), np.zeros(len(offsets), np.int64)
        self.heads = np.unique(offsets)
        units, bytes_, points = [], [], []
        n_units = n_points = 0
        for a in range(0, len(data), CHUNK_BYTES):
            part = data[a : a + CHUNK_BYTES]
            starts = _unit_starts(part, a > 0 and bool(_LETTER[data[a - 1]]))
            inside = self.heads[np.searchsorted(self.heads, a) : np.searchsorted(self.heads, a + len(part))] - a
            starts[inside] = True  # a text begins with a unit
            seen = np.concatenate([[0], np.cumsum(starts)])
            codes = np.concatenate([[0], np.cumsum(_POINT[part])])
            rows = slice(np.searchsorted(offsets, a), np.searchsorted(offsets, a + len(part), "left"))
            self.first[rows] = n_units + seen[offsets[rows] - a]
            self.points[rows] = n_points + codes[offsets[rows] - a]
            at = np.flatnonzero(starts)[-n_units % every :: every]
            units.append(n_units + seen[at])
            bytes_.append(a + at)
            points.append(n_points + codes[at])
            n_units, n_points = n_units + int(seen[-1]), n_points + int(codes[-1])
        tail = offsets >= len(data)
        self.first[tail], self.points[tail] = n_units, n_points
        self.n_units, self.n_points = n_units, n_points
        self.at_unit, self.at_byte, self.at_point = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (units, bytes_, points))

    def locate(self, unit: int) -> tuple[int, int]:
        """Byte and code point at which a unit of the batch starts; its end for the number of all units."""
        if unit >= self.n_units:
            return len(self.data), self.n_points
        k = int(np.searchsorted(self.at_unit, unit, "right")) - 1
        left, byte, point = unit - int(self.at_unit[k]), int(self.at_byte[k]), int(self.at_point[k])
        stop = int(self.at_byte[k + 1]) if k + 1 < len(self.at_byte) else len(self.data)
        while left:
            part = self.data[byte : min(stop, byte + 4096)]
            starts = _unit_starts(part, byte > 0 and bool(_LETTER[self.data[byte - 1]]))
            starts[self.heads[np.searchsorted(self.heads, byte) : np.searchsorted(self.heads, byte + len(part))] - byte] = True
            starts[0] = False  # where this scan stands, or the rest of a unit
            found = np.flatnonzero(starts[: len(part)])
            if len(found) >= left:
                step, left = int(found[left - 1]), 0
            else:  # a long unit, or units of many bytes
                step, left = len(part), left - len(found)
                if byte + step < stop and self._starts_at(byte + step):
                    left -= 1
            point += int(np.count_nonzero(_POINT[part[:step]]))
            byte += step
        return byte, point

    def _starts_at(self, byte: int) -> bool:
        k = np.searchsorted(self.heads, byte)
        if k < len(self.heads) and self.heads[k] == byte:
            return True
        return bool(_unit_starts(self.data[byte : byte + 1], bool(_LETTER[self.data[byte - 1]]))[0])


def draws(doc_id: int | None, seed: int = 1) -> list[int]:
    """Four 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def transformed(docs: DataFrame, plain_from: int = 90, spm_below: int = 20, seed: int = 1, every: int = 256, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of docs(doc_id, text), and the columns of `keep` in a struct `row`.

    Of 100 documents those whose draw is `plain_from` or more stay plain; of the
    others those below `spm_below` are spm (suffix first), the rest psm. The
    character counts are null where the form is plain.
    """
    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            index = UnitIndex(data, offsets, every)
            bounds, first = offsets.tolist(), index.first.tolist()
            rows: dict[str, list] = {name: [] for name in ("n", "form", "prefix_chars", "middle_chars", "output")}
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                text, n = data[bounds[k] : bounds[k + 1]].tobytes(), first[k + 1] - first[k]
                h = draws(doc_id, seed)
                if not text or h[2] % 100 >= plain_from or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
                    row = (n, "plain", None, None, text)
                else:
                    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
                    (i, before), (j, upto) = (index.locate(first[k] + u) if u < n else (bounds[k + 1], int(index.points[k + 1])) for u in (low, high))
                    i, j = i - bounds[k], j - bounds[k]
                    spm = h[3] % 100 < spm_below
                    parts = [SUFFIX, text[j:], PREFIX, text[:i]] if spm else [PREFIX, text[:i], SUFFIX, text[j:]]
                    row = (n, "spm" if spm else "psm", before - int(index.points[k]), upto - before, b"".join([*parts, MIDDLE, text[i:j]]))
                for column, value in zip(rows.values(), row):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            made = [pa.array(column, kind) for column, kind in zip(rows.values(), kinds)]
            made[-1] = made[-1].cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made, *(batch.column(c) for c in ("row",) if keep)], ["doc_id", *rows, *(["row"] if keep else [])])

    told = [F.struct(*keep).alias("row")] if keep else []
    given = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", *told)
    extra = f", row {given.schema['row'].dataType.simpleString()}" if keep else ""
    return given.mapInArrow(trimmed(run), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string" + extra)


def rebuilt(output: str | Column = "output", form: str | Column = "form") -> Column:
    """The text that an output of a form was made from; the marks are the first of their kind, as the text has none."""
    out, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    p, s, m = (F.locate(mark.decode(), out) for mark in (PREFIX, SUFFIX, MIDDLE))

    def between(a: Column, z: Column) -> Column:
        return F.substring(out, a + 3, F.greatest(z - a - 3, F.lit(0)))

    middle = F.substring(out, m + 3, F.length(out))
    return (
        F.when(form == "psm", F.concat(between(p, s), middle, between(s, m)))
        .when(form == "spm", F.concat(between(p, m), middle, between(s, p)))
        .otherwise(out)
    )
