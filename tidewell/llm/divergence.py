"""Divergence of the sources of each language, from counts of their terms.

Counting: tasks turn the terms of their texts into (term, cells), where cells
holds (group, occurrences) of each (lang, source) group the task saw; sorted by
term they are merged in a stream. Kept terms, those in enough documents of a
language, are written once to the shared folder.

Comparing: for each pair of groups the kept terms are tallied by their two
counts, a joint histogram: cells with two counts above zero in blocks of terms,
those with a zero from each group's own histogram less what the joint cells
hold, and the rest of the terms as (0, 0). The divergence is evaluated once for
each cell and multiplied by the cell's terms. Nothing is gathered by term or
group in one task, and no pair of terms or documents is formed; there are as
many pairs of groups as the result has rows.

Null text, lang and source are read as ''. Each row is a document, repeated rows
included. Terms are known by a 64-bit hash of language and term, groups by one
of language and source; equal hashes are taken as equal. An empty table gives no
rows; a language without kept terms gives pairs of value 0. Texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .flat import LOWER, mix, prefix_sums, row_runs, span_hash, text_bytes, word_spans
from .shared import cut, small_batches, trimmed

#: Bytes between terms: all of ASCII but its letters.
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: Cells that a counting task holds before it hands them on, and cells of a block of the tally.
HELD_CELLS, BLOCK_CELLS = 1 << 20, 1 << 21
_CELLS = "key long, term string, docs long, cells binary"


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins, in sorted columns."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


class _Counts:
    """Cells (term key, group, occurrences, documents) of a task and the strings of their terms."""

    def __init__(self):
        self.parts, self.names, self.held = [], [], 0

    def add(self, keys: np.ndarray, groups: np.ndarray, rows: np.ndarray, terms) -> None:
        """Tokens whose rows are in the order of their groups; terms(k) gives the strings of tokens k."""
        order = np.argsort(keys, kind="stable")
        keys, groups, rows = keys[order], groups[order], rows[order]
        at = _heads(keys, groups)
        new_row = np.zeros(len(keys), np.int64)
        new_row[_heads(keys, rows)] = 1
        self.parts.append((keys[at], groups[at], np.diff(np.append(at, len(keys))), np.add.reduceat(new_row, at) if len(at) else at))
        first = _heads(keys)
        self.names.append((keys[first], terms(order[first])))
        self.held += len(at)

    def merge(self) -> None:
        keys, groups, n, docs = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((groups, keys))
        keys, groups = keys[order], groups[order]
        at = _heads(keys, groups)
        self.parts = [(keys[at], groups[at], np.add.reduceat(n[order], at), np.add.reduceat(docs[order], at))]
        known, where = np.unique(np.concatenate([k for k, _ in self.names]), return_index=True)
        self.names = [(known, pa.concat_arrays([t for _, t in self.names]).take(pa.array(where)))]
        self.held = len(at)

    def batches(self):
        if not self.held:
            return
        self.merge()
        (keys, groups, n, docs), (known, terms) = self.parts[0], self.names[0]
        first = _heads(keys)
        cells = np.empty((len(keys), 2), "<i8")
        cells[:, 0], cells[:, 1] = groups, n
        docs = np.add.reduceat(docs, first)
        bounds = np.append(first, len(keys))
        for a in range(0, len(first), 1 << 15):
            z = min(a + (1 << 15), len(first))
            blob = pa.Array.from_buffers(pa.binary(), z - a, [None, pa.py_buffer(((bounds[a : z + 1] - bounds[a]) * 16).astype(np.int32)), pa.py_buffer(cells[bounds[a] : bounds[z]].tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(known[a:z].view(np.int64)), terms[a:z].cast(pa.string()), pa.array(docs[a:z]), blob], ["key", "term", "docs", "cells"])
        self.__init__()


def term_cells(docs: DataFrame) -> DataFrame:
    """(key, term, docs, cells) of each task's texts; docs has text, lang_key and group."""

    def run(batches):
        counts = _Counts()
        for batch in batches:
            batch = batch.take(pa.array(np.argsort(batch.column("group").to_numpy(), kind="stable")))
            group, lang = batch.column("group").to_numpy(), batch.column("lang_key").to_numpy().view(np.uint64)
            data, offsets = text_bytes(batch.column("text"))
            for lo, hi in row_runs(offsets, 1 << 20):
                part = LOWER[data[offsets[lo] : offsets[hi]]]
                starts, ends, bounds = word_spans(part, offsets[lo : hi + 1] - offsets[lo], _SEPARATOR)
                if not len(starts):
                    continue
                row = np.repeat(np.arange(lo, hi), np.diff(bounds))
                keys = mix(span_hash(prefix_sums(part), starts, ends) ^ lang[row])

                def terms(k):
                    sizes = ends[k] - starts[k]
                    to = np.concatenate([[0], np.cumsum(sizes)])
                    flat = part[np.repeat(starts[k] - to[:-1], sizes) + np.arange(to[-1])]
                    return pa.Array.from_buffers(pa.large_binary(), len(k), [None, pa.py_buffer(to.astype(np.int64)), pa.py_buffer(flat.tobytes())])

                counts.add(keys, group[row], row, terms)
                if counts.held > HELD_CELLS:
                    counts.merge()
                    if counts.held > HELD_CELLS // 2:
                        yield from counts.batches()
        yield from counts.batches()

    return docs.select("text", "lang_key", "group").mapInArrow(trimmed(run), _CELLS)


def _summed(term_at: np.ndarray, cells: np.ndarray):
    """Cells summed by (term, group), in that order; term_at ascends."""
    groups, local = np.unique(cells[:, 0], return_inverse=True)
    order = np.argsort(term_at * max(1, len(groups)) + local, kind="stable")
    term_at, local, n = term_at[order], local[order], cells[order, 1]
    at = _heads(term_at, local)
    return term_at[at], groups[local[at]], (np.add.reduceat(n, at) if len(at) else n)


def merged_cells(cells: DataFrame, min_docs: int) -> DataFrame:
    """(key, term, total, groups, counts) of the terms in at least min_docs documents; groups ascend.

    Rows of a term come one after the other and are summed batch by batch, so a
    term never takes more than one cell for each of its groups.
    """

    def folded(batch):
        """Keys, strings, documents, bounds of the cells, groups and counts of the terms of sorted rows."""
        keys, cells = batch.column("key").to_numpy(), batch.column("cells")
        first = _heads(keys)
        ends = np.frombuffer(cells.buffers()[1], np.int32, len(cells) + 1, 4 * cells.offset)
        data = np.frombuffer(cells.buffers()[2], "<i8", (ends[-1] - ends[0]) // 8, int(ends[0])).reshape(-1, 2)
        term_of_row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
        at, groups, n = _summed(np.repeat(term_of_row, np.diff(ends) // 16), data)
        docs = np.add.reduceat(batch.column("docs").to_numpy(), first)
        return keys[first], batch.column("term").take(pa.array(first)), docs, np.searchsorted(at, np.arange(len(first) + 1)), groups, n

    def kept(keys, terms, docs, bounds, groups, n):
        chosen = docs >= min_docs
        sizes = np.diff(bounds)
        inside = np.repeat(chosen, sizes)
        to = np.concatenate([[0], np.cumsum(sizes[chosen])])
        sums = np.concatenate([[0], np.cumsum(n[inside])])
        lists = [pa.ListArray.from_arrays(pa.array(to, pa.int32()), pa.array(x[inside])) for x in (groups, n)]
        return pa.RecordBatch.from_arrays([pa.array(keys[chosen]), terms.filter(pa.array(chosen)), pa.array(np.diff(sums[to])), *lists], ["key", "term", "total", "groups", "counts"])

    def run(batches):
        held = None  # the last term so far, which the next batch may go on with
        for batch in batches:
            if not len(batch):
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            keys, terms, docs, bounds, groups, n = folded(batch)
            last = np.stack([groups[bounds[-2] :], n[bounds[-2] :]], axis=1).astype("<i8")
            held = pa.RecordBatch.from_arrays([pa.array(keys[-1:]), terms[-1:], pa.array(docs[-1:]), pa.array([last.tobytes()], pa.binary())], schema=batch.schema)
            yield kept(keys[:-1], terms[:-1], docs[:-1], bounds[:-1], groups[: bounds[-2]], n[: bounds[-2]])
        if held is not None:
            yield kept(*folded(held))

    spread = cells.repartition("key").sortWithinPartitions("key")
    return spread.mapInArrow(trimmed(run), "key long, term string, total long, groups array<long>, counts array<long>")


def _tally(columns: list[np.ndarray], n: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of small non-negative integers and the sum of n (1 each) over their copies."""
    key, space = np.zeros(len(columns[0]), np.int64), 1
    for c in columns:
        radix = int(c.max()) + 1
        space *= radix
        if space >= 1 << 63:  # no single number holds a row
            order = np.lexsort(columns[::-1])
            break
        key = key * radix + c
    else:
        order = np.argsort(key, kind="stable")
    columns = [c[order] for c in columns]
    at = _heads(*columns)
    return [c[at] for c in columns], np.diff(np.append(at, len(order))) if n is None else np.add.reduceat(n[order], at)


def joint_cells(kept: DataFrame) -> DataFrame:
    """(a, b, x, y, terms): of groups a < b that share terms, how many terms have x and y occurrences, both above zero;
    and, counted negative, what these terms take from the cells (x, 0) and (0, y)."""

    def block(parts):
        sizes, groups, counts = (np.concatenate(x) for x in zip(*parts))
        end = np.repeat(np.cumsum(sizes), sizes)
        known, group = np.unique(groups, return_inverse=True)
        values, count = np.unique(counts, return_inverse=True)
        at, lag = np.arange(len(group)), 1
        waiting, held = [], 0
        while len(at := at[at + lag < end[at]]) or waiting:
            if len(at):  # the pairs of a term's cells that stand `lag` apart
                waiting.append([group[at], group[at + lag], count[at], count[at + lag]])
                held += len(at)
                lag += 1
            if held > BLOCK_CELLS or not len(at):
                (a, b, x, y), n = _tally([np.concatenate(c) for c in zip(*waiting)])
                waiting, held = [], 0
                (a_x, b_x, only_x), n_x = _tally([a, b, x], n)
                (a_y, b_y, only_y), n_y = _tally([a, b, y], n)
                yield from _batches(known[a], known[b], values[x], values[y], n)
                yield from _batches(known[a_x], known[b_x], values[only_x], np.zeros_like(n_x), -n_x)
                yield from _batches(known[a_y], known[b_y], np.zeros_like(n_y), values[only_y], -n_y)

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            groups, counts = batch.column("groups"), batch.column("counts")
            parts.append((np.diff(groups.offsets.to_numpy()), groups.flatten().to_numpy(), counts.flatten().to_numpy()))
            held += len(parts[-1][1])
            if held > BLOCK_CELLS:
                yield from block(parts)
                parts, held = [], 0
        if held:
            yield from block(parts)

    return kept.select("groups", "counts").mapInArrow(trimmed(run), "a long, b long, x long, y long, terms long")


def _batches(*columns: np.ndarray, rows: int = 1 << 16):
    for lo in range(0, len(columns[0]), rows):
        yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + rows]) for c in columns], ["a", "b", "x", "y", "terms"])


def _share(count: str, total: str, terms: str) -> Column:
    """1 + floor(1000000000 * (count + 2) / (total + 2 * terms)), in decimals, which hold what longs would not."""
    return F.expr(f"1 + (CAST(1000000000 AS DECIMAL(10,0)) * CAST({count} + 2 AS DECIMAL(20,0))) div CAST({total} + 2 * {terms} AS DECIMAL(20,0))")


def _value(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def divergences(docs: DataFrame, min_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): the divergence of each source from the others of its language, and its `top` terms."""
    docs = small_batches(docs).select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    docs = docs.withColumn("lang_key", F.xxhash64("lang")).withColumn("group", F.xxhash64("lang", "source"))
    members = cut(docs.select("lang", "source", "group").distinct())
    kept = cut(merged_cells(term_cells(docs), min_docs))

    cells = kept.select("term", F.col("total").alias("in_lang"), F.explode(F.arrays_zip("groups", "counts")).alias("cell")).select("term", "in_lang", F.col("cell.groups").alias("group"), F.col("cell.counts").alias("n"))
    own = cut(cells.groupBy("group", "n").agg(F.count("*").alias("terms")))  # each group's histogram
    totals = own.groupBy("group").agg(F.sum(F.col("n") * F.col("terms")).alias("total"))
    # the language of a term is that of its groups
    langs = kept.groupBy(F.col("groups")[0].alias("group")).agg(F.count("*").alias("v"), F.sum("total").alias("lang_total"))
    langs = langs.join(members, "group").groupBy("lang").agg(F.sum("v").alias("v"), F.sum("lang_total").alias("lang_total"))
    groups = cut(members.join(langs, "lang", "left").join(totals, "group", "left").na.fill(0, ["v", "lang_total", "total"]))

    def side(name: str, *shared: str) -> DataFrame:
        return groups.select("lang", *shared, F.col("group").alias(name), F.col("source").alias(f"{name}_source"), F.col("total").alias(f"{name}_total"))

    def beside_zero(one: str, x: str, y: str) -> DataFrame:
        return pairs.join(own.withColumnRenamed("group", one), one).selectExpr("a", "b", f"{x} AS x", f"{y} AS y", "terms")

    pairs = side("a", "v").join(side("b"), "lang").where("a < b")  # as many rows as the result has, halved
    size = kept.agg(F.sum(F.size("groups"))).first()[0] or 0
    joint = joint_cells(kept.coalesce(max(1, -(-size // BLOCK_CELLS))))
    tally = joint.union(beside_zero("a", "n", "0L")).union(beside_zero("b", "0L", "n")).groupBy("a", "b", "x", "y").agg(F.sum("terms").alias("terms")).where("terms <> 0")
    told = tally.join(pairs, ["a", "b"]).withColumn("p", _share("x", "a_total", "v")).withColumn("q", _share("y", "b_total", "v"))
    told = told.groupBy("a", "b").agg(F.sum(_value("p", "q") * F.col("terms")).alias("value"), F.sum("terms").alias("seen"))
    # the terms that neither has; without kept terms there are none, and any share will do
    both = pairs.join(told, ["a", "b"], "left").na.fill(0, ["value", "seen"]).withColumn("some", F.greatest("v", F.lit(1)))
    both = both.withColumn("p", _share("0", "a_total", "some")).withColumn("q", _share("0", "b_total", "some"))
    both = both.withColumn("value", F.col("value") + F.expr("v - seen") * _value("p", "q"))
    pair_rows = both.selectExpr("lang", "a_source AS source", "b_source AS item", "value").union(both.selectExpr("lang", "b_source AS source", "a_source AS item", "value"))

    above = cells.join(groups, "group").withColumn("p", _share("n", "total", "v")).withColumn("q", _share("in_lang", "lang_total", "v")).where("p > q")
    term_rows = above.select("lang", "source", F.col("term").alias("item"), _value("p", "q").alias("value"))
    return _ranked(pair_rows, "pair").union(_ranked(term_rows, "term").where(F.col("rank") <= top))
