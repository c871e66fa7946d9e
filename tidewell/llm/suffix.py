"""Repeated-substring removal with two-stage suffix sorting.

A byte goes when a string of `length` bytes that covers it also starts earlier:
in a document with a smaller doc_id, or earlier in the same document. Different
texts of one doc_id, or of none, are documents in the order of a hash of theirs. Strings
are judged on the input and never cross documents.

Texts may have any length; a task holds one whole text of a batch at a time.
`length` is at most 50,000.

1. Every window of `length` bytes is keyed by the least hash among its k-grams,
   so equal windows have equal keys. Consecutive windows keyed by the same
   k-gram form a *run*; a run is sent on as 38 bytes. Of equal runs all but the first are
   covered at once, within a task before the shuffle and within a key after it.
2. Keys that still hold different runs need the bytes. They are suffix-sorted
   in bounded batches: suffixes that are smaller than their successor are
   sorted directly, the others are induced from them by scanning the buckets of
   first bytes, and the common prefixes of neighbours then show equal windows.
   A key with very many different runs is settled by exact grouping of its
   windows instead, so no task holds an unbounded key.
3. Covered ranges are joined to the texts and cut out.

Null text is empty. doc_id and a hash of the text name a document: rows that
repeat both get equal results. Results do not depend on the order or partitioning of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .flat import mix, prefix_sums, row_runs, span_hash, text_bytes
from .shared import cut, give_back, identified, members_of, restored, trimmed

#: Different runs of one key from which its windows are grouped one by one.
WIDE_KEY = 20_000
#: Bytes that are suffix-sorted at once, unless one key has more.
SORT_BYTES = 1 << 19


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def window_runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Row, start in the row, window count, key and content hash of each run."""
    if len(data) < length:
        return None
    sums = prefix_sums(data)
    at = np.arange(len(data) - gram + 1)
    grams = span_hash(sums, at, at + gram)
    # the position in the low bits lets the leftmost of equal grams win
    low = np.uint64(len(grams).bit_length())
    anchor = sliding_min(grams >> low << low | at.astype(np.uint64), length - gram + 1) & ((np.uint64(1) << low) - np.uint64(1))
    n = len(anchor)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    inside = np.arange(n) + length <= offsets[row + 1]
    new = np.ones(n, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    heads = np.flatnonzero(new & inside)
    if not len(heads):
        return None
    stop = np.append(np.flatnonzero(new | ~inside), n)
    count = stop[np.searchsorted(stop, heads, "right")] - heads
    content = span_hash(sums, heads, heads + count + (length - 1))
    return row[heads], heads - offsets[row[heads]], count, grams[anchor[heads].astype(np.int64)], content


def first_of_equal(content: np.ndarray, doc: np.ndarray, tag: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first run of each content, and of the runs that an earlier one covers."""
    order = np.argsort(content, kind="stable")
    same = content[order][1:] == content[order][:-1]
    if not same.any():
        return order, order[:0]
    tied = np.zeros(len(order), bool)
    tied[1:] |= same
    tied[:-1] |= same
    single, order = order[~tied], order[tied]
    order = order[np.lexsort((start[order], tag[order], doc[order], content[order]))]
    head = np.ones(len(order), bool)
    head[1:] = content[order][1:] != content[order][:-1]
    first = order[head][np.cumsum(head) - 1]
    later = ~head & ((doc[order] != doc[first]) | (tag[order] != tag[first]) | (start[order] != start[first]))
    return np.concatenate([single, order[head]]), order[later]


def big_endian_words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one integer; zeros follow the text."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out |= padded[k : k + len(text)] << np.uint64(56 - 8 * k)
    return out


def sort_directly(words: np.ndarray, positions: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the `depth` bytes that follow each."""
    out, active, group = positions.copy(), np.arange(len(positions)), np.zeros(len(positions), np.int64)
    for step in range(0, depth, 8):
        if not len(active):
            break
        spot = out[active] + step
        key = np.where(spot < len(words), words[np.minimum(spot, len(words) - 1)], np.uint64(0))
        order = np.lexsort((key, group))
        out[active] = out[active][order]
        key = key[order]
        new = np.ones(len(active), bool)
        new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        group = np.cumsum(new)
        tied = ~new
        tied[:-1] |= ~new[1:]
        active, group = active[tied], group[tied]
    return out


def suffix_array(text: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of at least their first `depth` bytes, by two-stage sorting."""
    n = len(text)
    following = np.append(text[1:].astype(np.int16), -1)
    differs = np.flatnonzero(text != following)
    settle = differs[np.searchsorted(differs, np.arange(n))]
    larger = text[settle] > following[settle]  # than the successor: to be induced
    direct = sort_directly(words, np.flatnonzero(~larger), depth)
    starts = np.searchsorted(text[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    result = []

    def induce(scanned: np.ndarray, byte: int) -> np.ndarray:
        before = scanned[scanned > 0] - 1
        before = before[larger[before]]
        first = text[before]
        own = before[first == byte]
        before, first = before[first != byte], first[first != byte]
        if len(before):
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            cuts = np.flatnonzero(np.diff(first)) + 1
            for piece in np.split(before, cuts):
                induced[text[piece[0]]].append(piece)
        return own

    if n:
        induced[text[n - 1]].append(np.array([n - 1]))  # before the end of the text
    for byte in range(256):
        if induced[byte]:
            scan = np.concatenate(induced[byte])
            while len(scan):
                result.append(scan)
                scan = induce(scan, byte)
        if len(tail := direct[starts[byte] : starts[byte + 1]]):
            result.append(tail)
            induce(tail, byte)
    return np.concatenate(result) if result else np.zeros(0, np.int64)


def common_prefixes(words: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in order, `most` at most."""
    out = np.zeros(len(order), np.int64)
    active = np.arange(1, len(order))
    for step in range(0, most, 8):
        a, b = order[active - 1] + step, order[active] + step
        ok = (a < len(words)) & (b < len(words))
        active, a, b = active[ok], a[ok], b[ok]
        differing = words[a] ^ words[b]
        whole = differing == 0
        part = active[~whole]
        if len(part):
            top = differing[~whole]
            shared = np.zeros(len(part), np.int64)
            for k in range(1, 8):
                shared += top < np.uint64(1 << (64 - 8 * k))
            out[part] = step + shared
        active = active[whole]
        out[active] = step + 8
    return np.minimum(out, most)


def covered_windows(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, segments: list[bytes], length: int):
    """(doc, tag, start, count) of windows in the segments of which an equal one comes earlier."""
    text = np.frombuffer(b"".join(segments), np.uint8)
    sizes = np.array([len(s) for s in segments], np.int64)
    words = big_endian_words(text)
    order = suffix_array(text, words, length)
    group = np.cumsum(common_prefixes(words, order, length) < length)
    owner = np.repeat(np.arange(len(segments)), sizes)
    inner = np.arange(len(text)) - (np.cumsum(sizes) - sizes)[owner]
    whole = (inner + length <= sizes[owner])[order]
    order, group = order[whole], group[whole]
    tied = np.zeros(len(order), bool)
    same = group[1:] == group[:-1]
    tied[1:] |= same
    tied[:-1] |= same
    order, group = order[tied], group[tied]
    where, docs, tags = start[owner[order]] + inner[order], doc[owner[order]], tag[owner[order]]
    rank = np.lexsort((where, tags, docs, group))
    order, group, where, docs, tags = order[rank], group[rank], where[rank], docs[rank], tags[rank]
    head = np.ones(len(order), bool)
    head[1:] = group[1:] != group[:-1]
    first = np.flatnonzero(head)[np.cumsum(head) - 1] if len(order) else np.zeros(0, np.int64)
    hit = np.sort(order[(docs != docs[first]) | (tags != tags[first]) | (where != where[first])])
    new = np.ones(len(hit), bool)
    new[1:] = (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]])
    heads = np.flatnonzero(new)
    return doc[owner[hit[heads]]], tag[owner[hit[heads]]], start[owner[hit[heads]]] + inner[hit[heads]], np.diff(np.append(heads, len(hit)))


_RUN = "doc_id long, tag long, start int, count int, content long, key long, wide boolean"


def _matched_runs(docs: DataFrame, length: int, gram: int, flush: int = 1 << 19) -> DataFrame:
    """Covered runs (key null) and the runs whose key holds other contents too."""
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ("key", "content", "doc", "tag", "start", "count")
    kinds = (np.uint64, np.uint64, np.int64, np.int64, np.int32, np.int16)

    def emit(batches):
        held, size = [], 0

        def flushed():
            column = {name: np.concatenate([h[k] for h in held]) for k, name in enumerate(names)}
            first, later = first_of_equal(column["content"], column["doc"], column["tag"], column["start"])
            take = np.concatenate([first, later])
            column = {name: a[take] for name, a in column.items()}
            done = np.arange(len(take)) >= len(first)
            bucket = (mix(column["key"]) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            where = np.searchsorted(bucket[order], np.arange(buckets + 1))
            ids, blobs = [], []
            for k in np.flatnonzero(np.diff(where)):
                pick = order[where[k] : where[k + 1]]
                ids.append(int(k))
                blobs.append(b"".join(column[name][pick].tobytes() for name in names) + done[pick].tobytes())
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

        for batch in batches:
            ids, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "tag"))
            data, offsets = text_bytes(batch.column("text"))
            for lo, hi in row_runs(offsets):
                found = window_runs(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], length, gram)
                if found:
                    row, start, count, key, content = found
                    held.append((key, content, ids[lo + row], tags[lo + row], start.astype(np.int32), count.astype(np.int16)))
                    size += len(row)
                if size >= flush:
                    yield flushed()
                    held, size = [], 0
        if held:
            yield flushed()

    def match(table: pa.Table) -> pa.Table:
        parts: dict[str, list] = {name: [] for name in (*names, "done")}
        for blob in table.column("blob"):
            blob, at = blob.as_py(), 0
            n = len(blob) // 39
            for name, kind in zip((*names, "done"), (*kinds, np.bool_)):
                parts[name].append(np.frombuffer(blob, kind, n, at))
                at += n * np.dtype(kind).itemsize
        column = {name: np.concatenate(a) for name, a in parts.items()}
        done = column.pop("done")
        out = [(column["doc"][done], column["tag"][done], column["start"][done], column["count"][done], column["content"][done], None, None)]
        column = {name: a[~done] for name, a in column.items()}
        first, later = first_of_equal(column["content"], column["doc"], column["tag"], column["start"])
        out.append((column["doc"][later], column["tag"][later], column["start"][later], column["count"][later], column["content"][later], None, None))
        first = first[np.argsort(column["key"][first], kind="stable")]
        key = column["key"][first]
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(heads, len(key)))
        sizes = np.repeat(sizes, sizes)
        open_ = first[sizes > 1]
        out.append((column["doc"][open_], column["tag"][open_], column["start"][open_], column["count"][open_], column["content"][open_], column["key"][open_].view(np.int64), sizes[sizes > 1] > WIDE_KEY))

        def joined(k, kind):
            return pa.concat_arrays([pa.nulls(len(o[0]), kind) if o[k] is None else pa.array(o[k].view(np.int64) if o[k].dtype == np.uint64 else o[k]).cast(kind) for o in out])

        return pa.table({"doc_id": joined(0, pa.int64()), "tag": joined(1, pa.int64()), "start": joined(2, pa.int32()), "count": joined(3, pa.int32()), "content": joined(4, pa.int64()), "key": joined(5, pa.int64()), "wide": joined(6, pa.bool_())})

    return docs.mapInArrow(trimmed(emit), "bucket int, blob binary").groupBy("bucket").applyInArrow(match, _RUN)


def covered_ranges(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, tag, start, count): windows of docs(doc_id, tag, text) that occur earlier."""
    if not 1 <= length <= 50_000:
        raise ValueError("length must be from 1 to 50,000 bytes: runs tell their windows in 16 bits")
    gram = max(1, length * 36 // 100)
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = cut(_matched_runs(docs, length, gram))
    asked = runs.where("key is not null").groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "count", "key", "wide")).alias("asked"))
    wanted = members_of(asked, "tag")

    def pick(batches):
        for batch in batches:
            yield batch.filter(pa.array(wanted(batch.column("tag"))))

    def segments(batches):
        for batch in batches:
            out = [[], [], [], [], [], []]
            for doc, tag, text, asks in zip(batch.column("doc_id").to_pylist(), batch.column("tag").to_pylist(), batch.column("text").to_pylist(), batch.column("asked").to_pylist()):
                raw = (text or "").encode()
                for ask in asks:
                    end = ask["start"] + ask["count"] + length - 1
                    if end <= len(raw):
                        for column, value in zip(out, (doc, tag, ask["start"], ask["key"], ask["wide"], raw[ask["start"] : end])):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.bool_()), pa.array(out[5], pa.binary())], ["doc_id", "tag", "start", "key", "wide", "bytes"])

    texts = docs.mapInArrow(trimmed(pick), docs.schema).join(asked, ["doc_id", "tag"])
    pieces = cut(texts.mapInArrow(trimmed(segments), "doc_id long, tag long, start int, key long, wide boolean, bytes binary"))

    def sort(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        key = table.column("key").to_numpy()
        doc, tag, start = table.column("doc_id").to_numpy(), table.column("tag").to_numpy(), table.column("start").to_numpy().astype(np.int64)
        held = [b.as_py() for b in table.column("bytes")]
        ends = np.cumsum([len(b) for b in held])
        stops = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))  # a batch holds whole keys
        out, lo = [], 0
        while lo < len(key):
            k = np.searchsorted(ends[stops - 1], (ends[lo - 1] if lo else 0) + SORT_BYTES, "right") - 1
            hi = int(stops[max(k, np.searchsorted(stops, lo, "right"))])
            out.append(covered_windows(doc[lo:hi], tag[lo:hi], start[lo:hi], held[lo:hi], length))
            lo = hi
        give_back()
        return pa.table({"doc_id": np.concatenate([o[0] for o in out]), "tag": np.concatenate([o[1] for o in out]), "start": np.concatenate([o[2] for o in out]).astype(np.int32), "count": np.concatenate([o[3] for o in out]).astype(np.int32)})

    def windows(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("bytes").cast(pa.large_binary()))
            docs_, tags, starts = batch.column("doc_id").to_numpy(), batch.column("tag").to_numpy(), batch.column("start").to_numpy()
            for lo, hi in row_runs(offsets):
                part, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                counts = np.diff(off) - length + 1
                row = np.repeat(np.arange(hi - lo), counts)
                inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                at = off[row] + inner
                yield pa.RecordBatch.from_arrays([pa.array(span_hash(prefix_sums(part), at, at + length).view(np.int64)), pa.array(docs_[lo + row]), pa.array(tags[lo + row]), pa.array((starts[lo + row] + inner).astype(np.int32))], ["window", "doc_id", "tag", "start"])

    sorted_ = pieces.where("not wide").groupBy(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")).applyInArrow(sort, "doc_id long, tag long, start int, count int")
    each = pieces.where("wide").mapInArrow(windows, "window long, doc_id long, tag long, start int")
    firsts = each.groupBy("window").agg(F.min(F.struct("doc_id", "tag", "start")).alias("first"))
    later = each.join(firsts, "window").where("struct(doc_id, tag, start) <> first").select("doc_id", "tag", "start", F.lit(1).alias("count"))
    return cut(runs.where("key is null").select("doc_id", "tag", "start", "count").union(sorted_).union(later))


def without_repeats(docs: DataFrame, length: int = 100, carry: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """docs(doc_id, text, *carry) → doc_id, row (the carried columns), n_bytes, n_removed, n_spans, kept.

    kept is bytes, or with as_text a string without characters that a cut broke.
    """
    base = identified(docs, F.xxhash64("text").alias("tag"), "text", F.struct(F.lit(1).alias("_"), *carry).alias("row"))
    narrow = base.select("doc_id", "tag", "text")
    covered = covered_ranges(narrow, length).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "count")).alias("ranges"))
    touched = members_of(covered, "tag")

    def keep(text: str | None, ranges):
        raw = (text or "").encode()
        if not ranges:
            return len(raw), 0, 0, raw
        starts, counts = np.array([(r["start"], r["count"]) for r in ranges], np.int64).T
        step = np.zeros(len(raw) + 1, np.int64)
        np.add.at(step, starts, 1)
        np.add.at(step, np.minimum(starts + counts + length - 1, len(raw)), -1)
        gone = np.cumsum(step[:-1]) > 0
        return len(raw), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()), np.frombuffer(raw, np.uint8)[~gone].tobytes()

    def finish(batches):
        for batch in batches:
            if "ranges" not in batch.schema.names:
                batch = batch.filter(pa.array(~touched(batch.column("tag"))))
            ranges = batch.column("ranges").to_pylist() if "ranges" in batch.schema.names else [None] * len(batch)
            done = [keep(t, r) for t, r in zip(batch.column("text").to_pylist(), ranges)]
            if as_text:
                done = [(*d[:3], d[3].decode("utf-8", "ignore")) for d in done]
            columns = [pa.array([d[k] for d in done], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string() if as_text else pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), *columns], ["doc_id", "row", "n_bytes", "n_removed", "n_spans", "kept"])

    def maybe(batches):
        for batch in batches:
            yield batch.filter(pa.array(touched(batch.column("tag"))))

    schema = T.StructType([T.StructField("doc_id", T.LongType()), base.schema["row"], *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.StringType() if as_text else T.BinaryType())])
    changed = base.mapInArrow(trimmed(maybe), base.schema).join(covered, ["doc_id", "tag"], "left").mapInArrow(trimmed(finish), schema)
    same = base.mapInArrow(trimmed(finish), schema)
    return changed.union(same)


def repeat_report(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row."""
    return without_repeats(docs, length).select(restored(), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
