"""N-gram Jaccard join by T-occurrence search (DivideSkip).

Two texts link when `100 * |A & B| >= percent * |A | B|` over their sets of
distinct n-word shingles. Equal sets are one *class*; all work is done on
classes, so a group of exact copies costs one member.

1. Inverted lists: shingles are cut to tokens and each token's list of classes
   is formed in one of a number of buckets that follows the number of shingles.
   Only tokens of two classes or more go on. A class that links must share
   `percent` of its shingles, so of its tokens, ordered by the length of their
   lists, the first `n - T + 1` hold one that the other class has among its own
   first. A class's unshared tokens come first in that order and need no list:
   most classes have too few shared tokens and end here. Classes on one of the
   lists left form a candidate neighbourhood, by one edge for each list member
   and no pairs. Tokens on more lists than one class in 512 are not listed in a
   bucket: they come last in the order and are told apart by class.
2. Inside a neighbourhood (in blocks of bounded weight, each with the pivots of
   its neighbourhood; blocks meet only where several components are left, after
   another cut by ranges of the hash space) DivideSkip finds the
   links: of a query's inverted lists, the T - 1 longest are set aside, the
   short ones are heap-merged, and each text met there is counted up in the
   long lists by binary probes until it reaches the required overlap T or can
   no longer do so. Texts already in the query's component are not asked again.
3. Components of the links are labelled with their smallest doc_id.

Shingles are 64-bit hashes. Null or blank texts have no shingles, link with
nothing and are their own component. Rows that repeat a doc_id are one
document's rows and get that document's component; a null doc_id is kept as
null. Ties need no rule: the answer is a set property. A text of any length is
read whole; its shingles (8 bytes a word) must fit a task.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import LOWER, mix, prefix_sums, row_runs, span_hash, text_bytes, word_spans
from .shared import connected_components, cut, give_back, identified, members_of, restored, trimmed

#: Shingles of one side of a verification block (8 bytes each), and of one bucket of inverted lists.
BLOCK_SHINGLES, BUCKET_SHINGLES = 1 << 18, 1 << 20
#: Shingles that a task holds before it sends them on.
HELD_SHINGLES = 1 << 19
#: A shingle is frequent when more than one class in so many has it, and more than one shingle in so many is it: at most 2 MiB of them.
FREQUENT_CLASSES, FREQUENT_SHINGLES = 512, 1 << 18
#: Neighbourhoods (8 bytes each) up to which their names are broadcast; more are joined by a shuffle.
BROADCAST_ROOTS = 1 << 16
#: Stands for the length of a frequent token's list.
_LAST = np.uint16(65535)

_FACTORS = mix(np.arange(1, 65, dtype=np.uint64))


def shingle_sets(column: pa.Array, words: int):
    """The sorted distinct shingle hashes of each text, in row order."""
    data, offsets = text_bytes(column)
    for lo, hi in row_runs(offsets):
        part = LOWER[data[offsets[lo] : offsets[hi]]]
        starts, ends, bounds = word_spans(part, offsets[lo : hi + 1] - offsets[lo])
        hashes = span_hash(prefix_sums(part), starts, ends)
        count = len(hashes) - words + 1
        if count > 0:
            rolled = hashes[:count] * _FACTORS[0]
            for k in range(1, words):
                rolled = rolled + hashes[k : k + count] * _FACTORS[k]
            rolled = mix(rolled)
        for i in range(hi - lo):
            a, z = bounds[i], bounds[i + 1]
            if z - a >= words:
                yield np.unique(rolled[a : z - words + 1])
            elif z > a:
                short = hashes[a:z] * _FACTORS[8 : 8 + z - a]
                yield mix(short.sum(keepdims=True) + _FACTORS[32 + z - a])
            else:
                yield hashes[:0]


def class_id(shingles: np.ndarray) -> int:
    """A signed 64-bit id of a shingle set; 0 is never returned."""
    return (xxhash.xxh64_intdigest(shingles.tobytes(), len(shingles)) - (1 << 63)) or 1


class Parts:
    """Signatures such that two linking sets share at least one."""

    def __init__(self, percent: int):
        self.percent, self.tops = percent, [0]
        self.cuts: dict[int, np.ndarray] = {}

    def top(self, level: int) -> int:
        while len(self.tops) <= level:
            self.tops.append(max(self.tops[-1] + 1, self.tops[-1] * 100 // self.percent))
        return self.tops[level]

    def level(self, size: int) -> int:
        k = 1
        while self.top(k) < size:
            k += 1
        return k

    def signatures(self, shingles: np.ndarray) -> np.ndarray:
        """A linking pair has sizes of one level or of neighbouring ones: each set joins the families of its own level and of the one below."""
        out = []
        own = self.level(len(shingles))
        sums = np.zeros(len(shingles) + 1, np.uint64)
        np.cumsum(mix(shingles), out=sums[1:])
        for family in (own - 1, own):
            most = self.top(family) * (100 - self.percent) // self.percent if family else 0
            if not most:  # sets of this family link only when equal
                continue
            spare = (35 * (most + 1) + 99) // 100
            n = most + 1 + spare
            if n not in self.cuts:
                self.cuts[n] = np.array([(k << 64) // n for k in range(1, n)], np.uint64)
            bounds = np.concatenate([[0], np.searchsorted(shingles, self.cuts[n]), [len(shingles)]])
            sizes = np.diff(bounds)
            least = np.partition(sizes, spare)[spare]  # at most `spare` parts are smaller
            keep = np.flatnonzero(sizes >= least)
            out.append(mix((sums[bounds[keep + 1]] - sums[bounds[keep]]) ^ mix(keep.astype(np.uint64) + np.uint64(family << 32))))
        return np.concatenate(out) if out else shingles[:0]


_CLASSES = "doc_id long, text_id long, n_shingles long, class_id long, often binary"


def shingle_classes(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, text_id, n_shingles, class_id, often): equal sets share a class; it is null for an empty set.

    Rows with `often` are no documents: they tell shingles that many classes of
    a task have, and how many (see `frequent_shingles`).
    """
    names = ["doc_id", "text_id", "n_shingles", "class_id", "often"]

    def run(batches):
        held, size, classes = [], 0, set()

        def told():
            shingles, counts = np.unique(np.concatenate(held), return_counts=True)
            pick = counts >= max(4, len(classes) / FREQUENT_CLASSES)
            blob = shingles[pick].tobytes() + counts[pick].astype(np.int64).tobytes()
            return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 4 + [pa.array([blob], pa.binary())], names)

        for batch in batches:
            counts, ids = [], []
            for shingles in shingle_sets(batch.column("text"), words):
                own = class_id(shingles) if len(shingles) else None
                counts.append(len(shingles))
                ids.append(own)
                if own and own not in classes:
                    classes.add(own)
                    held.append(shingles)
                    size += len(shingles)
                if size >= HELD_SHINGLES:
                    yield told()
                    held, size, classes = [], 0, set()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.int64()), pa.nulls(len(batch), pa.binary())], names)
        if held:
            yield told()

    return identified(docs, "text", F.xxhash64("text").alias("text_id")).mapInArrow(trimmed(run), _CLASSES)


def frequent_shingles(classes: DataFrame, documents: int, total: int) -> np.ndarray:
    """Shingles that very many classes have, sorted.

    Every shingle of more than one class in FREQUENT_CLASSES / 2 is among them, but for 4
    classes a task and flush. Any set would do for right results: this one bounds the lists.
    """
    def apart(batches):
        for batch in batches:
            blobs = [b.as_py() for b in batch.column(0)]
            both = [(np.frombuffer(b, np.int64, len(b) // 16), np.frombuffer(b, np.int64, len(b) // 16, len(b) // 2)) for b in blobs]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in both])) for k in (0, 1)], ["shingle", "n"])

    told = classes.where("often is not null").select("often").mapInArrow(apart, "shingle long, n long")
    least = max(documents / FREQUENT_CLASSES, total / FREQUENT_SHINGLES)
    found = told.groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") > F.lit(float(least))).select("shingle").toArrow()
    return np.sort(found.column("shingle").to_numpy().view(np.uint64))


def _tokens_of(shingles: np.ndarray, bits: int) -> np.ndarray:
    """The first 32 + bits bits of sorted shingles, each once."""
    tokens = shingles >> np.uint64(32 - bits)
    return tokens[np.append(True, tokens[1:] != tokens[:-1])] if len(tokens) else tokens


def _dealt(bucket: np.ndarray, columns: list[np.ndarray]):
    """(bucket, columns of its rows) of each bucket that has rows."""
    order = np.argsort(bucket, kind="stable")
    columns = [c[order] for c in columns]
    heads = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1])) if len(order) else order
    for a, z in zip(heads, [*heads[1:], len(order)]):
        yield int(bucket[order[a]]), [c[a:z] for c in columns]


def _packed(columns: list[np.ndarray]) -> bytes:
    return len(columns[0]).to_bytes(8, "little") + b"".join(c.tobytes() for c in columns)


def _unpacked(blobs, kinds) -> list[np.ndarray]:
    """The columns of all blobs that `_packed` made, one after the other; a blob may hold several parts of these kinds."""
    out: list[list[np.ndarray]] = [[] for _ in kinds]
    for blob in blobs:
        n, at = int.from_bytes(blob[:8], "little"), 8
        for column, kind in zip(out, kinds):
            column.append(np.frombuffer(blob, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(c) if c else np.zeros(0, k) for c, k in zip(out, kinds)]


#: What a flush tells of its texts: class, n shingles, distinct tokens; and of their frequent tokens: place in the flush, token.
_KNOWN, _OFTEN = (np.int64, np.int64, np.int64), (np.uint16, np.uint64)
#: Rows of one bucket of tokens that come from one flush: token without its bucket, place of its text in the flush.
_LISTED = (np.uint32, np.uint16)
#: The same on the way back to the flush, with the length of the token's list.
_SENT = (np.uint32, np.uint16, np.uint16)
#: The bucket of rows that only pass through on their way to a flush.
_PASSING = -1


def candidate_lists(docs: DataFrame, frequent: np.ndarray, owners: DataFrame, documents: int, total: int, words: int, percent: int) -> DataFrame:
    """(token, node): inverted lists such that two linking classes (nodes) are together on one at least.

    A text is known by its place in what a task sends at once (a *flush*, known by
    a hash of its content, so a repeated task sends it under the same name) and
    not by the 8 bytes of its class: a token takes 6 bytes on its way to its
    bucket and 8 back to the flush, whatever the number of buckets. `owners(key)`
    tells one row of each class by `_row_key`; a class of which several rows get
    through is on its lists several times, which changes nothing but their length.
    """
    bits = min(24, max(6, int(total // BUCKET_SHINGLES).bit_length()))
    shared = docs.sparkSession.sparkContext.broadcast(_tokens_of(frequent, bits))
    chosen = members_of(owners, "key", documents)
    names = ["bucket", "flush", "listed", "known", "often"]

    def emit(batches):
        often, seen = shared.value, set()
        held: list[tuple[int, int, np.ndarray]] = []
        size = 0

        def flushed():
            known = [np.array([h[k] for h in held], np.int64) for k in (0, 1)] + [np.array([len(t) for _, _, t in held], np.int64)]
            flush = class_id(np.concatenate(known))
            tokens, place = np.concatenate([t for _, _, t in held]), np.repeat(np.arange(len(held), dtype=np.uint16), known[2])
            spot = np.searchsorted(often, tokens)
            last = often[np.minimum(spot, len(often) - 1)] == tokens if len(often) else np.zeros(len(tokens), bool)
            rows = [(bucket, _packed(columns)) for bucket, columns in _dealt((tokens[~last] >> np.uint64(32)).astype(np.uint32), [tokens[~last].astype(np.uint32), place[~last]])]
            # frequent tokens and the texts' sizes only pass through
            ids = [bucket for bucket, _ in rows] + [flush % (1 << bits)]
            blobs = [blob for _, blob in rows] + [None]
            passing = [[None] * len(rows) + [_packed(columns)] for columns in (known, [place[last], tokens[last]])]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array([flush] * len(ids), pa.int64()), *(pa.array(b, pa.binary()) for b in (blobs, *passing))], names)

        for batch in batches:
            wanted = np.flatnonzero(chosen(batch.column("key")))
            for shingles in shingle_sets(batch.column("text").take(pa.array(wanted, pa.int64())), words):
                own = class_id(shingles) if len(shingles) else 0
                if own and own not in seen:  # copies met in this task are skipped
                    if len(seen) < 1 << 20:
                        seen.add(own)
                    held.append((own, len(shingles), _tokens_of(shingles, bits)))
                    size += len(shingles)
                if size >= HELD_SHINGLES or len(held) == 1 << 16:
                    yield flushed()
                    held, size = [], 0
        if held:
            yield flushed()

    def listed(table: pa.Table) -> pa.Table:
        """Tokens of two texts or more, with the length of their lists, for the flushes of the texts."""
        bucket = table.column("bucket")[0].as_py()
        flushes = table.column("flush").to_numpy()
        blobs = [(f, b.as_py()) for f, b in zip(flushes.tolist(), table.column("listed")) if b.is_valid]
        token, place = _unpacked((b for _, b in blobs), _LISTED)
        ids, ordinal = np.unique(np.array([f for f, _ in blobs], np.int64), return_inverse=True)
        own = np.repeat(ordinal.astype(np.int64) << 16, [int.from_bytes(b[:8], "little") for _, b in blobs]) | place
        del place
        order = np.argsort(token, kind="stable")
        token, own = token[order], own[order]
        tied = np.zeros(len(token), bool)
        same = token[1:] == token[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        token, own = token[tied], own[tied]
        order = np.lexsort((own, token))  # equal flushes are one
        token, own = token[order], own[order]
        once = np.append(True, (token[1:] != token[:-1]) | (own[1:] != own[:-1])) if len(token) else np.zeros(0, bool)
        token, own = token[once], own[once]
        _, where, lengths = np.unique(token, return_inverse=True, return_counts=True)
        lengths = lengths[where]
        keep = lengths > 1
        sent = [token[keep], (own[keep] & 65535).astype(np.uint16), np.minimum(lengths[keep], 65534).astype(np.uint16)]
        rows = [(int(ids[k]), bucket, _packed(columns), None) for k, columns in _dealt(own[keep] >> 16, sent)]
        for flush, known, often in zip(flushes.tolist(), table.column("known"), table.column("often")):
            if known.is_valid:
                rows.append((flush, _PASSING, known.as_py(), often.as_py()))
        give_back()
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
        return pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(zip(("flush", "bucket", "blob", "often"), kinds))})

    def first(table: pa.Table) -> pa.Table:
        """Of each text of a flush that has enough shared tokens, those among its first n - T + 1."""
        rows = sorted(zip(table.column("bucket").to_pylist(), table.column("blob").to_pylist(), table.column("often").to_pylist()), key=lambda r: r[0])
        told = next(r for r in rows if r[0] == _PASSING)  # equal flushes tell the same
        ids, n, distinct = _unpacked([told[1]], _KNOWN)
        often, last = _unpacked([told[2]], _OFTEN)
        sent = [r for r in rows if r[0] != _PASSING]
        low, place, length = _unpacked((r[1] for r in sent), _SENT)
        high = np.repeat(np.array([r[0] for r in sent], np.uint64) << np.uint64(32), [int.from_bytes(r[1][:8], "little") for r in sent])
        token, where, length = np.concatenate([high | low, last]), np.concatenate([place, often]).astype(np.int64), np.concatenate([length, np.full(len(last), _LAST)])
        order = np.lexsort((token, length, where))
        shared = np.bincount(where, minlength=len(ids))
        take = n + 1 - -(-percent * n // 100) - (distinct - shared)
        rank = np.arange(len(order)) - (np.cumsum(shared) - shared)[where[order]]
        order = order[rank < take[where[order]]]
        return pa.table({"token": token[order].view(np.int64), "node": ids[where[order]]})

    texts = identified(docs, "text", F.xxhash64("text").alias("text_id")).select("text", _row_key())
    sent = texts.mapInArrow(trimmed(emit), "bucket int, flush long, listed binary, known binary, often binary")
    dealt = sent.groupBy("bucket").applyInArrow(listed, "flush long, bucket int, blob binary, often binary")
    return dealt.groupBy("flush").applyInArrow(first, "token long, node long").distinct()


def _row_key():
    """A hash of a row's id and text, as column `key`."""
    return F.xxhash64("doc_id", "text_id").alias("key")


def candidate_edges(lists: DataFrame) -> DataFrame:
    """An edge (a, b) from each class of a list to the list's least class."""
    hubs = lists.groupBy("token").agg(F.min("node").alias("a"), F.max("node").alias("most")).where("a <> most").select("token", "a")
    return lists.join(hubs, "token").where("a <> node").select("a", F.col("node").alias("b")).distinct()


def _signature_rows(sets, buckets: int, percent: int, salt: int = 0, flush: int = 1 << 19):
    """(bucket, blob) batches from (class, neighbourhood, shingles): signatures and their classes by bucket."""
    parts, held, size = Parts(percent), [], 0

    def flushed():
        sig, own = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        bucket = (mix(sig) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        where = np.searchsorted(bucket[order], np.arange(buckets + 1))
        ids, blobs = [], []
        for k in np.flatnonzero(np.diff(where)):
            pick = order[where[k] : where[k + 1]]
            ids.append(int(k))
            blobs.append(sig[pick].tobytes() + own[pick].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    for own, root, shingles in sets:
        if salt:  # other ranges of the same shingles, within the neighbourhood alone
            shingles = np.sort(mix(shingles ^ np.uint64(salt)))
        sig = parts.signatures(shingles)
        if len(sig):
            held.append((sig ^ mix(np.full(1, root, np.int64).view(np.uint64)), np.full(len(sig), own, np.int64)))
            size += len(sig)
        if size >= flush:
            yield flushed()
            held, size = [], 0
    if held:
        yield flushed()


def _stars(table: pa.Table) -> pa.Table:
    """An edge from each class of a list to the list's least class."""
    blobs = [b.as_py() for b in table.column("blob")]
    sig = np.concatenate([np.frombuffer(b, np.uint64, len(b) // 16) for b in blobs])
    own = np.concatenate([np.frombuffer(b, np.int64, len(b) // 16, len(b) // 2) for b in blobs])
    order = np.argsort(sig, kind="stable")
    sig, own = sig[order], own[order]
    first = np.ones(len(sig), bool)
    first[1:] = sig[1:] != sig[:-1]
    heads = np.flatnonzero(first)
    hub = np.minimum.reduceat(own, heads)[np.cumsum(first) - 1]
    far = own != hub
    edges = np.unique(np.stack([hub[far], own[far]], 1), axis=0) if far.any() else np.zeros((0, 2), np.int64)
    return pa.table({"a": edges[:, 0], "b": edges[:, 1]})


def refined(rest: DataFrame, percent: int, salt: int) -> DataFrame:
    """(node, root) of rest(node, root, weight, shingles) after its neighbourhoods are cut again by other ranges.

    Two linking classes share a range under any choice of ranges, so they stay
    together, while classes that only chance had put on one list part. Classes
    left alone link with nothing and get no row.
    """
    buckets = 1 + rest.agg(F.sum("weight").alias("n")).first().n // BUCKET_SHINGLES

    def emit(batches):
        def sets():
            for batch in batches:
                for node, root, blob in zip(*(batch.column(c).to_pylist() for c in ("node", "root", "shingles"))):
                    yield node, root, np.frombuffer(blob, np.uint64)

        yield from _signature_rows(sets(), buckets, percent, salt)

    edges = rest.select("node", "root", "shingles").mapInArrow(emit, "bucket int, blob binary").groupBy("bucket").applyInArrow(_stars, "a long, b long").distinct()
    return connected_components(edges)


def overlap_needed(a: int, b: int, percent: int) -> int:
    return -(-percent * (a + b) // (100 + percent))


def divide_skip(sets: list[np.ndarray], left: np.ndarray | None, percent: int, joined: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that join the sets' components; with `left` only across the two sides.

    A link inside a component that is already joined (`joined`: labels known
    before) is not looked for: the components are the same with it.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    tokens, codes = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(sizes)])
    order = np.argsort(codes, kind="stable")
    members = np.repeat(np.arange(n), sizes)[order]  # inverted lists, each in set order
    lists = np.searchsorted(codes[order], np.arange(len(tokens) + 1))
    lengths = np.diff(lists)
    root = np.arange(n) if joined is None else np.unique(joined, return_inverse=True)[1]
    links = []
    for i in range(n):
        own = codes[at[i] : at[i + 1]]
        least = -(-percent * len(own) // 100)
        ranked = own[np.argsort(lengths[own], kind="stable")]
        short, long = ranked[: len(own) - least + 1], np.sort(ranked[len(own) - least + 1 :])
        runs = []
        for token in short.tolist():
            run = members[lists[token] : lists[token + 1]]
            run = run[: np.searchsorted(run, i)]
            if len(run):
                run = run[root[run] != root[i]]
                if left is not None and len(run):
                    run = run[left[run] != left[i]]
                if len(run):
                    runs.append(run.tolist())
        if not runs:
            continue
        count, met = 0, -1
        for j in [*heapq.merge(*runs), n]:
            if j == met:
                count += 1
                continue
            if met >= 0 and root[met] != root[i]:
                need = overlap_needed(len(own), int(sizes[met]), percent)
                if 100 * min(len(own), sizes[met]) >= percent * max(len(own), sizes[met]) and count + len(long) >= need:
                    other = codes[at[met] : at[met + 1]]  # sorted: each long list is probed for this text
                    spot = np.searchsorted(other, long)
                    spot[spot == len(other)] = 0
                    if count + int((other[spot] == long).sum()) >= need:
                        links.append((i, met))
                        root[root == max(root[i], root[met])] = min(root[i], root[met])
            count, met = 1, j
    return links


def _in_blocks(weight: str):
    return F.ceil(F.sum(weight) / BLOCK_SHINGLES).cast("int")


def _block_of(blocks: str):
    return F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")


def class_components(docs: DataFrame, classes: DataFrame, neighbourhoods: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, root): components of the links between classes(node, text_id, weight) within neighbourhoods(node, root).

    Only one text of each class is read again. The sets are shuffled by block once. Each block is searched with the pivots
    of its neighbourhood, which join the blocks of one group of near copies.
    What is then one component is settled; only other neighbourhoods go on to
    `_across_blocks`.
    """
    members = cut(neighbourhoods.join(classes, "node"))
    wanted = members_of(members, "text_id", members.count())

    def sets(batches):
        seen = set()
        for batch in batches:
            ids, texts = batch.column("text_id").to_numpy(), batch.column("text")
            pick = []
            for k in np.flatnonzero(wanted(ids)).tolist():
                if ids[k] not in seen:
                    if len(seen) < 1 << 20:
                        seen.add(ids[k])
                    pick.append(k)
            blobs = [(class_id(s), s.tobytes()) for s in shingle_sets(texts.take(pa.array(pick, pa.int64())), words) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([b[0] for b in blobs], pa.int64()), pa.array([b[1] for b in blobs], pa.binary())], ["node", "shingles"])

    # few neighbourhoods have several blocks; the others need no join by their root
    large = members.groupBy("root").agg(_in_blocks("weight").alias("blocks")).where("blocks > 1")
    places = members.join(large, "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    # an eighth of a block, at random, is searched with every block of the neighbourhood
    pivot = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("node", F.lit(1)), 8 * F.col("blocks")) == 0)
    spots = F.when(pivot, F.expr("sequence(0, blocks - 1)")).otherwise(F.array(_block_of("blocks")))
    found = identified(docs, "text", F.xxhash64("text").alias("text_id")).mapInArrow(trimmed(sets), "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))
    stored = cut(found.join(places.select("node", "root", "weight", "blocks", spots.alias("spots")), "node"))

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        return _pairs(pdf["node"].to_numpy(), divide_skip([np.frombuffer(b, np.uint64) for b in pdf["shingles"]], None, percent))

    links = cut(stored.select("root", "node", "shingles", F.explode("spots").alias("i")).groupBy("root", "i").applyInPandas(verify, "a long, b long"))
    groups = cut(connected_components(links))
    several = stored.where("blocks > 1").select("node", "root").join(groups.select("node", F.col("root").alias("part")), "node", "left")
    several = cut(_with_parts(several).select("root"))
    count = several.count()
    if not count:
        return groups
    few = count <= BROADCAST_ROOTS
    rest = stored.join(F.broadcast(several) if few else several, "root", "left_semi").select("node", "root", "weight", "shingles")
    rest = rest if few else cut(rest)  # read several times
    return connected_components(links.union(_across_blocks(rest, groups, percent)))


def _with_parts(rows: DataFrame) -> DataFrame:
    """Roots of rows(node, root, part) that hold several parts; a null part is the node's own."""
    part = F.coalesce("part", "node")
    return rows.groupBy("root").agg(F.min(part).alias("low"), F.max(part).alias("high")).where("low <> high")


def _pairs(nodes: np.ndarray, found: list[tuple[int, int]]) -> pd.DataFrame:
    return pd.DataFrame({"a": [nodes[i] for i, _ in found], "b": [nodes[j] for _, j in found]}, dtype=np.int64)


def _across_blocks(rest: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different known groups in rest(node, root, weight, shingles).

    Neighbourhoods are cut again by other ranges. In each that still holds
    several parts, the heaviest part is not asked: the classes of the others, in
    blocks, meet every block of the neighbourhood.
    """
    known = groups.select("node", F.col("root").alias("part"))
    roots = refined(rest, percent, 0x5851F42D4C957F2D)
    members = cut(roots.join(rest.select("node", "weight"), "node").join(known, "node", "left").withColumn("part", F.coalesce("part", "node")))
    parts = members.groupBy("root", "part").agg(F.sum("weight").alias("w"))
    heaviest = parts.groupBy("root").agg(F.max_by("part", F.struct("w", "part")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    sided = members.join(heaviest, "root").withColumn("asked", F.col("part") != F.col("main"))
    counts = sided.groupBy("root").agg(_in_blocks("weight").alias("blocks"), F.ceil(F.sum(F.when(F.col("asked"), F.col("weight"))) / BLOCK_SHINGLES).cast("int").alias("lanes"))
    sided = sided.join(counts, "root")
    base = sided.select("node", "root", "part", F.lit(False).alias("asked"), F.explode(F.expr("sequence(0, lanes - 1)")).alias("i"), _block_of("blocks").alias("j"))
    asking = sided.where("asked").select("node", "root", "part", "asked", _block_of("lanes").alias("i"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("j"))

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["node", "asked"])
        sets = [np.frombuffer(b, np.uint64) for b in pdf["shingles"]]
        return _pairs(pdf["node"].to_numpy(), divide_skip(sets, pdf["asked"].to_numpy(), percent, pdf["part"].to_numpy()))

    placed = rest.select("node", "shingles").join(base.union(asking), "node")
    return placed.groupBy("root", "i", "j").applyInPandas(verify, "a long, b long")


def jaccard_components(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id, text_id, group_id) for each row of docs(doc_id, text).

    group_id is one number for the documents that links reach from each other, also
    where several texts have one id or none has an id; null for empty sets.
    A task that is repeated must read its rows in the order of its first time, as
    from files; write docs to a table first if they come from a shuffle.
    """
    told = cut(shingle_classes(docs, words))
    classes = told.where("often is null").drop("often")
    documents, total = (int(x or 0) for x in classes.agg(F.count("class_id"), F.sum("n_shingles")).first())
    first = classes.where("class_id is not null").groupBy("class_id").agg(F.min("doc_id").alias("first_id"), F.min("text_id").alias("text_id"), F.min("n_shingles").alias("weight"), F.min(_row_key()).alias("key"))
    lists = cut(candidate_lists(docs, frequent_shingles(told, documents, total), first, documents, total, words, percent))
    neighbourhoods = cut(connected_components(candidate_edges(lists)))
    found = class_components(docs, first.select(F.col("class_id").alias("node"), "text_id", "weight"), neighbourhoods, words, percent)
    groups = found.select(F.col("node").alias("class_id"), "root")
    rooted = first.select("class_id", "first_id").join(groups, "class_id")
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    # only classes that link with others are joined to the rows by component
    linked = rooted.join(smallest, "root").select("class_id", "component_id", "root")
    joined = first.select("class_id", "first_id").join(linked, "class_id", "left")
    labels = joined.select("class_id", F.coalesce("component_id", "first_id").alias("component_id"), F.coalesce("root", "class_id").alias("group_id"))
    out = classes.join(labels, "class_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select(restored(), "n_shingles", restored("component_id"), "class_id", "text_id", "group_id")
