"""Language-model scores: a causal self-attention model over subword ids, beside exact word counts.

Words are encoded by a public byte-pair vocabulary, each with a space before it;
the ids of a text end with one more id, for its end. An id's probability is that
of its class given what came before, from the model, times its share of the
class, from counts. The frequent ids are classes of their own.

The model is one causal attention head over the ids of a window: the block of
`BLOCK` ids that is scored and the block before it, so windows overlap and each
id is scored once, in batches under one mask. What the head finds is added, in both
steps, to the log-odds after the last id, which are counted. Counts of words and of
neighbouring ids come from all documents learned from, in Spark; the weights are
trained in numpy on all windows of these documents, each once, by the tasks that
read them, in rounds whose results Spark averages. Nothing but tables of fixed size
reaches the driver, and no window is written anywhere.

Base scores need the count of each word of a text. The words that make up more
than 1 in 2^18 of all (fewer than 2^18, 4 MiB) are broadcast, the rest are joined.

Null text is empty: its end alone is scored. A null doc_id counts as held out and
stays null; repeated rows are scored each, and each is learned from. Equal texts
get equal base scores; their model scores may differ in the last digits, which
depend on a batch's shape. Without anything to learn from all ids are equally
likely. Words are known by 64-bit hashes, equal hashes taken as equal; words of
over LONG_WORD characters are encoded in parts of that length. Texts are read whole.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .flat import LOWER, prefix_sums, row_runs, span_hash, text_bytes, word_spans
from .shared import cut, reusing, small_batches

#: Ids scored together, classes and members of one at most, ids with an embedding of their own, and its width.
BLOCK, CLASSES, MEMBERS, INPUTS, WIDTH = 16, 64, 64, 512, 16
#: Blocks of a batch of the attention, and places of one class that are learned from together.
SCORED, CHUNK = 512, 32
#: Classes are learned from as if they had one of these numbers of members.
WIDTHS = (8, 32, MEMBERS)
#: Words that are encoded in one piece have at most so many characters.
LONG_WORD = 256
#: Words that a task remembers the ids of, and counts that it holds.
KNOWN_WORDS, HELD = 1 << 19, 1 << 20
FREQUENT = 1 << 18
_PAIR = 1 << 20
_END_KEY = np.uint64(0x1F83D9ABFB41BD6B)


@lru_cache(1)
def _encoding(file: bytes):
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file.splitlines())}
    return tiktoken.Encoding("words", pat_str=r" [^ ]+|[^ ]+", mergeable_ranks=ranks, special_tokens={})


class Segmenter:
    """Ids of words, remembered by the words' hashes; the last id stands for the end of a text."""

    def __init__(self, file: bytes):
        encoding = _encoding(file)
        self.encode, self.end = encoding.encode_ordinary, encoding.n_vocab
        self.begins = np.array([encoding.decode_single_token_bytes(k)[:1] == b" " for k in range(self.end)])
        self.forget()

    def forget(self) -> None:
        self.keys, self.at, self.sizes = np.array([_END_KEY]), np.zeros(1, np.int64), np.ones(1, np.int64)
        self.flat = np.array([self.end], np.int32)

    def learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Make sure that all of keys (ascending) are known; their words are data[start:end]."""
        if len(self.keys) > KNOWN_WORDS:
            self.forget()
        place = np.searchsorted(self.keys, keys)
        new = np.flatnonzero(self.keys[np.minimum(place, len(self.keys) - 1)] != keys)
        if not len(new):
            return
        short = ends[new] - starts[new] <= LONG_WORD
        some = new[short]
        # all words with a space before each: an id that begins with a space begins a word
        each = ends[some] - starts[some] + 1
        text = data[np.maximum(spread(starts[some] - 1, each), 0)]
        text[np.cumsum(each) - each] = 32
        ids = np.array(self.encode(text.tobytes().decode()), np.int32)
        heads = np.flatnonzero(self.begins[ids])
        sizes = np.zeros(len(new), np.int64)
        sizes[short] = np.diff(np.append(heads, len(ids)))
        at = np.cumsum(sizes) - sizes
        for k in np.flatnonzero(~short).tolist():
            word = data[starts[new[k]] : ends[new[k]]].tobytes().decode()
            parts = [i for a in range(0, len(word), LONG_WORD) for i in self.encode(("" if a else " ") + word[a : a + LONG_WORD])]
            at[k], sizes[k], ids = len(ids), len(parts), np.append(ids, np.array(parts, np.int32))
        at += len(self.flat)
        self.flat = np.concatenate([self.flat, ids])
        self.keys, self.at, self.sizes = (np.insert(old, place[new], more) for old, more in ((self.keys, keys[new]), (self.at, at), (self.sizes, sizes)))

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat, at, sizes) of known keys."""
        k = np.searchsorted(self.keys, keys)
        return self.flat, self.at[k], self.sizes[k]


def spread(at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """at[0], at[0] + 1, ... for sizes[0] numbers, and so on."""
    ends = np.cumsum(sizes)
    return np.repeat(at - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def token_runs(column: pa.Array):
    """(lo, hi, keys, bounds, words) of runs of rows: hashes of the words and the end of each row; words is (data, starts, ends) of the tokens."""
    data, offsets = text_bytes(column)
    for lo, hi in row_runs(offsets, 1 << 20):
        part = LOWER[data[offsets[lo] : offsets[hi]]]
        starts, ends, bounds = word_spans(part, offsets[lo : hi + 1] - offsets[lo])
        keys = np.insert(span_hash(prefix_sums(part), starts, ends), bounds[1:], _END_KEY)
        starts, ends = np.insert(starts, bounds[1:], 0), np.insert(ends, bounds[1:], 0)
        yield lo, hi, keys, bounds + np.arange(len(bounds)), (part, starts, ends)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What np.unique returns with first places, places and counts; keys are hashed and only the different ones sorted."""
    coded = pa.array(keys).dictionary_encode()
    known, where = coded.dictionary.to_numpy(), coded.indices.to_numpy()
    first = np.flatnonzero(np.diff(np.maximum.accumulate(where), prepend=-1))  # the codes count up as keys appear
    order = np.argsort(known)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return known[order], first[order], place.take(where), np.bincount(where, minlength=len(order))[order]


class _Sums:
    """Counts of 64-bit keys, held sorted and distinct once there are many."""

    def __init__(self):
        self.parts, self.held = [], 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((keys, n))
        self.held += len(keys)
        if self.held > HELD:
            self.merge()

    def merge(self) -> None:
        keys, n = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        self.parts = [(keys[at], np.add.reduceat(n[order], at) if len(at) else n)]
        self.held = len(at)

    def batches(self, kind: int):
        if self.parts:
            self.merge()
            keys, n = self.parts[0]
            for a in range(0, len(keys), 1 << 16):
                k = keys[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.view(np.int64)), pa.array(n[a : a + (1 << 16)])], ["kind", "key", "n"])
        self.__init__()


def corpus_counts(docs: DataFrame, file) -> DataFrame:
    """(kind, key, n): words (kind 0, by hash) and neighbouring ids (kind 1, before * 2^20 + after) of all docs(text).

    A text's first id follows the id of an end.
    """

    def run(batches):
        segmenter, words, pairs = Segmenter(file.value), _Sums(), _Sums()
        for batch in batches:
            for _, _, keys, _, (data, starts, ends) in token_runs(batch.column("text")):
                known, first, where, n = distinct(keys)
                words.add(known, n)
                segmenter.learn(known, data, starts[first], ends[first])
                flat, at, sizes = segmenter.of(known)
                inner = spread(at, sizes - 1)
                pairs.add(flat[inner].astype(np.int64) * _PAIR + flat[inner + 1], np.repeat(n, sizes - 1))
                last = np.append(segmenter.end, flat[at + sizes - 1][where[:-1]]).astype(np.int64)
                pair, _, _, n = distinct(last * _PAIR + flat[at][where])
                pairs.add(pair, n)
                for sums, kind in ((words, 0), (pairs, 1)):
                    if sums.held > HELD:
                        yield from sums.batches(kind)
        yield from words.batches(0)
        yield from pairs.batches(1)

    told = docs.select("text").mapInArrow(reusing(run), "kind int, key long, n long")
    return told.groupBy("kind", "key").agg(F.sum("n").alias("n"))


@dataclass
class Classes:
    """Class and member, embedding and share of its place of each id, from the counts of all ids.

    Classes hold ids of like rank, few enough for an even share of all; the ids
    of the last ranks have one place together and share it by their counts.
    """

    counts: np.ndarray
    of_id: np.ndarray = field(init=False)
    member: np.ndarray = field(init=False)
    input: np.ndarray = field(init=False)
    share: np.ndarray = field(init=False)
    sizes: np.ndarray = field(init=False)

    def __post_init__(self):
        size = len(self.counts)
        order = np.append(size - 1, np.lexsort((np.arange(size - 1), -self.counts[:-1])))  # the end comes first
        smoothed = self.counts + 0.5
        mass, room = smoothed[order] / smoothed.sum(), []
        place, weight = np.zeros((size, 2), np.int64), 0.0
        for k in range(size):  # ends once all classes are full
            if not room or room[-1] == MEMBERS or weight * CLASSES * 0.8 > 1:
                if len(room) == CLASSES:
                    break
                room.append(0)
                weight = 0.0
            place[k] = len(room) - 1, room[-1]
            room[-1] += 1
            weight += mass[k]
        else:
            k = size
        rest = order[k - 1 :]
        place[k - 1 :] = place[k - 1]
        self.of_id, self.member, rank = np.empty(size, np.int16), np.empty(size, np.int16), np.empty(size, np.int64)
        self.of_id[order], self.member[order], rank[order] = place[:, 0], place[:, 1], np.arange(size)
        self.input = np.minimum(rank, INPUTS - 1).astype(np.int16)
        self.share = np.zeros(size)
        self.share[rest] = np.log(smoothed[rest] / smoothed[rest].sum())
        self.sizes = np.array(room)

    def log_odds(self, after: np.ndarray, prior: float = 10.0) -> tuple[np.ndarray, np.ndarray]:
        """From counts of (class, member) after each input: log P(class | input) and log P(member | class, input), smoothed by what all inputs have."""
        after = after.reshape(INPUTS, CLASSES, MEMBERS)
        used = np.arange(MEMBERS) < np.append(self.sizes, np.zeros(CLASSES - len(self.sizes), np.int64))[:, None]
        every = after.sum(axis=0) + 0.5 * used
        classes = after.sum(axis=2)
        overall = (every.sum(axis=1) + 1e-9) / (every.sum() + 1e-9 * CLASSES)
        within = np.where(used, every, 1e-13) / np.maximum(every.sum(axis=1, keepdims=True), 1e-9)
        first = np.log((classes + prior * overall) / (classes.sum(axis=1, keepdims=True) + prior))
        second = np.log((after + prior * within) / (classes[:, :, None] + prior))
        return first.astype(np.float32), second.astype(np.float32)


def _distances() -> np.ndarray:
    """How far before its query each key of a window stands; negative: after it."""
    return np.arange(BLOCK, 2 * BLOCK)[:, None] - np.arange(2 * BLOCK)[None, :]


def _by_class(targets: np.ndarray):
    """(class, places) of the targets; below zero is none."""
    order = np.argsort(targets.astype(np.int16), kind="stable")  # small numbers are sorted by radix
    bounds = np.searchsorted(targets[order], np.arange(CLASSES + 1))
    for c in np.flatnonzero(np.diff(bounds)).tolist():
        yield c, order[bounds[c] : bounds[c + 1]]


@dataclass
class Attention:
    """Weights of the head: embeddings, query, key and value maps, a bias for each distance, and the ways out to classes and members."""

    embed: np.ndarray
    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    near: np.ndarray
    out: np.ndarray
    inner: np.ndarray

    @staticmethod
    def fresh(seed: int = 7) -> Attention:
        draw = np.random.default_rng(seed)
        maps = [(draw.standard_normal((WIDTH, WIDTH)) / WIDTH**0.5).astype(np.float32) for _ in range(3)]
        return Attention((0.5 * draw.standard_normal((INPUTS, WIDTH))).astype(np.float32), *maps, np.zeros(2 * BLOCK, np.float32), np.zeros((WIDTH, CLASSES), np.float32), np.zeros((CLASSES, WIDTH, MEMBERS), np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.query, self.key, self.value, self.near, self.out, self.inner]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def filled(self, flat: np.ndarray) -> Attention:
        cuts = np.cumsum([p.size for p in self.parts()])[:-1]
        return Attention(*(x.reshape(p.shape).astype(np.float32, copy=False) for x, p in zip(np.split(flat, cuts), self.parts())))

    def gradient(self, inputs, first, targets, members, valid, odds, sizes=(MEMBERS,) * CLASSES) -> tuple[float, Attention]:
        """Mean loss of the valid places of windows (n x BLOCK) and its gradient; `sizes`: members that each class has.

        `inputs` is a run of blocks, as of `windows`, or n windows of 2 BLOCK that stand alone.
        `odds` are of `Classes.log_odds`, or of `by_width`, which need not be cut at each step.
        """
        if inputs.shape[1] == 2 * BLOCK:  # blocks of no valid place between the windows
            first, targets, members, valid = (np.repeat(x, 2, axis=0)[:-1] for x in (first, targets, members, valid))
            first[1::2], valid[1::2] = True, 0
            inputs = inputs.reshape(-1, BLOCK)
        n, apart, root = len(first), _distances(), np.float32(WIDTH**-0.5)
        mine = inputs[1:].ravel()
        # what is mapped is one table a map, not each place
        tables = self.embed @ self.query * root, self.embed @ self.key, np.append(self.embed @ self.value, np.ones((INPUTS, 1), np.float32), axis=1)
        around = np.concatenate([inputs[:-1], inputs[1:]], axis=1)
        q, k, v = tables[0].take(inputs[1:], axis=0), tables[1].take(around, axis=0), tables[2].take(around, axis=0)
        e = q @ k.transpose(0, 2, 1)
        if _longest(tables[0]) * _longest(tables[1]) > 60:  # no exponent may overflow
            np.minimum(e, 60, out=e)
        np.exp(e, out=e)
        e *= np.where(apart < 0, 0, np.exp(np.minimum(self.near, 20)[np.maximum(apart, 0)]))
        e[first, :, :BLOCK] = 0
        h = e @ v  # the last column adds up the weights
        total = 1 / h[:, :, WIDTH:]
        h = h[:, :, :WIDTH] * total
        weight = valid.ravel() / np.float32(max(1, int(valid.sum())))

        # places in the order of their classes; no exponent may overflow
        high = _longest(tables[2][:, :WIDTH]) * max(_longest(self.out.T), _longest(self.inner.transpose(0, 2, 1))) > 80
        order = np.argsort(targets.ravel().astype(np.int16), kind="stable")  # small numbers are sorted by radix
        found, last, at, weight = h.reshape(-1, WIDTH).take(order, axis=0), mine.take(order), targets.ravel().take(order), weight.take(order)
        loss, dh, d_out = _softmax_slope(found, self.out, odds[0].take(last, axis=0), at, weight, high)
        d_inner, sizes, low = np.zeros_like(self.inner), np.asarray(sizes), 1
        inside, bounds = members.ravel().take(order), np.searchsorted(at, np.arange(CLASSES + 1))
        for width in WIDTHS:  # classes of like size together, CHUNK places of one class at a time
            some = np.flatnonzero((sizes > low) & (sizes <= width) & (np.diff(bounds)[: len(sizes)] > 0))  # the only member of a class is certain
            low = width
            if len(some):
                count = np.diff(bounds)[some]
                chunks = -(-count // CHUNK)
                to = spread((np.cumsum(chunks) - chunks) * CHUNK, count)
                own, of = spread(bounds[some], count), np.repeat(some, chunks)
                rows, place = np.zeros(len(of) * CHUNK, np.int64), np.zeros((2, len(of) * CHUNK), np.float32)
                rows[to], place[0, to], place[1, to] = own, inside[own], weight[own]
                apiece = odds[1][width] if isinstance(odds[1], dict) else odds[1][:, :, :width].reshape(-1, width)
                more, back, slope = _softmax_slope(found.take(rows, axis=0).reshape(-1, CHUNK, WIDTH), self.inner[of, :, :width], apiece.take(last[rows].astype(np.int64) * CLASSES + at[rows], axis=0), place[0].astype(np.int64), place[1], high)
                loss += more
                dh[own] += back.reshape(-1, WIDTH)[to]
                for j in range(chunks.max()):
                    more = chunks > j
                    d_inner[some[more], :, :width] += slope[(np.cumsum(chunks) - chunks)[more] + j]
        back = np.empty_like(dh)
        back[order] = dh

        # the same weights lead back
        g = np.empty((n, BLOCK, WIDTH + 1), np.float32)
        np.multiply(back.reshape(h.shape), total, out=g[:, :, :WIDTH])
        g[:, :, WIDTH] = -np.einsum("nij,nij->ni", g[:, :, :WIDTH], h)
        ds = g @ v.transpose(0, 2, 1)
        ds *= e
        d = np.zeros((n + 1, BLOCK, 3 * WIDTH), np.float32)
        d[1:, :, :WIDTH] = ds @ k
        both = ds.transpose(0, 2, 1) @ q, e.transpose(0, 2, 1) @ g[:, :, :WIDTH]
        for at, one in zip((WIDTH, 2 * WIDTH), both):
            d[1:, :, at : at + WIDTH] = one[:, BLOCK:]
            d[:-1, :, at : at + WIDTH] += one[:, :BLOCK]
        flat = inputs.ravel()
        order = np.argsort(flat.astype(np.int16), kind="stable")
        known = flat[order]
        heads = np.flatnonzero(np.append(True, known[1:] != known[:-1]))
        slopes = np.zeros((INPUTS, 3 * WIDTH), np.float32)
        slopes[known[heads]] = np.add.reduceat(d.reshape(-1, 3 * WIDTH).take(order, axis=0), heads)
        dq, dk, dv = np.split(slopes, 3, axis=1)
        dq = dq * root
        d_embed = dq @ self.query.T + dk @ self.key.T + dv @ self.value.T
        d_near = np.bincount(np.maximum(apart, 0).ravel(), np.where(apart < 0, 0, ds.sum(axis=0)).ravel(), 2 * BLOCK).astype(np.float32)
        return loss, Attention(d_embed, self.embed.T @ dq, self.embed.T @ dk, self.embed.T @ dv, d_near, d_out, d_inner)


def by_width(odds: tuple[np.ndarray, np.ndarray], sizes: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Odds for learning: those of members, by input and class, cut to each of WIDTHS; a member that a class doesn't have gets none."""
    there = np.arange(MEMBERS) < np.append(sizes, np.zeros(CLASSES - len(sizes), np.int64))[:, None]
    inner = np.where(there, odds[1], np.float32(-1e9))
    return odds[0], {width: inner[:, :, :width].reshape(-1, width) for width in WIDTHS}


def _softmax_slope(found, out, odds, at, weight, high: bool):
    """(loss, slope by found, slope by out) of the softmax of found @ out + odds; found and out may be stacks of matrices. `high`: exponents may overflow."""
    logits = found @ out
    shape, logits = logits.shape, logits.reshape(odds.shape)
    logits += odds
    if high:
        np.minimum(logits, 80, out=logits)
    own = np.arange(0, logits.size, logits.shape[1]) + at
    told = logits.ravel()[own]
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], np.float32)
    loss = float(((np.log(total) - told) * weight).sum())
    logits *= (weight / total)[:, None]
    logits.ravel()[own] -= weight
    slope = logits.reshape(shape)
    return loss, (slope @ np.swapaxes(out, -2, -1)).reshape(-1, WIDTH), np.swapaxes(found, -2, -1) @ slope


@dataclass
class Adam:
    """Adaptive steps over the flat weights."""

    rate: float
    steps: int = 0
    mean: np.ndarray | None = None
    square: np.ndarray | None = None

    def step(self, flat: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        """The weights after one step; what `gradient` holds is lost."""
        self.steps += 1
        if self.steps == 1:
            self.mean, self.square = np.zeros_like(gradient), np.zeros_like(gradient)
        self.mean += 0.1 * (gradient - self.mean)
        gradient *= gradient
        gradient -= self.square
        gradient *= 0.01
        self.square += gradient
        np.sqrt(self.square, out=gradient)
        gradient *= (1 - 0.99**self.steps) ** -0.5
        gradient += 1e-8
        np.divide(self.mean, gradient, out=gradient)
        gradient *= self.rate / (1 - 0.9**self.steps)
        return flat - gradient


class Scorer:
    """The head with its maps folded into one table a map, for scoring alone."""

    def __init__(self, weights: Attention, odds: tuple[np.ndarray, np.ndarray], sizes: np.ndarray):
        self.q = weights.embed @ weights.query / np.float32(WIDTH**0.5)
        self.k, self.v = weights.embed @ weights.key, weights.embed @ weights.value
        apart = _distances()
        self.mask = np.where(apart < 0, 0, np.exp(np.clip(weights.near, -20, 20)[np.maximum(apart, 0)])).astype(np.float32)
        # no exponent may overflow: bound what a query and a key, or a value and a way out, can reach
        self.q *= np.float32(min(1, 30 / max(1e-9, _longest(self.q) * _longest(self.k))))
        longest = _longest(self.v)
        self.out, inner = (w * np.float32(min(1, 30 / max(1e-9, longest * _longest(np.moveaxis(w, -2, -1))))) for w in (weights.out, weights.inner))
        self.v = np.append(self.v, np.ones((INPUTS, 1), np.float32), axis=1)
        self.sizes = sizes
        # of each class only the members that it has
        self.inner = [np.ascontiguousarray(w[:, :n]) for w, n in zip(inner, sizes)]
        self.odds = odds[0], [np.ascontiguousarray(odds[1][:, c, :n]) for c, n in enumerate(sizes)]

    def states(self, blocks: np.ndarray, first: np.ndarray) -> np.ndarray:
        """What the head finds for each place of blocks[1:]; blocks[k] is the block before blocks[k + 1]."""
        q, k, v = self.q.take(blocks[1:], axis=0), self.k.take(blocks, axis=0), self.v.take(blocks, axis=0)
        s = np.empty((len(q), BLOCK, 2 * BLOCK), np.float32)
        np.matmul(q, k[:-1].transpose(0, 2, 1), out=s[:, :, :BLOCK])
        np.matmul(q, k[1:].transpose(0, 2, 1), out=s[:, :, BLOCK:])
        np.exp(s, out=s)
        s *= self.mask
        s[first, :, :BLOCK] = 0
        h = (s[:, :, :BLOCK] @ v[:-1] + s[:, :, BLOCK:] @ v[1:]).reshape(-1, WIDTH + 1)
        return h[:, :WIDTH] / h[:, WIDTH:]  # the last column adds up the weights

    def log_ids(self, blocks: np.ndarray, first: np.ndarray, targets: np.ndarray, members: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each valid place's class and member, in order."""
        last, targets, members, h, classes = blocks[1:][valid], targets[valid], members[valid], [], []
        for a in range(0, len(first), SCORED):
            z = a + SCORED
            h.append(self.states(blocks[a : z + 1], first[a:z])[valid[a:z].ravel()])
            done = sum(map(len, classes))
            k = slice(done, done + len(h[-1]))
            classes.append(_log_softmax(h[-1] @ self.out, self.odds[0].take(last[k], axis=0), targets[k]))
        h, out = np.concatenate(h), np.concatenate(classes)
        for c, rows in _by_class(targets):
            for a in range(0, len(rows) if self.sizes[c] > 1 else 0, 1 << 13):
                k = rows[a : a + (1 << 13)]
                out[k] += _log_softmax(h.take(k, axis=0) @ self.inner[c], self.odds[1][c].take(last.take(k), axis=0), members.take(k))
        return out


def _longest(rows: np.ndarray) -> float:
    return float(np.sqrt((rows.astype(np.float64) ** 2).sum(axis=-1)).max())


def _log_softmax(logits: np.ndarray, odds: np.ndarray, at: np.ndarray) -> np.ndarray:
    logits += odds
    own = logits.ravel()[np.arange(0, logits.size, logits.shape[1]) + at]
    np.exp(logits, out=logits)
    return own - np.log(logits @ np.ones(logits.shape[1], np.float32))


def windows(ids: np.ndarray, bounds: np.ndarray, classes: Classes):
    """(blocks, first, targets, members, valid, row) of rows of ids, BLOCK places at a time; each id is a target once.

    A window is a block of inputs and the one before it in `blocks`, which has an
    empty one in front; `first` tells the blocks that begin a row.
    """
    sizes = np.diff(bounds)
    count = -(-sizes // BLOCK)
    total = int(count.sum())
    heads = np.cumsum(count) - count
    place = spread(heads * BLOCK, sizes)
    blocks, targets, members, valid = (np.zeros((total + k, BLOCK), kind) for k, kind in ((1, np.int16), (0, np.int16), (0, np.int16), (0, bool)))
    inputs = classes.input.take(ids)
    before = np.append(classes.input[-1:], inputs[:-1])  # the end of the text before stands before a text
    for made, values in ((blocks[1:], before), (targets, classes.of_id.take(ids)), (members, classes.member.take(ids)), (valid, True)):
        made.reshape(-1)[place] = values
    first = np.zeros(total, bool)
    first[heads] = True
    return blocks, first, targets, members, valid, np.repeat(np.arange(len(sizes)), count)


def row_ids(keys: np.ndarray, bounds: np.ndarray, words, segmenter: Segmenter) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all tokens of a run of rows, and their bounds by row."""
    known, first, where, _ = distinct(keys)
    data, starts, ends = words
    segmenter.learn(known, data, starts[first], ends[first])
    flat, at, sizes = segmenter.of(known)
    each = sizes.take(where)
    return flat.take(spread(at.take(where), each)), np.concatenate([[0], np.cumsum(each)])[bounds]


@dataclass
class LanguageModel:
    """What scoring needs: tables of fixed size, and the counts of words as a table in Spark."""

    file: bytes
    classes: Classes
    scorer: Scorer
    train_tokens: int
    distinct: int
    frequent: np.ndarray
    frequent_counts: np.ndarray

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.train_tokens + 0.1 * (self.distinct + 1)))


def _fitted(docs: DataFrame, classes: Classes, odds, file, every: int, rounds: int, batch_windows: int, tasks: int, rate: float) -> Attention:
    """The head's weights after `rounds` rounds: tasks train on the windows of a round's texts from common weights, Spark averages theirs."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((classes, odds))
    turn_of = F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(rounds))
    texts = docs if every == 1 else docs.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(every)) == 0)
    weights = Attention.fresh()
    for turn in range(rounds):
        start = context.broadcast(weights)

        def train(batches, turn=turn, start=start):
            segmenter, (classes, odds) = Segmenter(file.value), shared.value
            odds, now = by_width(odds, classes.sizes), start.value
            flat, adam, seen, held, room = now.flat(), Adam(rate / 2**turn), 0, [], 0
            before = np.zeros((1, BLOCK), np.int16)

            def learn(parts):
                nonlocal now, flat, seen
                _, slope = now.gradient(*parts, odds, classes.sizes)
                flat = adam.step(flat, slope.flat())
                now = now.filled(flat)
                seen += len(parts[1])

            def together():
                blocks, *others = (np.concatenate(x) for x in zip(*held))
                return [np.concatenate([before, blocks]), *others]

            for batch in batches:
                for _, _, keys, bounds, words in token_runs(batch.column("text")):
                    blocks, *others, _ = windows(*row_ids(keys, bounds, words, segmenter), classes)
                    held.append((blocks[1:], *others))
                    room += len(blocks) - 1
                    if room >= batch_windows:
                        blocks, *others = together()
                        whole = room - room % batch_windows
                        for a in range(0, whole, batch_windows):
                            learn([blocks[a : a + batch_windows + 1], *(x[a : a + batch_windows] for x in others)])
                        before = blocks[whole : whole + 1]
                        held, room = [(blocks[whole + 1 :], *(x[whole:] for x in others))], room - whole
            if room:
                learn(together())
            if seen:  # whole numbers add up to the same sum in any order
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(flat), dtype=np.int32)), pa.array(np.append(seen, np.rint(flat.astype(np.float64) * seen * 4096).astype(np.int64)))], ["place", "w"])

        mine = texts.where(turn_of == turn).select("text").coalesce(tasks)
        found = mine.mapInArrow(reusing(train), "place int, w long").groupBy("place").agg(F.sum("w").alias("w")).toArrow()
        if len(found):
            sums = np.zeros(len(found))
            sums[found.column("place").to_numpy()] = found.column("w").to_numpy()  # the number of windows, place -1, comes last
            weights = weights.filled(sums[:-1] / (sums[-1] * 4096))
    return weights


def fit_language_model(docs: DataFrame, path: str, every: int = 1, rounds: int = 4, batch_windows: int = 256, task_windows: int = 1 << 15, rate: float = 0.02) -> tuple[LanguageModel, DataFrame]:
    """The model of docs(doc_id, text) and the counts (key, n) of their words.

    `path` is a vocabulary file of ranks. Counts cover all docs, and the head is
    trained on all windows of all of them (a caller may have it learn from each
    `every`-th document by a hash of doc_id alone). The number of tasks that train
    it, of `task_windows` windows or more each in a round, grows with the docs.
    """
    docs = small_batches(docs)
    with open(path, "rb") as f:
        content = f.read()
    file = docs.sparkSession.sparkContext.broadcast(content)
    counts = cut(corpus_counts(docs, file))
    words, pairs = counts.where("kind = 0").select("key", "n"), counts.where("kind = 1").select("key", "n")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    frequent = words.where(F.col("n") > F.lit(total.n // FREQUENT)).toArrow()  # fewer than FREQUENT
    keys = frequent.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)

    ids = np.zeros(_encoding(content).n_vocab + 1, np.int64)
    seen = pairs.groupBy((F.col("key") % _PAIR).alias("id")).agg(F.sum("n").alias("n")).toArrow()  # at most one row an id of the vocabulary
    ids[seen.column("id").to_numpy()] = seen.column("n").to_numpy()
    classes = Classes(ids)
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def cells(batches):
        found = np.zeros(INPUTS * CLASSES * MEMBERS, np.int64)
        for batch in batches:
            before, after = np.divmod(batch.column("key").to_numpy(), _PAIR)
            place = (shared.value.input[before].astype(np.int64) * CLASSES + shared.value.of_id[after]) * MEMBERS + shared.value.member[after]
            np.add.at(found, place, batch.column("n").to_numpy())
        at = np.flatnonzero(found)
        for a in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[a : a + (1 << 16)]), pa.array(found[at[a : a + (1 << 16)]])], ["cell", "n"])

    counted = pairs.mapInArrow(reusing(cells), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    after = np.zeros(INPUTS * CLASSES * MEMBERS)
    after[counted.column("cell").to_numpy()] = counted.column("n").to_numpy()
    odds = classes.log_odds(after)
    tasks = max(1, int(ids.sum()) // (BLOCK * every * rounds * task_windows))
    weights = _fitted(docs, classes, odds, file, every, rounds, batch_windows, tasks, rate)
    model = LanguageModel(content, classes, Scorer(weights, odds, classes.sizes), total.n, total.v, keys[order], frequent.column("n").to_numpy()[order])
    return model, words


def _rare(keys: np.ndarray, row: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, n) of the words that are not `hit`, each once a row."""
    keys, row = keys[~hit], row[~hit]
    order = np.argsort(keys, kind="stable")
    keys, row = keys[order], row[order]
    heads = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (row[1:] != row[:-1]))[: len(keys)])
    return row[heads], keys[heads], np.diff(np.append(heads, len(keys)))


def scored(docs: DataFrame, model: LanguageModel, words: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of docs(doc_id, text); scores are log10.

    Texts are read once. A task sends a row for each document and, for the counts
    that it doesn't hold, one for each of its rare words; they meet again by doc_id
    and text, so a row that is repeated is summed with its copies and then divided.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    given = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    log10 = np.log(10)
    names = ["n_tokens", "held", "frequent_base", "score"]

    def run(batches):
        model = shared.value
        segmenter = Segmenter(model.file)
        weights = model.base(model.frequent_counts)
        for batch in batches:
            n_tokens, known, base, score = (np.zeros(len(batch), kind) for kind in (np.int64, np.int64, np.float64, np.float64))
            text_key = batch.column("text_key").to_numpy()
            for lo, hi, keys, bounds, words in token_runs(batch.column("text")):
                n_tokens[lo:hi] = np.diff(bounds)
                hit = np.zeros(len(keys), bool)
                if len(model.frequent):
                    at = np.minimum(np.searchsorted(model.frequent, keys), len(model.frequent) - 1)
                    hit = model.frequent[at] == keys
                    known[lo:hi] = np.add.reduceat(hit.astype(np.int64), bounds[:-1])
                    base[lo:hi] = np.add.reduceat(np.where(hit, weights[at], 0), bounds[:-1])
                row, rare, n = _rare(keys, np.repeat(np.arange(lo, hi), np.diff(bounds)), hit)
                for a in range(0, len(row), 1 << 16):
                    k = row[a : a + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(k)), pa.array(text_key[k]), pa.array(rare[a : a + (1 << 16)].view(np.int64)), pa.array(n[a : a + (1 << 16)]), pa.nulls(len(k), own)], ["doc_id", "text_key", "key", "tf", "own"]
                    )
                ids, ends = row_ids(keys, bounds, words, segmenter)
                score[lo:hi] = np.add.reduceat(model.classes.share.take(ids), ends[:-1])
                blocks, first, targets, members, valid, _ = windows(ids, ends, model.classes)
                logs = model.scorer.log_ids(blocks, first, targets, members, valid).astype(np.float64)
                score[lo:hi] += np.add.reduceat(logs, ends[:-1])
            found = pa.StructArray.from_arrays([pa.array(x) for x in (n_tokens, known, base, score / log10)], names)
            # the document's own row is spread by its text
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), batch.column("text_key"), pa.nulls(len(batch), pa.int64()), found], ["doc_id", "text_key", "key", "tf", "own"])

    own = pa.struct(list(zip(names, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))))
    told = given.mapInArrow(reusing(run), "doc_id long, text_key long, key long, tf long, own struct<n_tokens: long, held: long, frequent_base: double, score: double>")
    rare = words.where(F.col("n") <= F.lit(model.train_tokens // FREQUENT))
    count, word = F.coalesce("n", F.lit(0)), F.col("tf").isNotNull()
    base = F.log10((count + 0.1) / F.lit(model.train_tokens + 0.1 * (model.distinct + 1)))
    sums = told.join(rare, "key", "left").groupBy("doc_id", "text_key").agg(
        F.sum(F.when(word & (count > 0), F.col("tf")).otherwise(0)).alias("known"), F.sum(F.when(word, F.col("tf") * base).otherwise(0.0)).alias("base"), F.count("own.score").alias("copies"), *(F.max(f"own.{name}").alias(name) for name in names)
    )
    return sums.select(
        "doc_id", "n_tokens", (F.col("held") + F.expr("known div copies")).alias("n_known"), F.lit(model.train_tokens).cast("long").alias("train_tokens"), (F.col("frequent_base") + F.col("base") / F.col("copies")).alias("base_score"), "score", F.explode(F.expr("sequence(1L, copies)")).alias("copy")
    ).drop("copy")


def held_out(fold: int = 10) -> Column:
    """Whether a doc_id's text has a CRC-32 that `fold` divides; a null id's is that of the empty text, 0."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % fold == 0
