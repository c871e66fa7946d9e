"""Byte-level BPE in batched numpy merge rounds, and the way back.

Texts are split as the vocabulary's own pre-tokeniser does; the distinct new
pieces of a batch become one flat array of symbols. Each round looks up every
neighbouring pair's rank by binary search over the sorted pair keys, finds the
least rank of each piece, and merges all its occurrences in that piece from the
left; pieces without a known pair leave. A later merge never makes a pair of
lower rank than the merge that made its symbol, so this equals merging one
occurrence at a time. A long piece may need a round for every merge; the rounds of
such pieces go by rank over all of them and look only at the pairs that changed.

Null text is empty and has no ids. A special token's string in a text is that
token, as the library has it. Ids are joined as little-endian unsigned 32-bit.
A text is encoded whole, however long: its ids (8 bytes each) must fit a task.
Rows that repeat a doc_id are encoded each; a null doc_id stays null.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .shared import identified, restored

#: Pieces remembered by a worker, each with its ids; beyond that it starts anew.
REMEMBERED = 1 << 19
#: The byte-level pre-tokeniser's pattern (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_NEVER = np.int64(1) << 40
#: Characters of a piece from which its rounds look only at what changed: it may need a round for every merge.
LONG_PIECE = 1 << 10


def _by_piece(owner: np.ndarray, symbols: np.ndarray, n: int) -> list[bytes]:
    """Symbols of each of n pieces, in the order of their owners."""
    flat = symbols.astype("<u4").tobytes()
    ends = np.searchsorted(owner, np.arange(n), "right") * 4
    return [flat[a:z] for a, z in zip([0, *ends[:-1].tolist()], ends.tolist())]


def printable_bytes() -> dict[str, int]:
    """The printable stand-in character of each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteBpe:
    """Vocabulary, merges and special tokens of one byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        # the pattern above is the byte-level pre-tokeniser's own; no other is read here
        if said.get("normalizer") or {k: (said.get("pre_tokenizer") or {}).get(k) for k in ("type", "add_prefix_space", "use_regex")} != {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}:
            raise ValueError(f"{path}: not a plain byte-level vocabulary")
        vocabulary, merges = said["model"]["vocab"], said["model"]["merges"]
        stand_in = printable_bytes()
        self.special = {t["content"]: t["id"] for t in said["added_tokens"]}
        size = max([*vocabulary.values(), *self.special.values()]) + 1
        self.size = np.int64(size)
        self.byte_ids = np.zeros(256, np.int64)
        spelled = [b""] * size
        for token, k in vocabulary.items():
            if k not in self.special.values():
                spelled[k] = bytes(stand_in[c] for c in token)
                if len(token) == 1:
                    self.byte_ids[stand_in[token]] = k
        for token, k in self.special.items():
            spelled[k] = token.encode()
        self.token_bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.token_ends = np.cumsum([len(s) for s in spelled])
        self.token_sizes = np.array([len(s) for s in spelled])
        keys, made = [], []
        for merge in merges:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            keys.append(vocabulary[left] * size + vocabulary[right])
            made.append(vocabulary[left + right])
        keys = np.array(keys, np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), np.array(made, np.int64)
        self.splitter = regex.compile(PATTERN)
        self.cutter = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.known: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        if self.cutter and any(s in text for s in self.special):
            out = []
            for part in self.cutter.split(text):
                out += [part] if part in self.special else self.splitter.findall(part)
            return out
        return self.splitter.findall(text)

    def merge_rounds(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        done_owner, done_symbols = [], []
        while len(symbols):
            pair = symbols[:-1] * self.size + symbols[1:]
            spot = np.searchsorted(self.keys, pair)
            spot[spot == len(self.keys)] = 0
            rank = np.append(np.where((self.keys[spot] == pair) & (owner[:-1] == owner[1:]), self.ranks[spot], _NEVER), _NEVER)
            heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            counts = np.diff(np.append(heads, len(owner)))
            least = np.minimum.reduceat(rank, heads)
            live = np.repeat(least < _NEVER, counts)
            if not live.all():
                done_owner.append(owner[~live])
                done_symbols.append(symbols[~live])
                symbols, owner, rank = symbols[live], owner[live], rank[live]
                least, counts = least[least < _NEVER], counts[least < _NEVER]
                if not len(symbols):
                    break
            hit = rank == np.repeat(least, counts)
            at = np.arange(len(hit))
            run_start = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), at, 0))
            hit &= (at - run_start) % 2 == 0  # of overlapping pairs every other, from the left
            symbols[hit] = self.made[rank[hit]]
            stay = ~np.append(False, hit[:-1])
            symbols, owner = symbols[stay], owner[stay]
        if not done_owner:
            return [b""] * len(pieces)
        owner, symbols = np.concatenate(done_owner), np.concatenate(done_symbols)
        order = np.argsort(owner, kind="stable")
        return _by_piece(owner[order], symbols[order], len(pieces))

    def merge_ranks(self, pieces: list[bytes]) -> list[bytes]:
        """As merge_rounds, for long pieces: a round is one rank over all pieces, and looks only at the pairs that changed."""
        symbols = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(symbols)
        owner = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank, alive = np.full(n, _NEVER), np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def offer(at: np.ndarray):
            rank[at] = _NEVER
            at = at[after[at] < n]
            at = at[owner[at] == owner[after[at]]]
            pair = symbols[at] * self.size + symbols[after[at]]
            spot = np.searchsorted(self.keys, pair)
            spot[spot == len(self.keys)] = 0
            known = self.keys[spot] == pair
            at, found = at[known], self.ranks[spot[known]]
            rank[at] = found
            order = np.argsort(found, kind="stable")
            at, found = at[order], found[order]
            heads = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if len(at) else at
            for k, lo, hi in zip(found[heads].tolist(), heads.tolist(), [*heads[1:].tolist(), len(at)]):
                if k not in waiting:
                    heapq.heappush(ranks, k)
                waiting.setdefault(k, []).append(at[lo:hi])

        offer(np.arange(n))
        while ranks:
            least = heapq.heappop(ranks)
            at = np.unique(np.concatenate(waiting.pop(least)))
            at = at[rank[at] == least]
            if not len(at):
                continue
            chained = np.append(False, at[1:] == after[at[:-1]])
            nth = np.arange(len(at))
            at = at[(nth - np.maximum.accumulate(np.where(chained, 0, nth))) % 2 == 0]  # of overlapping pairs every other
            gone = after[at]
            symbols[at], alive[gone], rank[gone] = self.made[least], False, _NEVER
            after[at] = after[gone]
            inner = at[after[at] < n]
            before[after[inner]] = inner
            left = before[at]
            offer(np.unique(np.concatenate([at, left[left >= 0]])))
        return _by_piece(owner[alive], symbols[alive], len(pieces))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        for token, k in self.special.items():
            self.known[token] = int(k).to_bytes(4, "little")
        split = [self.pieces(t) for t in texts]
        new = list({p for ps in split for p in ps}.difference(self.known))
        for merge, part in ((self.merge_rounds, [p for p in new if len(p) <= LONG_PIECE]), (self.merge_ranks, [p for p in new if len(p) > LONG_PIECE])):
            if part:
                self.known.update(zip(part, merge([p.encode() for p in part])))
        return [b"".join(map(self.known.__getitem__, ps)) for ps in split]

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens spelled out; broken sequences become U+FFFD."""
        k = np.frombuffer(ids, "<u4").astype(np.int64)
        sizes = self.token_sizes[k]
        at = np.arange(sizes.sum()) + np.repeat(self.token_ends[k] - np.cumsum(sizes), sizes)
        return self.token_bytes[at].tobytes().decode("utf-8", "replace")


_loaded: dict[str, ByteBpe] = {}


def tokenizer(path: str) -> ByteBpe:
    """One tokenizer for each worker and file."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def _runs(texts: list[str], limit: int = 1 << 20):
    lo, size = 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield texts[lo:k]
            lo, size = k, 0
        size += len(text)
    yield texts[lo:]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids) with ids as bytes, for docs(doc_id, text)."""

    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = [i for part in _runs(texts) for i in bpe.encode(part)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])
        bpe.known.clear()

    return identified(docs, "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary").withColumn("doc_id", restored())


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) for rows (doc_id, ids)."""

    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([bpe.decode(i or b"") for i in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoding and decoding in one pass over the texts."""

    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            counts, first, second = [], [], []
            for part in _runs(texts):
                for ids in bpe.encode(part):
                    counts.append(len(ids) // 4)
                    first.append(hashlib.sha256(ids).hexdigest())
                    second.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.known.clear()  # the worker may serve other stages next

    return identified(docs, "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumn("doc_id", restored())
