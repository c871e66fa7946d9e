"""Packing token sequences into windows by minimum bin slack.

A document's ids (with an end id) are cut into whole windows and one remainder,
so every piece has one of at most `window` lengths. Only the count of each
length is gathered: a table bounded by the window, whatever the input. From it,
minimum bin slack picks one window after the other: the longest length left is
the seed, a bitset subset-sum over the remaining counts finds the reachable
fillings, and the one nearest to the window is traced back to a multiset of
lengths. That multiset is repeated as often as the counts allow, so at least
one length runs short each time. Pieces then take their places by their index
among pieces of equal length, which is counted in salted groups: no length, not
even one that a third of all pieces have, is gathered in a task.

Where no filling is full, one that ends at a power of two is preferred, as such
sequences need no padding. Null text is empty: its document is the end id alone.
Rows that repeat a doc_id are packed each. A text is encoded whole, however long:
the ids of one text (4 bytes each) must fit a task.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, identified, restored, trimmed

#: How words are split (fixed value); white space is dropped.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words that a worker remembers with their ids; beyond that it starts anew.
REMEMBERED = 1 << 19


class WordEncoder:
    """Ids of whole texts by way of the library, each distinct word encoded once.

    For vocabularies that lower-case and whose pre-tokeniser drops white space:
    then the ids of a text are those of its space-separated words, one after the
    other. Others are refused.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        normal, pieces = ([json.loads(part.__getstate__()) if part else {}] for part in (self.library.normalizer, self.library.pre_tokenizer))
        normal, pieces = normal[0].get("normalizers", normal), pieces[0].get("pretokenizers", pieces)
        if [n.get("type") for n in normal] != ["NFC", "Replace", "Lowercase"] or normal[1]["pattern"] != {"Regex": r"\s+"} or normal[1]["content"] != " ":
            raise ValueError(f"{path}: only vocabularies that compose, join white space and lower-case are read here")
        if (pieces[0].get("type"), pieces[0].get("behavior"), pieces[0].get("invert"), pieces[0].get("pattern")) != ("Split", "Removed", True, {"Regex": PATTERN}) or any(p.get("add_prefix_space") or p.get("use_regex") for p in pieces[1:]):
            raise ValueError(f"{path}: only vocabularies that split by {PATTERN} are read here")
        added = self.library.get_added_tokens_decoder().values()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word or " " in t.content or "\n" in t.content for t in added):
            raise ValueError(f"{path}: added tokens must stand for themselves")
        self.added = [t.content.lower() for t in added]
        self.library.no_truncation()
        self.library.no_padding()
        suffix = getattr(self.library.model, "end_of_word_suffix", None) or "\0"
        self.ends_word = np.zeros(self.library.get_vocab_size(), bool)
        self.ends_word[[k for token, k in self.library.get_vocab().items() if token.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {"": b""}

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known = {"": b""}
        split = [(t.lower() if t.isascii() and not any(a in t.lower() for a in self.added) else t).replace("\n", " ").split(" ") for t in texts]
        self.learn({w for words in split for w in words}.difference(self.known))
        return [b"".join(map(self.known.__getitem__, words)) for words in split]

    def learn(self, words: set[str]) -> None:
        # a mark after a letter is a token run of its own, and its word is often known
        # (U+0130 lower-cases to a letter and a mark, which joins the next one; letters above U+024F may be newer than the library's)
        marked = [w for w in words if len(w) > 1 and w[-1] in ",." and w[-2] < "\u0250" and w[-2].isalpha() and w[-2] != "\u0130"]
        words = (words.difference(marked) | {w[:-1] for w in marked} | {w[-1] for w in marked}).difference(self.known)
        plain, rest = [], []
        for w in words:
            (plain if w.isalpha() else rest).append(w)
        # a word of letters is one run, and its last id ends a word: many are encoded in one call and told apart
        groups = [plain[lo : lo + 256] for lo in range(0, len(plain), 256)]
        for group, found in zip(groups, self.library.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(found.ids, "<u4")
            ends = 4 * np.flatnonzero(self.ends_word[ids]) + 4
            if len(ends) == len(group):
                flat, ends = ids.tobytes(), ends.tolist()
                self.known.update((w, flat[a:z]) for w, a, z in zip(group, [0, *ends], ends))
            else:
                rest += group
        for word, found in zip(rest, self.library.encode_batch_fast(rest, add_special_tokens=False)):
            self.known[word] = np.array(found.ids, "<u4").tobytes()
        self.known.update((w, self.known[w[:-1]] + self.known[w[-1]]) for w in marked)


_loaded: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]


def fill_window(counts: dict[int, int], window: int) -> dict[int, int]:
    """A multiset of the counted lengths, the longest among them, that leaves least slack."""
    seed = max(counts)
    room = window - seed
    mask = (1 << (room + 1)) - 1
    reached, steps = 1, []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left = min(counts[length] - (length == seed), room // length)
        times = 1
        while left > 0:
            times = min(times, left)
            steps.append((reached, length, times))
            reached |= (reached << (length * times)) & mask
            left -= times
            times *= 2
        if reached >> room & 1:
            break
    total = reached.bit_length() - 1
    if total < room:  # sequences that end at a power of two are not padded
        for power in range(window.bit_length() - 1, 7, -1):
            if 0 <= (1 << power) - seed <= room and reached >> ((1 << power) - seed) & 1:
                total = (1 << power) - seed
                break
    chosen = {seed: 1}
    for before, length, times in reversed(steps):
        if not before >> total & 1:
            total -= length * times
            chosen[length] = chosen.get(length, 0) + times
    return chosen


def plan_windows(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Places for all pieces: (length, first index, end index, each window's share, first sequence, offset)."""
    counts = {n: c for n, c in counts.items() if c}
    used = dict.fromkeys(counts, 0)
    places, sequence = [], 0
    while counts:
        chosen = fill_window(counts, window)
        times = min(counts[n] // k for n, k in chosen.items())
        offset = 0
        for n, k in sorted(chosen.items(), reverse=True):
            places.append((n, used[n], used[n] + k * times, k, sequence, offset))
            offset += n * k
            used[n] += k * times
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
        sequence += times
    return places


def token_pieces(docs: DataFrame, path: str, window: int, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]) of docs(doc_id, text)."""
    end = int(end_id).to_bytes(4, "little")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids

    def run(batches):
        own = encoder(path)
        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            rows: list[tuple] = []
            lo = 0
            while lo < len(texts):
                hi, size = lo + 1, len(texts[lo])
                while hi < len(texts) and (size := size + len(texts[hi])) <= 1 << 20:
                    hi += 1
                for doc, ids in zip(doc_ids[lo:hi], own.encode(texts[lo:hi])):
                    ids += end
                    total = len(ids) // 4
                    for start in range(0, total, window):
                        piece = ids[4 * start : 4 * (start + window)]
                        rows.append((doc, start, len(piece) // 4, zlib.crc32(piece), total) + (piece,) * with_ids)
                lo = hi
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, columns)], names)
        own.known = {"": b""}  # the worker may serve other stages next

    return identified(docs, "text").mapInArrow(trimmed(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids)


def packed(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """token_pieces with sequence_id and offset: where each piece lies."""
    spark = docs.sparkSession
    salts = 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = cut(token_pieces(docs, path, window, end_id, with_ids)).withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    groups = cut(pieces.groupBy("length", "salt").agg(F.count("*").alias("n")))
    counts = {r.length: r.n for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `window` rows
    places = spark.createDataFrame(plan_windows(counts, window), "place_length long, first long, stop long, share long, sequence long, base long")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = pieces.withColumn("rank", F.row_number().over(inside) - 1).join(groups, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("earlier"))
    # the places are bounded by the window's lengths, not by the input
    found = ranked.join(F.broadcast(places), (F.col("length") == F.col("place_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("stop")))
    nth = F.col("rank") - F.col("first")
    out = found.withColumn("sequence_id", F.col("sequence") + F.expr("(rank - first) div share")).withColumn("offset", F.col("base") + nth % F.col("share") * F.col("length"))
    return out.select(restored(), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids)
