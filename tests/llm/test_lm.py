"""Language-model scores: counts against brute force, the model against one position at a time."""

import copy
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from cases import documents, long_documents
from pyspark.sql import functions as F

from tidewell.llm import lm
from tidewell.llm.queries import QUERIES, vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANKS = "byte_bpe_50k.tiktoken"


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def is_held_out(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


@pytest.fixture(scope="module")
def tables(spark, small):
    return {"small": spark.read.parquet(f"{small}/documents.parquet"), "cases": documents(spark), "long": long_documents(spark), "empty": documents(spark).limit(0), "held": documents(spark).where("doc_id is null")}


@pytest.fixture(scope="module")
def fitted(tables):
    docs = tables["small"]
    return lm.fit_language_model(docs.where(~lm.held_out()), vocabulary(RANKS), every=4)


@pytest.mark.parametrize("name, frequent", [("small", 1 << 18), ("small", 50), ("cases", 1 << 18), ("cases", 3), ("long", 1 << 18), ("empty", 1 << 18), ("held", 1 << 18)])
def test_counts_and_base_scores(tables, monkeypatch, name, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)  # with few frequent words most are joined
    docs = tables[name]
    rows = docs.select("doc_id", "text").collect()
    counts = Counter(t for r in rows if not is_held_out(r.doc_id) for t in tokens(r.text))
    total, distinct = sum(counts.values()), len(counts)
    want = Counter()
    for r in rows:
        found = tokens(r.text)
        base = sum(log10((counts[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in found)
        want[r.doc_id, is_held_out(r.doc_id), len(found), sum(counts[t] > 0 for t in found), total, round(base, 5)] += 1
    model, words = lm.fit_language_model(docs.where(~lm.held_out()), vocabulary(RANKS))
    got = lm.scored(docs, model, words).withColumn("held_out", lm.held_out()).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)


def plain_log(model, ids):
    """log10 of the probability of ids, place by place, with whole distributions that must add up to one."""
    c, s, total = model.classes, model.scorer, 0.0
    before = [len(c.counts) - 1, *ids[:-1].tolist()]
    for t in range(len(ids)):
        start = max(0, (t // lm.BLOCK - 1) * lm.BLOCK)
        seen = np.array([c.input[i] for i in before[start : t + 1]])
        v = s.v[:, : lm.WIDTH]
        score = s.k[seen].astype(float) @ s.q[seen[-1]].astype(float) + np.log(s.mask[-1][::-1][: len(seen)][::-1].astype(float))  # by distance
        a = np.exp(score - score.max())
        h = (a / a.sum()) @ v[seen].astype(float)
        first = np.exp(h @ s.out + s.odds[0][seen[-1]])
        second = np.zeros((lm.CLASSES, lm.MEMBERS)) + (np.arange(lm.MEMBERS) == 0)
        for k in np.flatnonzero(s.sizes > 1):
            second[k, : s.sizes[k]] = np.exp(h @ s.inner[k] + s.odds[1][k][seen[-1]])
        place = (first / first.sum())[:, None] * second / second.sum(axis=1, keepdims=True)
        p = place[c.of_id, c.member] * np.exp(c.share)
        assert abs(p.sum() - 1) < 1e-4
        total += np.log10(p[ids[t]])
    return total


def test_scores_equal_one_place_at_a_time(spark, tables, fitted):
    model, words = fitted
    texts = ["", "the of and", "Ünïcode 日本 words", tables["small"].where("doc_id = 7").first().text[:600]]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.scored(docs, model, words).collect()}
    segmenter = lm.Segmenter(model.file)
    for k, text in enumerate(texts):
        ids = [i for t in tokens(text)[:-1] for i in segmenter.encode(" " + t)] + [segmenter.end]
        assert got[k] == pytest.approx(plain_log(model, np.array(ids)), rel=1e-4)


def test_held_out_documents_are_likelier_with_attention(tables, fitted):
    model, words = fitted
    held = tables["small"].where(lm.held_out())
    with_it = lm.scored(held, model, words).agg(F.sum("score")).first()[0]
    alone = copy.copy(model.scorer)
    alone.out, alone.inner = 0 * alone.out, [0 * w for w in alone.inner]
    alone = lm.LanguageModel(**{**vars(model), "scorer": alone})
    assert with_it > lm.scored(held, alone, words).agg(F.sum("score")).first()[0]
    prose = held.where("length(text) > 400").limit(5).select("doc_id", "text").collect()
    shuffled = [(r.doc_id, "".join(np.random.default_rng(1).permutation(list(r.text)))) for r in prose]
    both = held.sparkSession.createDataFrame([(r.doc_id, r.text) for r in prose] + [(-1 - i, t) for i, t in shuffled], "doc_id long, text string")
    score = {r.doc_id: r.score / max(1, len(r.text)) for r in lm.scored(both, model, words).join(both, "doc_id").collect()}
    assert all(score[r.doc_id] > score[-1 - r.doc_id] for r in prose)


def test_gradient():
    draw = np.random.default_rng(3)
    n, b = 3, lm.BLOCK
    weights = lm.Attention.fresh()
    weights = weights.filled(weights.flat() + draw.normal(0, 0.2, len(weights.flat())))
    odds = draw.normal(size=(lm.INPUTS, lm.CLASSES)).astype(np.float32), draw.normal(size=(lm.INPUTS, lm.CLASSES, lm.MEMBERS)).astype(np.float32)
    given = (draw.integers(0, 40, (n, 2 * b)), np.array([True, False, False]), draw.integers(0, 5, (n, b)), draw.integers(0, 9, (n, b)), (draw.random((n, b)) < 0.9).astype(np.float32), odds)
    _, slope = weights.gradient(*given)
    flat, slope = weights.flat().astype(np.float64), slope.flat()
    direction = draw.normal(size=len(flat)) * (slope != 0)
    direction /= np.linalg.norm(direction)
    step = 0.05
    up, down = (weights.filled(flat + sign * step * direction).gradient(*given)[0] for sign in (1, -1))
    assert (up - down) / (2 * step) == pytest.approx(float(slope @ direction), rel=0.03, abs=1e-4)


def test_each_id_is_a_target_once():
    classes = lm.Classes(np.arange(300)[::-1].copy())
    bounds = np.array([0, 1, 1 + lm.BLOCK, 2 + 2 * lm.BLOCK, 150])
    ids = np.random.default_rng(0).integers(0, 299, 150)
    ids[bounds[1:] - 1] = 299  # each row ends with the end
    blocks, first, targets, members, valid, row = lm.windows(ids, bounds, classes)
    assert valid.sum() == 150 and (np.bincount(row, valid.sum(axis=1)) == np.diff(bounds)).all()
    assert (targets[valid] == classes.of_id[ids]).all() and (members[valid] == classes.member[ids]).all()
    assert first.sum() == 4 and len(blocks) == len(first) + 1
    assert (blocks[1:][first, 0] == classes.input[-1]).all() and (blocks[1:][valid][1:] == classes.input[ids[:-1]])[~np.isin(np.arange(1, 150), bounds)].all()


def test_places_of_ids():
    counts = np.zeros(50_258, np.int64)
    counts[:5000] = 10**6 // np.arange(1, 5001)
    classes = lm.Classes(counts)
    at = classes.of_id * lm.MEMBERS + classes.member
    alone = classes.share == 0
    assert len(set(at[alone])) == alone.sum() > 900 and len(set(at[~alone])) == 1
    assert np.exp(classes.share[~alone]).sum() == pytest.approx(1)
    assert (np.bincount(classes.of_id[alone], minlength=lm.CLASSES) <= classes.sizes).all() and len(classes.sizes) <= lm.CLASSES
    few = lm.Classes(np.array([3, 0, 5]))
    assert (few.share == 0).sum() >= 2 and len(few.of_id) == 3


def test_long_words_are_encoded_in_parts(monkeypatch):
    with open(vocabulary(RANKS), "rb") as f:
        segmenter = lm.Segmenter(f.read())
    words = ["abcé" * 500, "ab", "é\u2003x\x85", "z" * 300]
    data, ends = np.frombuffer(" ".join(words).encode(), np.uint8), np.cumsum([len(w.encode()) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-1] + 1)
    keys = np.array([7, 9, 11, 12], np.uint64)
    segmenter.learn(keys, data, starts, ends)
    flat, at, sizes = segmenter.of(keys)
    decode = lm._encoding(open(vocabulary(RANKS), "rb").read()).decode_bytes
    assert [decode(flat[a : a + n].tolist()).decode() for a, n in zip(at, sizes)] == [" " + w for w in words]
    monkeypatch.setattr(lm, "KNOWN_WORDS", 1)
    segmenter.learn(keys[1:2], data, starts[1:2], ends[1:2])
    assert len(segmenter.keys) == 2


def test_query(spark, small):
    rows = QUERIES["op11_lm_scoring"](spark, small).collect()
    assert len(rows) == 200 and all(r.held_out == is_held_out(r.doc_id) for r in rows)


def test_the_head_learns_from_every_document(tables):
    outside = tables["small"].where("pmod(xxhash64(doc_id, 3), 16) <> 0").where(~lm.held_out())
    model, _ = lm.fit_language_model(outside.limit(40), vocabulary(RANKS))  # none of each 16th, which it once learned from alone
    assert np.abs(model.scorer.out).max() > 0


def test_a_run_of_blocks_has_the_gradient_of_its_windows():
    draw = np.random.default_rng(5)
    classes = lm.Classes(10**5 // np.arange(1, 3001))
    ids = draw.zipf(1.3, 4000).clip(1, 2999) - 1
    bounds = np.array([0, 700, 701, 2500, 4000])
    ids[bounds[1:] - 1] = 2999
    blocks, first, targets, members, valid, _ = lm.windows(ids, bounds, classes)
    after = draw.integers(0, 3, (lm.INPUTS, lm.CLASSES, lm.MEMBERS)).astype(float)
    after[:, np.arange(lm.MEMBERS) >= classes.sizes[:, None]] = 0
    odds = classes.log_odds(after)
    weights = lm.Attention.fresh()
    weights = weights.filled(weights.flat() + draw.normal(0, 0.1, len(weights.flat())))
    alone, one = weights.gradient(np.concatenate([blocks[:-1], blocks[1:]], axis=1), first, targets, members, valid.astype(np.float32), odds, classes.sizes)
    run, two = weights.gradient(blocks, first, targets, members, valid, lm.by_width(odds, classes.sizes), classes.sizes)
    assert run == pytest.approx(alone, rel=1e-4)
    for a, b in zip(one.parts(), two.parts()):
        assert np.abs(a - b).max() <= 1e-4 * np.abs(a).max()
    assert np.abs(two.inner).sum(axis=(1, 2))[: len(classes.sizes)][classes.sizes == 1].sum() == 0  # the only member of a class is certain


def test_distinct():
    keys = np.random.default_rng(0).integers(0, 50, 400).astype(np.uint64) << np.uint64(58)
    for some in (keys, keys[:1], keys[:0]):
        for got, want in zip(lm.distinct(some), np.unique(some, return_index=True, return_inverse=True, return_counts=True)):
            assert got.tolist() == want.tolist()


def test_scoring_reads_texts_once(tables, fitted):
    plan = lm.scored(tables["small"], *fitted)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_repeated_rows_are_scored_each(spark, tables, fitted):
    docs = tables["small"].limit(3).select("doc_id", "text")
    once, thrice = (lm.scored(d, *fitted).collect() for d in (docs, docs.union(docs).union(docs)))
    want = {r.doc_id: r for r in once}
    assert len(want) == 3 and len(thrice) == 9
    assert all(r.n_known == want[r.doc_id].n_known and r.base_score == pytest.approx(want[r.doc_id].base_score) and r.score == pytest.approx(want[r.doc_id].score, rel=1e-5) for r in thrice)
