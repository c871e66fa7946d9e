"""Operators on documents against brute force, over the small table and awkward cases."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from cases import documents, long_documents, plain
from pyspark.sql import functions as F

from tidewell.llm import bpe, jaccard, media, packing, quality, secrets, suffix, toxicity
from tidewell.llm.jaccard import divide_skip, jaccard_components
from tidewell.llm.shared import connected_components, members_of
from tidewell.llm.queries import QUERIES, vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def tables(spark, small):
    return {"small": spark.read.parquet(f"{small}/documents.parquet"), "cases": documents(spark), "long": long_documents(spark), "empty": documents(spark).limit(0)}


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.mark.parametrize("name", ["small", "cases", "long", "empty"])
def test_jaccard(tables, name):
    docs = tables[name]
    sets = {}
    for doc, text in plain(docs):
        words = WORD.findall(lower(text))
        sets[doc] = {tuple(words[k : k + 4]) for k in range(max(1, len(words) - 3))} if words else set()
    ids = sorted(sets, key=lambda d: -1 if d is None else d)
    root = {d: d for d in ids}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[:i]:
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= 85 * len(sets[a] | sets[b]):
                a_, b_ = find(a), find(b)
                if a_ != b_:
                    low, high = sorted((a_, b_), key=lambda d: -1 if d is None else d)
                    root[high] = low
    got = jaccard_components(docs).collect()
    assert len(got) == len(plain(docs))
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id])
        assert r.component_id == find(r.doc_id)


@pytest.mark.parametrize("block, roots", [(40, 0), (2000, 1 << 16)])
def test_heavy_neighbourhoods_keep_their_links(spark, monkeypatch, block, roots):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {(r.doc_id, r.component_id) for r in jaccard_components(docs, 5, 80).collect()}
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(jaccard, "BROADCAST_ROOTS", roots)
    assert {(r.doc_id, r.component_id) for r in jaccard_components(docs, 5, 80).collect()} == want


def test_small_flushes_and_copies_in_several_tasks_keep_links(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {(r.doc_id, r.component_id) for r in jaccard_components(docs, 5, 80).collect()}
    monkeypatch.setattr(jaccard, "HELD_SHINGLES", 3000)
    monkeypatch.setattr(jaccard, "BUCKET_SHINGLES", 1 << 10)
    # every row is listed, so copies are on their lists from each task
    monkeypatch.setattr(jaccard, "members_of", lambda *_: lambda keys: np.ones(len(keys), bool))
    assert {(r.doc_id, r.component_id) for r in jaccard_components(docs, 5, 80).collect()} == want


def test_filters_grow_with_their_keys(spark):
    members = members_of(spark.range(2_000_000).select(F.xxhash64("id").alias("key")), "key", 2_000_000)
    rng = np.random.default_rng(1)
    assert members(rng.integers(-(2**63), 2**63, 100_000)).mean() < 0.02
    inside = [r.key for r in spark.range(1000).select(F.xxhash64("id").alias("key")).collect()]
    assert members(np.array(inside)).all()


def test_frequent_shingles_keep_links(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {(r.doc_id, r.component_id) for r in jaccard_components(docs, 5, 80).collect()}
    seen = []
    monkeypatch.setattr(jaccard, "FREQUENT_CLASSES", 1 << 40)  # then all that four classes of a task have are frequent
    known = jaccard.frequent_shingles
    monkeypatch.setattr(jaccard, "frequent_shingles", lambda *a: seen.append(known(*a)) or seen[-1])
    assert {(r.doc_id, r.component_id) for r in jaccard_components(docs, 5, 80).collect()} == want
    assert len(seen[0]) > 100


@pytest.mark.parametrize("one_task", [0, 1 << 20])
def test_connected_components(spark, one_task):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-60, 400, (260, 2))] + [(k, k + 1) for k in range(1000, 1040)] + [(7, 7)]
    root = {n: n for p in pairs if p[0] != p[1] for n in p}
    for _ in root:
        for a, b in pairs:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = connected_components(spark.createDataFrame(pairs, "a long, b long"), one_task=one_task).collect()
    assert len(got) == len(root) and {r.node: r.root for r in got} == root


def test_divide_skip_links_components():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 1 << 62, 400).astype(np.uint64))
    sets = [np.sort(rng.permutation(base)[: len(base) - k * 9]) for k in range(9)] + [np.unique(rng.integers(0, 1 << 62, 50).astype(np.uint64)) for _ in range(5)]
    root = list(range(len(sets)))
    want = list(root)
    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(np.intersect1d(a, sets[j]))
            if 100 * shared >= 85 * (len(a) + len(sets[j]) - shared):
                want = [min(want[i], want[j]) if w in (want[i], want[j]) else w for w in want]
    for i, j in divide_skip(sets, None, 85):
        root = [min(root[i], root[j]) if w in (root[i], root[j]) else w for w in root]
    assert root == want and len(set(want)) < len(sets)


@pytest.mark.parametrize("name", ["small", "cases", "long", "empty"])
def test_repeats(tables, name):
    docs = tables[name]
    rows = sorted(set(plain(docs)), key=lambda r: (-1 if r[0] is None else r[0]))
    first, removed = {}, {}
    for doc, text in rows:
        raw = text.encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - 99):
            if first.setdefault(raw[k : k + 100], (doc, k)) != (doc, k):
                gone[k : k + 100] = True
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        removed[doc] = (len(raw), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()) if len(raw) else 0, hashlib.sha256(kept).hexdigest())
    got = suffix.repeat_report(docs).collect()
    assert len(got) == len(plain(docs))
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == removed[r.doc_id], r.doc_id


@pytest.mark.parametrize("wide", [False, True])
def test_texts_of_one_id_keep_their_own_ranges(spark, monkeypatch, wide):
    if wide:
        monkeypatch.setattr(suffix, "WIDE_KEY", 1)
    passage = "".join(f"passage word {k} of many " for k in range(12))
    own = ["".join(f"{name} tells {k * 37 % 101} things " for k in range(20)) for name in ("anna", "bert", "carl", "dora")]
    docs = spark.createDataFrame([(1, passage), (None, passage + own[0]), (None, own[1]), (2, passage + own[2]), (2, own[3])], "doc_id long, text string")
    kept = {r.kept.decode() for r in suffix.without_repeats(docs).select("kept").collect()}
    assert {own[1], own[3], passage + own[0]} <= kept and not any(passage in k and own[2] in k for k in kept)
    assert "" in kept


def test_wide_keys_are_settled_exactly(tables, monkeypatch):
    want = {(r.doc_id, r.n_removed, r.kept_sha256) for r in suffix.repeat_report(tables["cases"]).collect()}
    monkeypatch.setattr(suffix, "WIDE_KEY", 1)
    assert {(r.doc_id, r.n_removed, r.kept_sha256) for r in suffix.repeat_report(tables["cases"]).collect()} == want


def test_suffix_array_orders_suffixes():
    rng = np.random.default_rng(2)
    for text in (b"", b"a", b"banana", b"mississippi", bytes(300), bytes(rng.integers(97, 100, 2000, dtype=np.uint8))):
        data = np.frombuffer(text, np.uint8)
        words = suffix.big_endian_words(data)
        order = suffix.suffix_array(data, words, 64).tolist()
        assert sorted(order) == list(range(len(text)))
        keys = [text[k : k + 64].ljust(64, b"\0") for k in order]
        assert keys == sorted(keys)
        shared = suffix.common_prefixes(words, np.array(order, np.int64), 20)
        for a, b, n in zip(order, order[1:], shared[1:]):
            x, y = text[a : a + 20].ljust(20, b"\0"), text[b : b + 20].ljust(20, b"\0")
            assert n == next((k for k in range(20) if x[k] != y[k]), 20) or min(len(text) - a, len(text) - b) < 20


@pytest.mark.parametrize("name", ["small", "cases", "long", "empty"])
def test_packing(tables, name):
    from tokenizers import Tokenizer

    docs = tables[name]
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    ids = {d: library.encode(t, add_special_tokens=False).ids + [1] for d, t in plain(docs)}
    got = packing.packed(docs, vocabulary("word_bpe_49k.json")).collect()
    lanes, pieces = {}, {}
    for r in got:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
        lanes.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    for lane in lanes.values():
        at = 0
        for offset, length in sorted(lane):
            assert offset == at
            at += length
        assert at <= 2048
    copies = {d: sum(x == d for x, _ in plain(docs)) for d in ids}
    for d, own in ids.items():
        assert sum(n for _, n in pieces[d]) == copies[d] * len(own)
        assert sorted(k for s, n in pieces[d] for k in range(s, s + n)) == sorted(list(range(len(own))) * copies[d])
    if name == "small":
        full = sum(map(len, ids.values()))
        size = {k: sum(n for _, n in lane) for k, lane in lanes.items()}
        assert sum(0 if n & (n - 1) == 0 else 2048 - n for n in size.values()) < 0.03 * full


def test_fill_window_is_best():
    rng = np.random.default_rng(3)
    for _ in range(50):
        lengths = rng.integers(1, 60, 8).tolist()
        counts = {n: lengths.count(n) for n in lengths}
        chosen = packing.fill_window(counts, 100)
        assert all(counts[n] >= k for n, k in chosen.items()) and max(counts) in chosen
        sums = {max(counts)}
        rest = list(lengths)
        rest.remove(max(counts))
        for n in rest:
            sums |= {s + n for s in sums if s + n <= 100}
        assert sum(n * k for n, k in chosen.items()) == max(sums)


@pytest.mark.parametrize("name", ["small", "cases", "long", "empty"])
def test_bpe(tables, name):
    from tokenizers import Tokenizer

    docs, path = tables[name], vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = {}
    for d, t in plain(docs):
        ids = library.encode(t, add_special_tokens=False).ids
        want[d] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = bpe.round_trip_digests(docs, path).collect()
    assert len(got) == len(plain(docs))
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want[r.doc_id]
    back = {(r.doc_id, r.text) for r in bpe.decoded(bpe.encoded(docs, path), path).collect()}
    assert back == set(plain(docs))


def test_rounds_of_long_pieces_equal_the_library(monkeypatch):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    library, own, draw = Tokenizer.from_file(path), bpe.ByteBpe(path), np.random.default_rng(5)
    words = ["the", "ion", "aaaa", "aaaaa", "banana", "mississippi", "漢字かな", "éè", "==", "\n\n", " ", " ", "  x"]
    monkeypatch.setattr(bpe, "LONG_PIECE", 0)
    texts = ["".join(draw.choice(words, draw.integers(0, 30))) for _ in range(500)] + ["".join(draw.choice(list("etaoinshr"), 20_000))]
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("name", ["small", "cases", "long", "empty"])
def test_secrets(tables, name):
    docs = tables[name]
    model = secrets.fit_random_strings(docs)
    got = secrets.secret_report(docs, model).collect()
    texts = dict(plain(docs))
    assert len(got) == len(plain(docs))
    assign = re.compile(r"((?:[Pp][Aa][Ss][Ss](?:[Ww][Oo][Rr][Dd]|[Ww][Dd]))|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)")
    for r in got:
        text = texts[r.doc_id]
        found = [("assign", m) for m in assign.finditer(text) if len(m[2]) >= 8]
        found += [("access", m) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        found += [("hex", m) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        order = ["assign", "access", "hex"]
        spans = sorted((m.start(), order.index(k), m.end(), k) for k, m in found)
        said = ",".join(f"{k}:{a}:{z}" for a, _, z, k in spans)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == o for k, _ in found) for o in order]
        assert set(said.split(",")) <= set(r.spans.split(","))
    assert docs.columns == secrets.redacted(docs, model).columns
    assert all("AKIA" + "ABCDEFGHIJKLMNOP" not in (r.text or "") for r in secrets.redacted(docs, model).collect())


def test_random_strings_are_told_from_words(spark, tables):
    model = secrets.fit_random_strings(tables["small"])
    cases = {"key Zk3vQ9xT7bLw2RfH8sJdM4nC here": 1, "an_ordinary_identifier_name_2024_v2": 0, "thonnterhaeredtionbleouresthand": 0, "x 9f8A7c6D5e4B3a2F1e0D9c8B7a6 y": 1}
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(cases)], "doc_id long, text string")
    assert [r.n_random for r in secrets.secret_report(docs, model).orderBy("doc_id").collect()] == list(cases.values())


@pytest.mark.parametrize("form", ["{}", "see path/to/some/ordinary/folder/of/files/{}", "an-ordinary-name-of-some-service={}", "ordinary_setting_of_the_service_{}_and_more_words"])
def test_drawn_keys_are_recalled(spark, tables, form):
    import random

    model, rng = secrets.fit_random_strings(tables["small"]), random.Random(5)
    base62 = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    keys = ["".join(rng.choices(base62[10 * (k % 4 == 0) :], k=24 + k % 3 * 4)) for k in range(300)]
    docs = spark.createDataFrame([(k, form.format(key)) for k, key in enumerate(keys)], "doc_id long, text string")
    left = [r.text for r in secrets.redacted(docs, model).collect()]
    hidden = sum(key not in text and "[SECRET]" in text for key, text in zip(keys, left))
    assert hidden >= 0.95 * len(keys), hidden


def test_all_documents_are_in_the_random_string_model(spark):
    odd = "QJ7" * 40
    docs = spark.createDataFrame([(k, "plain words of the ordinary language") for k in range(2500)] + [(None, "x" * 70 + odd)] * 50, "doc_id long, text string")
    ratio = secrets.fit_random_strings(docs).ratio
    code = {c: k for k, c in enumerate(secrets.ALPHABET)}
    assert ratio[code[ord("Q")], code[ord("J")]] < ratio[code[ord("Q")], code[ord("K")]] - 3


def brute_counts(text):
    words = WORD.findall(text)
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
        lines.add(line)
    seen = {}
    for k in range(len(words) - 4):
        seen.setdefault(tuple(words[k : k + 5]), []).append(k)
    hit = {k + j for at in seen.values() if len(at) > 1 for k in at for j in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


@pytest.mark.parametrize("name", ["small", "cases", "long", "empty"])
def test_quality_counts(spark, tables, small, name):
    docs = tables[name]
    rules = quality.fit_list(tables["small"], spark.read.parquet(f"{small}/labels.parquet"))
    got = quality.verdicts(docs, rules).select("row.doc_id", "stats.*", "base_failed", "kept").collect()
    assert len(got) == len(plain(docs))
    texts = dict(plain(docs))
    for r in got:
        counts = brute_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 10 or 100 * counts[4] > 20 * counts[0])
        assert not (r.base_failed and r.kept)


def test_quality_rules_learn(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rules = quality.fit_list(docs, labels.where("doc_id % 2 = 0"))
    assert rules.rules
    got = quality.verdicts(docs, rules).where("NOT base_failed").select("row.doc_id", "kept").join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    clean = [r.kept for r in got if r.quality == 1]
    bad = [r.kept for r in got if r.quality == 0]
    assert sum(clean) >= 0.995 * len(clean) and sum(bad) <= 0.1 * len(bad)


def test_decision_list_matches_its_sql(spark):
    rng = np.random.default_rng(4)
    values = {n: rng.random(6000) for n in ("symbol_share", "upper_share")}
    bad = (values["symbol_share"] > 0.7) | (values["upper_share"] < 0.1)
    rules = quality.learn_list(values, bad, np.arange(6000) % 3 == 0)
    assert (rules.hits(values) == bad).mean() > 0.97
    assert quality.DecisionList(()).sql() == "false"


def test_decision_list_case_equals_its_hits(spark, small):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counted = quality.with_counts(docs, ("doc_id",)).select("row.doc_id", "stats")
    rows = counted.selectExpr("doc_id", *(f"double({sql}) AS {n}" for n, sql in {n: re.sub(r"\b(n_\w+|word_chars)\b", r"stats.\1", sql) for n, sql in quality.FEATURES.items()}.items())).toPandas().sort_values("doc_id")
    values = {n: rows[n].to_numpy() for n in quality.FEATURES}
    middle = {n: float(np.quantile(v, 0.6)) for n, v in values.items()}
    names = list(values)
    rules = quality.DecisionList(tuple((quality.Test(a, True, middle[a]), quality.Test(b, False, middle[b])) for a, b in zip(names, names[3:])))
    got = counted.select("doc_id", rules.rejects().alias("hit")).toPandas().sort_values("doc_id")
    assert got["hit"].tolist() == rules.hits(values).tolist() and 0 < got["hit"].sum() < len(got)


def test_fits_take_each_document_once(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    more = docs.union(docs).union(docs)
    assert quality.fit_list(docs, labels) == quality.fit_list(more, labels.union(labels))
    one, three = (toxicity.fit_toxicity(d, labels) for d in (docs, more))
    assert one.bias == three.bias and one.weights.tolist() == three.weights.tolist()
    bounded = toxicity.fit_toxicity(docs, labels, sample_bytes=4096)
    assert len(bounded.features) < len(one.features)


def test_word_encoder_equals_library():
    import random

    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), packing.WordEncoder(path)
    rng = random.Random(5)
    words = ["AL\u0130.", "\u0130,", "<|ENDOFTEXT|>", "<|endoftext|>", "a<|endoftext|>b.", "it's.", "it's,", "x\u0301.", "\u00b4", "\u0301a", "e\u0301,", "\u00df.", "12.", "a1,", "1a.", "...", ",", ".", "a..", "\u4f60\u597d.", "\ud55c\uae00,", "\u0645\u0631\u062d\u0628\u0627.", "A", "The", "don't", "\t", "\u00a0", "\u2028x.", "\x1c", "\u01c5.", "\ufb01,", "\u212b.", "\u1e9e."]
    letters = "abcXYZ\u0130\u0131\u00e9\u00c9\u03a3\u03c3\u044f.,'- \n\t\u0307\u0301<|>0\u4e2d"
    texts = [rng.choice([" ", "\n", "  ", ""]).join(rng.choices(words, k=rng.randint(1, 8))) if k % 2 else "".join(rng.choices(letters, k=rng.randint(0, 24))) for k in range(10_000)]
    for lo in range(0, len(texts), 500):
        some = texts[lo : lo + 500]
        for text, got, want in zip(some, own.encode(some), library.encode_batch(some, add_special_tokens=False)):
            assert np.frombuffer(got, "<u4").tolist() == want.ids, text


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        packing.WordEncoder(vocabulary("byte_bpe_50k.json"))
    with pytest.raises(ValueError):
        bpe.ByteBpe(vocabulary("word_bpe_49k.json"))


def test_toxicity_held_out(spark):
    got = QUERIES["op2_toxicity"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in got)
    assert right >= 0.9 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_toxicity_cases(spark, tables, small):
    model = toxicity.fit_toxicity(tables["small"], spark.read.parquet(f"{small}/labels.parquet"))
    for name in ("cases", "long", "empty"):
        assert toxicity.scored(tables[name], model).count() == tables[name].count()
    none = toxicity.fit_toxicity(tables["empty"], spark.read.parquet(f"{small}/labels.parquet"))
    assert toxicity.scored(tables["cases"], none).where("score = 0.5").count() == tables["cases"].count()


@pytest.mark.parametrize("name", ["small", "cases", "long", "empty"])
def test_media(tables, name):
    docs = tables[name]
    rows = media.stored(docs)
    got = media.with_features(rows).collect()
    heads = {(r.doc_id, r.width, r.height, r.bits, r.colour) for r in media.with_metadata(rows).collect()}
    assert heads == {(r.doc_id, r.width, r.height, 8, 0) for r in got}
    texts = dict(plain(docs))
    assert len(got) == len(plain(docs))
    by_text = {}
    for r in got:
        raw = texts[r.doc_id].encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and (r.width, r.height) == (64, len(payload) // 64)
        values = (r.media_bytes, r.media_sha256, r.feature)
        assert by_text.setdefault(raw, values) == values


def test_media_shards_are_tar_files(tables):
    import tarfile

    rows = media.stored(tables["cases"]).collect()
    for shard in {r.shard for r in rows}:
        with tarfile.open(shard.removeprefix("file:")) as tar:
            held = {m.name: tar.extractfile(m).read() for m in tar.getmembers()}
        for r in rows:
            if r.shard == shard:
                assert hashlib.sha256(held[f"{r.digest}.png"]).hexdigest() == r.digest and len(held[f"{r.digest}.png"]) == r.length


def test_null_ids_stay_null(tables):
    assert jaccard_components(tables["cases"]).where(F.col("doc_id").isNull()).count() == 1
