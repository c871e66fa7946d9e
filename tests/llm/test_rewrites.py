"""Fill-in-the-middle and source divergence against plain versions."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from cases import documents, long_documents
from pyspark.sql import functions as F

from tidewell.llm import divergence, fim
from tidewell.llm.flat import text_bytes
from tidewell.llm.queries import QUERIES

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def tables(spark, small):
    marked = spark.createDataFrame([(500 + k, t) for k, t in enumerate(["a<P>b", "<S", "<M>", "x <M", "<", "é", "日本語 text", "a" * 3000, "1" * 3000])], "doc_id long, text string")
    return {
        "small": spark.read.parquet(f"{small}/documents.parquet"),
        "cases": documents(spark).unionByName(marked, allowMissingColumns=True),
        "long": long_documents(spark),
        "empty": documents(spark).limit(0),
    }


def cuts(doc_id, text):
    """(n, form, prefix, middle, suffix) as the contract says it, over code points."""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    n = len(units)
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    plain = not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90
    return n, "plain" if plain else "spm" if h[3] % 100 < 20 else "psm", "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])


@pytest.mark.parametrize("name, every", [("small", 256), ("cases", 256), ("cases", 1), ("cases", 7), ("long", 256), ("empty", 256)])
def test_fill_in_middle(tables, name, every):
    docs = tables[name]
    rows = fim.transformed(docs, every=every).withColumn("text", fim.rebuilt()).collect()
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        text = r.text or ""
        n, form, p, m, s = cuts(r.doc_id, text)
        output = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        want[r.doc_id, n, form, None if form == "plain" else len(p), None if form == "plain" else len(m), output, text] += 1
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.text) for r in rows) == want


def test_forms_come_in_their_shares(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("some words, and more").alias("text"), F.lit(7).alias("n"), F.lit("x").alias("row"))
    made = fim.transformed(docs, keep=("doc_id", "n")).select("row.n", "form")
    forms = Counter(r.form for r in made.collect())
    assert {r.n for r in made.collect()} == {7}
    assert abs(forms["plain"] - 400) < 80 and abs(forms["spm"] - 720) < 120


@pytest.mark.parametrize("every, chunk", [(1, 5), (3, 7), (16, 1 << 18)])
def test_unit_index_finds_every_unit(monkeypatch, every, chunk):
    monkeypatch.setattr(fim, "CHUNK_BYTES", chunk)
    texts = ["", "abc", "abc", "", "ab c1é日本 x", "é", "a" * 40, "12 34", "zZé" * 9, "\n"]
    data, offsets = text_bytes(pa.array(texts))
    index = fim.UnitIndex(data, offsets, every)
    whole = "".join(texts)
    starts = []  # (byte, code point) of each unit of the batch, text by text
    byte = point = 0
    for text in texts:
        for unit in UNIT.findall(text):
            starts.append((byte, point))
            byte, point = byte + len(unit.encode()), point + len(unit)
    starts.append((len(whole.encode()), len(whole)))
    assert [index.locate(u) for u in range(len(starts))] == starts
    assert len(index.at_unit) == -(-(len(starts) - 1) // every)


def plain_divergence(rows, least, top):
    docs, counts, members = defaultdict(Counter), defaultdict(lambda: defaultdict(Counter)), defaultdict(set)
    for lang, source, text in rows:
        terms = TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        members[lang].add(source)
        docs[lang].update(set(terms))
        counts[lang][source].update(terms)
    out = []
    for lang, sources in members.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        count = {s: [counts[lang][s][t] for t in kept] for s in sources}
        count[None] = [sum(c) for c in zip(*count.values())] if kept else []
        share = {s: [1 + 10**9 * (n + 2) // (sum(c) + 2 * len(kept)) for n in c] for s, c in count.items()}
        for s in sources:
            pairs = [(sum((p - q) ** 2 // (p + q) for p, q in zip(share[s], share[o])), o) for o in sources if o != s]
            terms = [((p - q) ** 2 // (p + q), t) for p, q, n, t in zip(share[s], share[None], count[s], kept) if n and p > q]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked) if part == "pair" or k < top]
    return sorted(out)


@pytest.mark.parametrize("name, least, held, block", [("small", 10, 1 << 20, 1 << 21), ("small", 3, 500, 300), ("cases", 2, 1 << 20, 1 << 21), ("cases", 99, 1 << 20, 1 << 21), ("empty", 1, 1 << 20, 1 << 21)])
def test_divergence(tables, monkeypatch, name, least, held, block):
    monkeypatch.setattr(divergence, "HELD_CELLS", held)
    monkeypatch.setattr(divergence, "BLOCK_CELLS", block)
    docs = tables[name]
    if name == "cases":  # several sources, one without any term, and one that is null
        more = [(1, "One two THREE", "en", "s2"), (2, "one two two", "en", None), (3, "123", "en", "none"), (4, None, "en", "empty"), (5, "ärger Ärger two", "en", "s2"), (6, "one", None, None), (7, "one", None, "z")]
        docs = docs.select("doc_id", "text", "lang", "source").union(docs.sparkSession.createDataFrame(more, "doc_id long, text string, lang string, source string"))
    rows = [(r.lang or "", r.source or "", r.text or "") for r in docs.collect()]
    got = sorted(tuple(r) for r in divergence.divergences(docs, least, 10).collect())
    assert got == plain_divergence(rows, least, 10)


def test_tally_of_rows_beyond_one_number():
    rng = np.random.default_rng(2)
    columns = [rng.integers(0, 3, 500) * (1 << 40) for _ in range(4)]
    cells, n = divergence._tally(columns, np.ones(500, np.int64))
    assert Counter(zip(*(c.tolist() for c in columns))) == {tuple(k): v for *k, v in zip(*(c.tolist() for c in cells), n.tolist())}


def test_shares_do_not_overflow(spark):
    row = spark.sql("SELECT 40000000000000L AS n, 90000000000000000L AS total, 7L AS v").select(divergence._share("n", "total", "v").alias("p")).first()
    assert row.p == 1 + 10**9 * (40000000000000 + 2) // (90000000000000000 + 14)


def test_queries_are_registered():
    assert {"op12_fill_in_middle", "op13_source_divergence"} <= set(QUERIES)
