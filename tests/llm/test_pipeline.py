"""The corpus pipeline: columns, decisions and a brute-force check of its stages."""

import re

import corpus_pipeline
from cases import documents
from pyspark.sql import functions as F

from tidewell.llm import quality, secrets


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def test_stages_in_order(spark, small):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "suffix_array_dedup", "secret_scans", "packing"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["quality_rules"](spark, docs, small)
    assert kept.columns == docs.columns
    rules = quality.fit_list(docs, spark.read.parquet(f"{small}/labels.parquet"))
    want = {r.doc_id for r in quality.verdicts(docs, rules).where("kept").select("row.doc_id").collect()}
    rows = {r.doc_id: r.asDict() for r in kept.collect()}
    assert set(rows) == want
    assert rows == {r.doc_id: r.asDict() for r in docs.collect() if r.doc_id in want}

    unique = stages["ngram_jaccard_join"](spark, kept, small)
    sets = {d: shingles(r["text"]) for d, r in rows.items()}
    root = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    assert {r.doc_id for r in unique.collect()} == {d for d, r in root.items() if d == r}

    trimmed = stages["suffix_array_dedup"](spark, unique, small)
    first = set()
    got = {r.doc_id: r for r in trimmed.collect()}
    for r in sorted(unique.collect(), key=lambda r: r.doc_id):
        raw = r.text.encode()
        gone = [False] * len(raw)
        for k in range(len(raw) - 99):
            window = raw[k : k + 100]
            if window in first:
                gone[k : k + 100] = [True] * 100
            first.add(window)
        text = bytes(b for b, g in zip(raw, gone) if not g).decode("utf-8", "ignore")
        assert got[r.doc_id].text == text and got[r.doc_id].n_chars == len(text)

    clean = stages["secret_scans"](spark, trimmed, small)
    assert clean.columns == docs.columns
    for r in clean.collect():
        assert not secrets.base_spans(r.text) and r.n_chars == len(r.text)
    assert stages["packing"](spark, clean, small).select("doc_id").distinct().count() == len(got)


def test_run_and_awkward_documents(spark, small, tmp_path):
    assert corpus_pipeline.run(spark, small).count() > 0
    folder = str(tmp_path)
    spark.read.parquet(f"{small}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    for k, docs in enumerate((documents(spark), documents(spark).limit(0))):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            assert name == "packing" or out.columns == docs.columns
            out.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    docs = documents(spark)
    some = corpus_pipeline.near_duplicates(spark, docs, folder)
    assert some.where(F.col("doc_id").isNull()).count() == 1


def test_a_repeated_id_loses_only_its_duplicate_text(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, text), (2, text), (2, "quite another text that nothing else in the table has")], "doc_id long, text string")
    assert {tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {(1, text), (2, "quite another text that nothing else in the table has")}


def test_each_group_keeps_one_document(spark):
    text = " ".join(f"word{k}" for k in range(40))
    other = " ".join(f"term{k}" for k in range(40))
    rows = [(1, text), (1, text + " end"), (5, text), (None, other), (None, other + " end"), (None, other), (7, ""), (7, None), (None, ""), (8, "lone text of its own words and no copy"), (8, text + " last end")]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    of = lambda start: [r for r in kept if (r.text or "").startswith(start)]
    assert len(of("word0 ")) == 1 and of("word0 ")[0].doc_id == 1
    assert len({r.text for r in of("term0 ")}) == 1 and all(r.doc_id is None for r in of("term0 "))
    assert len(of("lone")) == 1 and len([r for r in kept if not r.text]) == 3
