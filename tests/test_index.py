"""The maintained text index against a full rebuild."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidewell.operators import retrieval
from tidewell.operators.index import TextIndex
from tidewell.sources.tables import Tables

TERMS = ["the", "and", "ation", "the", "stupid", "nowhere"]


def rebuilt(docs, terms=TERMS):
    found = retrieval.bm25(retrieval.postings(docs), retrieval.corpus_stats(docs), terms)
    return {r.id: round(r.score, 9) for r in found.collect()}


def scores(index, terms=TERMS):
    return {r.id: round(r.score, 9) for r in index.search(terms).collect()}


def put(docs, seq=1, op="put"):
    return docs.select("id", "title", "content").withColumns({"op": F.lit(op), "seq": F.lit(seq)})


def files(folder):
    return {str(p): (p.stat().st_mtime_ns, p.stat().st_size) for p in Path(folder).rglob("*.parquet") if "manifest" not in str(p)}


@pytest.fixture(scope="module")
def articles(spark, small):
    return Tables(spark, small).articles().select("id", "title", "content").persist()


def test_changes_equal_a_rebuild(spark, articles, tmp_path):
    index = TextIndex(spark, str(tmp_path / "index"), buckets=8)
    assert index.search(TERMS).count() == 0 and index.stats().first().docs == 0
    index.apply(put(articles.where("id < 150")))
    assert scores(index) == rebuilt(articles.where("id < 150"))
    before = files(tmp_path)
    # inserts, replacements, removals and one of an id that never was; the last change of an id counts
    changes = put(articles.where("id >= 150")).union(put(articles.where("id < 20").withColumn("title", F.lit("the the stupid")), 2)).union(put(articles.where("id < 20"), 1))
    changes = changes.union(put(articles.where("id BETWEEN 30 AND 60"), 3, "delete")).union(spark.createDataFrame([(9999, None, None, "delete", 1), (None, "the", "and", "put", 1)], changes.schema))
    index.apply(changes)
    now = articles.where("id NOT BETWEEN 30 AND 60").withColumn("title", F.when(F.col("id") < 20, "the the stupid").otherwise(F.col("title")))
    assert scores(index) == rebuilt(now)
    assert {p: files(tmp_path)[p] for p in before} == before  # nothing was written again
    assert index.stats().first().docs == now.count() == index.documents().count()
    index.apply(put(articles.where("id = 40")))  # a removed id comes back
    now = now.union(articles.where("id = 40"))
    assert scores(index) == rebuilt(now) and scores(index, []) == {} and set(scores(index, ["zzz"])) == set()
    assert index.merge() == []  # one document is smaller than what stands before it
    small = files(tmp_path)
    assert index.merge(growth=1e9) == [3, 2, 1]
    assert scores(index) == rebuilt(now) and [p.kind for p in index.parts()[1]].count("removed") == 0
    assert {p: files(tmp_path)[p] for p in small} == small
    index.apply(put(now, 1, "delete"))
    assert scores(index) == {} and index.stats().first().docs == 0


def test_only_the_newest_small_segments_are_merged(spark, articles, tmp_path):
    index = TextIndex(spark, str(tmp_path / "index"), buckets=8)
    index.apply(put(articles))
    first = {p: s for p, s in files(tmp_path).items() if "segment=1" in p}
    for k in range(5):
        index.apply(put(articles.where(F.col("id") == k).withColumn("title", F.lit(f"stupid the {k}"))))
        index.merge()
    segments = sorted(p.segment for p in index.parts()[1] if p.kind == "segment")
    assert segments[0] == 1 and len(segments) <= 4 and {p: files(tmp_path)[p] for p in first} == first
    now = articles.withColumn("title", F.when(F.col("id") < 5, F.concat(F.lit("stupid the "), F.col("id").cast("string"))).otherwise(F.col("title")))
    assert scores(index) == rebuilt(now)


def test_a_stream_applies_each_batch_once(spark, articles, tmp_path):
    index = TextIndex(spark, str(tmp_path / "index"), buckets=8)
    for k in range(3):
        put(articles.where(F.col("id") % 3 == k), k).coalesce(1).write.mode("append").parquet(str(tmp_path / "changes"))
    stream = spark.readStream.schema(put(articles).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "changes"))
    index.follow(stream, str(tmp_path / "checkpoint"), "feed").awaitTermination(120)
    assert scores(index) == rebuilt(articles)
    version, parts = index.parts()
    last = next(p.rows for p in parts if p.kind == "stream")
    assert last == 2 and not index.apply(put(articles, 9, "delete"), "feed", last)  # a batch that comes again changes nothing
    assert index.parts()[0] == version and scores(index) == rebuilt(articles)
    index.follow(stream, str(tmp_path / "another"), "feed").awaitTermination(120)  # nor does a stream that starts over
    assert index.parts()[0] == version


def test_a_failed_batch_leaves_the_index_as_it_was(spark, articles, tmp_path):
    index = TextIndex(spark, str(tmp_path / "index"), buckets=8)
    index.apply(put(articles.where("id < 50")))
    want = scores(index)
    broken = put(articles).withColumn("title", F.when(F.col("id") < 100, F.col("title")).otherwise(F.raise_error(F.lit("no")).cast("string")))
    with pytest.raises(Exception, match="no"):
        index.apply(broken)
    assert scores(index) == want
    index.apply(put(articles))
    assert scores(index) == rebuilt(articles)


def test_lookups_read_the_buckets_of_their_terms(spark, articles, tmp_path):
    index = TextIndex(spark, str(tmp_path / "index"), porter=True)
    index.apply(put(articles.withColumn("title", F.lit("Running shoes"))))
    hits = index.lookup(["run"])
    assert hits.count() == articles.count()
    plan = hits._jdf.queryExecution().executedPlan().toString()
    own = spark.range(1).select(index.bucket(F.lit("run"))).first()[0]
    assert re.search(rf"PartitionFilters: \[[^]]*bucket#\d+ (IN \({own}\)|= {own})\)?[^]]*\]", plan), plan
    assert "EqualTo(term,run)" in plan or "In(term, [run])" in plan
    whole = spark.read.parquet(str(tmp_path / "index/postings"))
    assert {r.bucket for r in whole.where("term = 'run'").select("bucket").distinct().collect()} == {own}


def test_tasks_that_cut_texts_follow_the_batch(spark, articles, tmp_path, monkeypatch):
    from tidewell.operators import index as module

    monkeypatch.setattr(module, "TASK_BYTES", 1 << 14, raising=False)
    seen, write = [], TextIndex._write
    monkeypatch.setattr(TextIndex, "_write", lambda self, docs, posted, *where: seen.append(docs.rdd.getNumPartitions()) or write(self, docs, posted, *where))
    index = TextIndex(spark, str(tmp_path / "index"), buckets=8)
    index.apply(put(articles))
    size = articles.agg(F.sum(F.octet_length("title") + F.octet_length("content"))).first()[0]
    assert seen == [1 + size // (1 << 14)] and seen[0] > 4 and scores(index) == rebuilt(articles)
