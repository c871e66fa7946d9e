"""State machines, writes, streams, sources and exports."""

import json

import pytest
from pyspark.sql import functions as F

from tidewell.operators import filters, judge, retrieval, writes
from tidewell.plans import export
from tidewell.sources import readers, schemas
from tidewell.sources.tables import Tables
from tidewell.streaming import queue


def stream(spark, rows, schema, folder, batches=2):
    """The rows as a file stream of several micro-batches."""
    for k in range(batches):
        part = [r for i, r in enumerate(rows) if i * batches // max(1, len(rows)) == k]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_frontier(spark, tmp_path):
    rows = [("u", 1, "enqueue"), ("u", 2, "claim"), ("u", 3, "error"), ("u", 4, "claim"), ("u", 5, "budget"), ("u", 6, "claim"), ("u", 7, "success"), ("v", 8, "enqueue")] + [("w", 9, "enqueue")] + [("w", 10 + k, e) for k, e in enumerate(["claim", "error"] * 4)]
    found = queue.collected(queue.frontier_states(stream(spark, rows, "url string, seq long, event string", str(tmp_path / "s"), 1)), "frontier_out")
    last = {r.url: (r.state, r.retries) for r in found.orderBy("seq").collect()}
    assert last == {"u": ("done", 1), "v": ("pending", 0), "w": ("failed", 3)}


def test_breaker(spark, tmp_path):
    calls = [("h", k, k * 10, False) for k in range(5)] + [("h", 5, 100, True), ("h", 6, 60_050, False), ("h", 7, 61_000, True), ("h", 8, 190_000, True), ("h", 9, 190_001, False)]
    found = queue.collected(queue.breaker_states(stream(spark, calls, "host string, seq long, at_ms long, ok boolean", str(tmp_path / "s"), 1)), "breaker_out")
    rows = [(r.admitted, r.state) for r in found.orderBy("seq").collect()]
    assert rows == [(True, "closed")] * 4 + [(True, "open"), (False, "open"), (True, "open"), (False, "open"), (True, "closed"), (True, "closed")]


def test_ledger(spark, tmp_path):
    ops = [(1, 1, "reserve", 9.0), (1, 2, "commit", 2.0), (1, 3, "reserve", 1.0), (1, 4, "cancel", 1.0), (1, 5, "reserve", 0.5), (1, 6, "reserve", 100.0), (1, 7, "reserve", 0.1)]
    found = queue.collected(queue.ledger_states(stream(spark, ops, "run_id long, seq long, op string, amount double", str(tmp_path / "s"), 1), 5.0), "ledger_out")
    rows = [(r.admitted, r.spent, r.stopped) for r in found.orderBy("seq").collect()]
    assert rows[0] == (True, 0.0, False) and rows[1] == (None, 2.0, False)
    assert rows[-1] == (False, 2.0, True)


def test_milestones_match_batch(spark, tmp_path, small):
    from tidewell.operators.ordering import coalesced

    events = Tables(spark, small).events().where("run_id < 5").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = [tuple(r) for r in events.orderBy("ts", "event_id").select("run_id", F.row_number().over(__import__("pyspark").sql.Window.orderBy("ts", "event_id")).cast("long"), F.unix_millis("ts"), "stage").collect()]
    found = queue.collected(queue.milestones(stream(spark, rows, "run_id long, seq long, ts_ms long, stage string", str(tmp_path / "s"), 1), 3_600_000), "milestones_out")
    got = {(r.run_id, r.island): r.n for r in found.groupBy("run_id", "island").agg(F.max("n").alias("n")).collect()}
    want = {(r.run_id, r.island): r.n for r in coalesced(events, 3_600_000).collect()}
    assert got == want


def test_windows_and_sink(spark, tmp_path, small):
    events = Tables(spark, small).events().withColumn("ts", F.col("ts").cast("timestamp"))
    folder = str(tmp_path / "events")
    events.write.parquet(folder)
    live = spark.readStream.schema(events.schema).parquet(folder)
    counted = queue.collected(queue.windowed_counts(live), "windows_out", "complete")
    assert counted.agg(F.sum("n")).first()[0] == events.count()
    queue.appended(live, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()


def test_archive(spark):
    spark.dataSource.register(readers.ArchivePages)
    page = lambda *items: [{"url": u, "title": u, "post_date": d, "type": t} for u, d, t in items]
    pages = [page(("a", "2026-03-01", "newsletter"), ("b", "2026-02-01", "podcast")), page(("a", "2026-03-01", "newsletter"), ("c", "2026-01-15", "newsletter")), page(("d", "2025-12-01", "newsletter"))]
    rows = spark.read.format("archive").option("pages", json.dumps(pages)).option("since", "2026-01-01").option("page_size", "2").load().collect()
    assert {(r.url, r.page) for r in rows} == {("a", 0), ("c", 1)}
    assert spark.read.format("archive").load().count() == 0


def test_config_files(spark, tmp_path):
    assert readers.configured_sources(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "s.json").write_text('{"sources": [{"name": "A", "base_url": "https://a", "type": "index"}]}')
    assert [r.name for r in readers.configured_sources(spark, str(tmp_path / "s.json")).collect()] == ["A"]
    (tmp_path / "t.json").write_text('{"facets": {"domain": ["x", "y"]}}')
    assert {(r.facet, r.position, r.tag) for r in readers.taxonomy(spark, str(tmp_path / "t.json")).collect()} == {("domain", 0, "x"), ("domain", 1, "y")}


def test_schemas(spark):
    odd = spark.createDataFrame([(1, "u", "extra")], "id int, url string, other string")
    assert schemas.conform(odd, "articles").schema.fieldNames() == schemas.SCHEMAS["articles"].fieldNames()
    assert schemas.duplicate_keys(odd.union(odd), "url").first().n == 2


def test_source_removal(spark, small):
    t = Tables(spark, small)
    left = writes.without_source(3, t.articles(), {"tags": t.tags()}, t.searches())
    gone = {r.id for r in t.articles().where("source_id = 3").select("id").collect()}
    assert gone and not gone & {r.id for r in left["articles"].select("id").collect()}
    assert not gone & {r.article_id for r in left["tags"].select("article_id").distinct().collect()}


def test_runs(spark):
    runs = spark.createDataFrame([], schemas.SCHEMAS["runs"])
    opened = writes.opened_run(runs, 1, "crawl", "{}", 5.0, "2026-01-01 00:00:00")
    closed = writes.closed_run(opened, 1, "done", 7, "2026-01-01 01:00:00").first()
    assert (closed.status, closed.new_count, closed.command) == ("done", 7, "crawl")


def test_lookup_helpers(spark, small):
    sources = Tables(spark, small).sources()
    found, missing = filters.select_sources(sources, [sources.orderBy("id").first().name.lower(), "nobody"])
    assert found.count() == 1 and missing == ["nobody"]
    with pytest.raises(LookupError):
        filters.find_one(sources, "zzz")
    assert filters.page_limits(None, -3) == (24, 0) and filters.page_limits(500, 5) == (100, 5)
    assert filters.active_filters({"a": ["x", "y"], "b": None, "c": {"f": ["t"]}, "d": "z"}) == 4
    assert filters.normalized_scope({"sourceId": 4}) == {"sourceIds": [4]}


def test_judges(spark, small):
    articles = Tables(spark, small).articles().limit(90)
    judged = judge.judged_in_batches(articles.select("id", "title"), lambda rows: [{"id": r["id"], "relation": "direct", "kind": "tool"} for r in rows if r["id"] % 2], size=7, spread=3).collect()
    assert len(judged) == 90 and all((r.relation == "direct") == bool(r.id % 2) for r in judged)

    def broken(rows):
        raise RuntimeError("no answer")

    assert all(r.failed and r.relation == "none" for r in judge.judged_in_batches(articles.select("id"), broken).collect())
    said = judge.answered(articles.select("id", "title"), lambda r: {"tag": "x"} if r["id"] else 1 / 0, "tag string").collect()
    assert sum(r.error is not None for r in said) == 1 and sum(r.tag == "x" for r in said) == 89
    spans = spark.createDataFrame([("line one\nother\nline one",)], "x string").select(judge.junk_spans(F.col("x"))).first()[0]
    assert spans == ["line one"]


def test_retrieval_pieces(spark):
    docs = spark.createDataFrame([(1, "Running shoes", "they run"), (2, "Walk", "a runner runs"), (3, "None", "nothing")], "id long, title string, content string")
    posted = retrieval.postings(docs, porter=True)
    assert {r.id for r in retrieval.bm25(posted, retrieval.corpus_stats(docs), ["run"]).collect()} == {1, 2}
    assert retrieval.hybrid_mode("", 500, 1, 1) == "none" and retrieval.hybrid_mode("q", 500, 1, 0) == "lexical" and retrieval.hybrid_mode("q", 500, 1, 1) == "hybrid"
    vectors = retrieval.embedded(docs, docs.where("id = 3"))
    assert {r.id for r in vectors.collect()} == {1, 2}
    rows = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "id long, pos int")
    scores = spark.createDataFrame([(1, 0.1), (2, 0.9), (3, 0.5)], "id long, rerank double")
    assert [r.id for r in retrieval.reordered(rows, scores, 2).collect()] == [2, 3]


def test_snapshot_is_the_same_twice(spark, small, tmp_path):
    from tidewell.plans.browse import dated

    t = Tables(spark, small)
    for k in (1, 2):
        export.write_snapshot(export.snapshot(dated(t.articles()), t.tags()), str(tmp_path / str(k)))
    one, two = (readers.snapshot(spark, str(tmp_path / str(k))) for k in (1, 2))
    assert one["articles"].exceptAll(two["articles"]).count() == 0
    assert export.changed(one["articles"], two["articles"], "id", ("snippet",)).count() == 0
    assert "kind" in one["articles"].columns
    export.write_markdown(export.markdown_file(t.articles().limit(5), t.tags()), str(tmp_path / "md"))
    assert export.deploy_plan(False, False, False, True) == "nothing"


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_slots_of_a_hot_key_equal_one_window(spark, monkeypatch):
    """Slots of 8 numbers or a day, a key with most rows, null keys and keys with a gap between slots."""
    import datetime
    import random

    from tidewell.operators import joins, ordering

    monkeypatch.setattr(ordering, "SLOT_NUMBERS", 8)
    draw = random.Random(3)
    start = datetime.datetime(2024, 3, 1)
    rows = []
    for seq in range(300):
        key = draw.choice([1, 1, 1, 1, 2, None])
        rows.append((key, seq if key != 2 else 3 * seq, start + datetime.timedelta(hours=draw.choice([5, 7]) * seq, minutes=seq), seq, draw.choice("ab"), draw.choice([1, 2, 40]), float(draw.choice([1, 2, 4]))))
    df = spark.createDataFrame(rows, "run_id long, seq long, ts timestamp, event_id long, stage string, gap long, cost_usd double").cache()
    of = {key: sorted(r for r in rows if r[0] == key) for key in (1, 2)} | {None: sorted(r[1:] for r in rows if r[0] is None)}
    of[None] = [(None, *r) for r in of[None]]

    free, spent, starts, calls = {}, {}, [], []
    for key, own in of.items():
        for r in own:
            at = max(2 * r[1], free.get(key, 2 * r[1]))
            free[key] = at + r[5]
            starts.append((str(key), r[1], at))
            calls.append((str(key), r[1], spent.get(key, 0.0), key not in spent or spent[key] + r[6] <= 90))
            spent[key] = spent.get(key, 0.0) + r[6]
    got = ordering.host_timeline(df.withColumn("arrival", 2 * F.col("seq")), "run_id")
    assert sorted((str(r.run_id), r.seq, r.start) for r in got.collect()) == sorted(starts)
    assert sorted((str(r.run_id), r.seq, r.spent, r.admitted) for r in ordering.admitted(df, 90.0).collect()) == sorted(calls)

    islands = []
    for key, own in of.items():
        before, n = None, 0
        for r in sorted(own, key=lambda r: (r[2], r[3])):
            n += before is None or before[4] != r[4] or r[2] - before[2] > datetime.timedelta(hours=9)
            islands.append((str(key), n))
            before = r
    got = ordering.coalesced(df, 9 * 3_600_000)
    assert {(str(r.run_id), r.island): r.n for r in got.collect()} == {i: islands.count(i) for i in islands}

    asked, told = df.where("stage = 'a'").select("run_id", "ts", "event_id"), df.where("stage = 'b' AND event_id % 5 < 3").select("run_id", "ts", F.when(F.col("event_id") % 5 > 0, F.col("event_id")).alias("told"))
    want = []
    for key, own in of.items():
        for r in own:
            if r[4] == "a":
                earlier = [(o[2], o[3]) for o in own if o[4] == "b" and o[3] % 5 in (1, 2) and o[2] <= r[2]]
                want.append((r[3], max(earlier)[1] if earlier else -1))
    got = joins.as_of(asked, told, "run_id", "ts", "told")
    assert sorted((r.event_id, -1 if r.told is None else r.told) for r in got.collect()) == sorted(want)
    df.unpersist()


def test_pages_that_share_a_url_have_signals_of_their_own(spark, tmp_path):
    from tidewell.plans.catalogue import QUERIES

    link = '<a href="/p/1">x</a>'
    spark.createDataFrame([(1, "https://h.com/a", link), (2, "https://h.com/a", 3 * link), (3, "https://h.com/b", link)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert sorted(map(tuple, QUERIES["page_signals"](spark, str(tmp_path)).collect())) == [(1, 1), (2, 3), (3, 1)]


def test_rounding_by_slots_decides_no_admission(spark, monkeypatch):
    from tidewell.operators import ordering

    monkeypatch.setattr(ordering, "SLOT_NUMBERS", 8)
    costs = [(1, 0.1), (8, 0.2), (9, 0.3), (10, 0.0), (17, 0.0)]  # in order 0.6000000000000001, but 0.1 + (0.2 + 0.3) is 0.6
    calls = spark.createDataFrame([(run, seq, cost) for run in (1, None) for seq, cost in costs], "run_id long, seq long, cost_usd double")
    got = sorted((str(r.run_id), r.seq, r.admitted) for r in ordering.admitted(calls, 0.6).collect())
    assert got == [(run, seq, seq < 9) for run in ("1", "None") for seq, _ in costs]
