"""Curation, reports and controllers."""

import datetime

from pyspark.sql import functions as F

from tidewell.operators import curation
from tidewell.plans import report
from tidewell.sources.tables import Tables
from tidewell.streaming import control


def test_sections(spark):
    body = "x" * 30
    docs = spark.createDataFrame([(1, f"intro {body}\n## News\n{body}\n**TOOLS:**\n{body}\nshort"), (2, "no labels here"), (3, None), (4, f"{'p' * 60}\n\n{'q' * 60}")], "id long, markdown string")
    rows = curation.sections(docs, most_chars=100).orderBy("id", "part").collect()
    assert [(r.id, r.section) for r in rows] == [(1, None), (1, "News"), (1, "TOOLS"), (2, None), (4, None), (4, None)]


def test_consolidated(spark):
    items = [("https://n.com/1", 0, "https://a.com/x?utm_source=n", " A  b ", "news", "News", None), ("https://n.com/1", 1, "https://a.com/x", "again", "tool", None, None), ("https://n.com/1", 2, "https://n.com/2", "self", "news", None, None), ("https://n.com/1", 3, "bad", "bad", "news", None, None), ("https://n.com/1", 4, "https://s.com", "Sponsored: buy", "news", None, None), ("https://n.com/1", 5, "https://j.com", "dev", "news", "Hiring", None), ("https://n.com/1", 6, "https://o.com", "o", "video", None, None)]
    kept, skipped = curation.consolidated(spark.createDataFrame(items, "issue_url string, pos int, url string, title string, kind string, section string, blurb string"))
    assert [(r.url, r.title, r.kind) for r in kept.collect()] == [("https://a.com/x", "A b", "news")]
    assert {r.reason: r.n for r in skipped.collect()} == {"internal": 1, "invalid": 1, "sponsor": 1, "job": 1, "other": 1}


def test_guards_and_dedup(spark):
    rows = [(0, "https://a.com/1/", "t", "body " * 40), (1, "https://a.com/1?utm_x=1", "t", "other " * 40), (2, "https://a.com/2", "t", "body " * 40), (3, "https://a.com/3", "Just a moment...", "x"), (4, "https://a.com/4", "t", "tiny"), (5, "https://a.com/5", "404 error: not found", "gone"), (6, "https://k.com/1", "t", "known " * 40)]
    fetched = spark.createDataFrame(rows, "pos int, url string, title string, content string")
    outcomes = [r.o for r in fetched.orderBy("pos").select(curation.article_outcome(F.col("title"), F.col("content")).alias("o")).collect()]
    assert outcomes == ["stored", "stored", "stored", "blocked", "thin", "error", "stored"]
    known = spark.createDataFrame([("https://k.com/1", "h")], "url string, content_hash string")
    assert {r.url for r in curation.new_articles(fetched.where("pos in (0, 1, 2, 6)"), known).collect()} == {"https://a.com/1"}


def test_host_rules(spark):
    urls = spark.createDataFrame([("https://a.com/private/x",), ("https://a.com/ok",), ("https://b.com/private",)], "url string")
    robots = spark.createDataFrame([("a.com", "/private"), ("a.com", "/zzz"), ("b.com", "")], "host string, disallow string")
    assert {r.url for r in curation.allowed(urls, robots).collect()} == {"https://a.com/ok", "https://b.com/private"}
    facts = spark.createDataFrame([("a.com", True)], "host string, needs_script boolean")
    assert [r.needs_script for r in curation.with_host_fact(urls, facts, "needs_script", False).orderBy("url").collect()] == [True, True, False]


def test_repaired(spark):
    row = spark.createDataFrame([("Notes. View on GitHub", "Notes. And much more of them.")], "c string, r string")
    assert row.select(curation.repaired(F.col("c"), F.col("r"))).first()[0] == "Notes. And much more of them."
    assert row.select(curation.repaired(F.col("c"), F.lit("x"))).first()[0] == "Notes."


def test_report(spark, small):
    t = Tables(spark, small)
    parts = report.run_report(3, t.verified(), t.events())
    n = t.articles().where("run_id = 3").count()
    assert all(parts[k].agg(F.sum("n")).first()[0] == n for k in ("kinds", "statuses", "issues"))
    assert report.latest_scope(t.articles()).select("run_id").distinct().collect()[0].run_id == 5
    todo, kept = report.resumed_verdicts(t.articles().select("id"), t.articles().where("id < 10").select("id").union(spark.createDataFrame([(10**9,)], "id long")))
    assert kept.count() == 10 and todo.count() == t.articles().count() - 10
    assert report.history(t.searches(), t.events()).count() == t.searches().count()


def test_controllers(spark):
    scrolls = spark.createDataFrame([("p", 1, True, 5, "2026-03-01"), ("p", 2, False, 0, "2026-03-01"), ("p", 3, False, 0, None), ("p", 4, False, 0, None), ("q", 1, True, 2, "2025-01-01")], "page string, seq int, grew boolean, new long, oldest string")
    assert {r.page: r.why for r in control.scroll_decision(scrolls, "2026-01-01").collect()} == {"p": "plateau", "q": "floor"}
    lanes = spark.createDataFrame([("a", 100, True), ("a", 200, True), ("a", 10_300, False), ("a", 10_400, False)], "lane string, at_ms long, limited boolean")
    assert control.lane_limit(lanes, 8).first().width == 3
    penalty = spark.createDataFrame([(3, None), (20, None), (0, 90_000)], "k int, after long").select(control.penalty_ms(F.col("k"), F.col("after"), F.lit(0.0)))
    assert [r[0] for r in penalty.collect()] == [8000, 60_000, 90_000]
    phases = spark.createDataFrame([("j", "fetch", 0, 40), ("j", "wait", 40, 900), ("j", "parse", 900, 1000)], "job string, phase string, start_ms long, end_ms long")
    assert tuple(control.work_time(phases, 100).first()) == ("j", 140, True)


def test_extracted_date_is_a_day(spark, small):
    from tidewell.plans.browse import dated

    assert isinstance(dated(Tables(spark, small).articles()).first().date_iso, datetime.date)
