"""Scalar functions on cases that the tables lack."""

import pytest
from pyspark.sql import functions as F

from tidewell.functions import dates, pages, stem, tags, text, urls


def value(spark, expression, **columns):
    names = list(columns) or ["_"]
    row = spark.createDataFrame([tuple(columns.values()) or ("",)], ", ".join(f"{n} string" for n in names))
    return row.select(expression.alias("v")).first().v


@pytest.mark.parametrize(
    "raw, want",
    [("2026-06-18T10:00:00.123Z", "2026-06-18"), ("2026-06-18T23:30:00-03:00", "2026-06-19"), ("2026-06-18", "2026-06-18"), ("2026-06-18 23:59:59", "2026-06-18"), ("18 June 2026", "2026-06-18"), ("2026/06/18", "2026-06-18"), ("06/18/2026", "2026-06-18"), ("May 4, 2026", "2026-05-04"), (" June 18, 2026 ", "2026-06-18"), ("Jun 8, 2026", "2026-06-08"), ("Thu, 18 Jun 2026 10:00:00 +0000", "2026-06-18"), ("", None), ("soon", None), (None, None)],
)
def test_iso_date(spark, raw, want):
    assert value(spark, dates.iso_date(F.col("x")), x=raw) == want


@pytest.mark.parametrize("raw, want", [("2026-08-22", "2026-07-28"), ("2026-07-28", "2026-07-28"), ("2026-07-29", "2026-07-29"), ("2026-07-30", "2026-07-28"), ("June 1, 2026", "June 1, 2026"), (None, None), ("bad", "bad")])
def test_clamp_future(spark, raw, want):
    assert value(spark, dates.clamp_future(F.col("x"), F.lit("2026-07-28 10:00:00").cast("timestamp")), x=raw) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("https://www.Example.com/a/?utm_source=x&b=2&a=1#top", "https://www.example.com/a?a=1&b=2"),
        ("https://h.com/?ref=z&fbclid=1", "https://h.com"),
        ("https://h.com:8080/x/", "https://h.com:8080/x"),
        ("https://h.com:443/x", "https://h.com/x"),
        ("not a url", None),
        (None, None),
    ],
)
def test_normalize_url(spark, raw, want):
    assert value(spark, urls.normalize_url(F.col("x")), x=raw) == want


def test_other_urls(spark):
    assert value(spark, urls.domain_signature(F.col("x")), x="https://h.com/issues/123/x") == "h.com:listing:/issues/*"
    assert value(spark, urls.domain_signature(F.col("x"), "article"), x="https://h.com/issues") == "h.com:article"
    assert value(spark, urls.releases_url(F.col("x")), x="https://github.com/a/b/") == "https://github.com/a/b/releases"
    assert value(spark, urls.releases_url(F.col("x")), x="https://github.com/a/b/c") is None
    assert value(spark, urls.resolve(F.col("x"), F.lit("https://h.com/a/b")), x="../c") == "https://h.com/c"
    assert value(spark, urls.is_well_formed(F.col("x")), x="https://h.com/a%20utm_x=1") is False


@pytest.mark.parametrize("secret", ["hf_" + "a" * 24, "ghp_" + "A1" * 12, "sk-" + "a" * 40, "AKIA" + "A" * 16, "xoxb-1234567890-abc", "AWS_SECRET_ACCESS_KEY = " + "a" * 40, "eyJ" + "a" * 12 + "." + "b" * 12 + "." + "c" * 12, "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----"])
def test_redact(spark, secret):
    once = value(spark, text.redact(F.col("x")), x=f"a {secret} b")
    assert once == "a [REDACTED] b" and value(spark, text.redact(F.col("x")), x=once) == once


def test_redact_leaves_other_texts(spark):
    for kept in (None, "", "plain text with hf_short and sk-short", "12345678: no token"):
        assert value(spark, text.redact(F.col("x").cast("string")), x=kept) == kept


@pytest.mark.parametrize(
    "body, want",
    [("Website • / Docs • / Community • / Blog • / Changelog", True), ("• Home • Docs • Blog • About", True), ("https://a/b/c/d plain", False), ("One / two", False), ("a | | b | c | d", True), ("Version 1.2 | x | y | z", False), (None, False)],
)
def test_menu(spark, body, want):
    assert value(spark, text.starts_with_menu(F.col("x")), x=body) == want


def test_guards(spark):
    check = lambda f, x: value(spark, f(F.col("x")), x=x)
    assert check(text.is_json_page, '{"a": 1}') and not check(text.is_json_page, '{"a": 1') and not check(text.is_json_page, "null")
    assert check(text.is_json_like, '{"a": "' + "b" * 50) and not check(text.is_json_like, '{"a": 1}')
    assert check(text.looks_like_html, "<p>x</p>") and not check(text.looks_like_html, "a < b, Array<T>")
    assert value(spark, text.is_blocked_page(F.col("x"), F.lit("")), x="Just a moment...")
    assert check(text.is_release_note, "v1.2.3\n" + "x" * 60) and not check(text.is_release_note, "v1.2.3")
    assert check(text.ends_truncated, "All done. Read more") and check(text.without_trigger, "All done. Read more") == "All done."
    assert check(text.without_trigger, "I want to read more") == "I want to read more"
    assert check(text.section_title, "## Code & **Tools** ##") == "Code & Tools" and check(text.section_title, "🛠 Code & Tools:") == "Code & Tools"
    assert check(text.section_title, "More news next week.") is None and check(text.section_title, "## [x](http://y)") is None


def test_frame(spark):
    framed = "Published on Aug 12, 2026, filed under development. (Share this post.) The body stays. Share this post with all"
    assert value(spark, text.without_frame(F.col("x")), x=framed) == "The body stays."
    assert value(spark, text.without_frame(F.col("x")), x="and subscribe to the changelog") == "and subscribe to the changelog"


def test_spans(spark):
    body = "Keep this sentence as it is. " * 20 + "JUNK HERE"
    cut = value(spark, text.without_spans(F.col("x"), F.array(F.lit("JUNK HERE"), F.lit("abc"), F.lit("not there"))), x=body)
    assert cut.text == ("Keep this sentence as it is. " * 20).strip() and (cut.applied, cut.not_found, cut.rejected) == (1, 1, False)
    whole = value(spark, text.without_spans(F.col("x"), F.array(F.lit("all of it"))), x="all of it")
    assert whole.rejected and whole.text == "all of it"


def test_folds(spark):
    assert value(spark, text.slugify(F.col("x")), x="Época ﬁne — Ünï!") == "epoca-fine-uni"
    assert value(spark, text.slugify(F.col("x")), x=None) == "untitled"
    assert value(spark, text.fold(F.col("x")), x="Été ﬁ") == "ete ﬁ"
    assert value(spark, text.match_expression(F.col("x")), x="postgres AND a vector") == '"postgres" OR "and" OR "vector"'
    assert value(spark, text.match_expression(F.col("x")), x=" ?! ") is None
    assert value(spark, text.tolerant_json(F.col("x")).cast("string"), x='said: {"a":1} ok') == '{"a":1}'


def test_tag_rules(spark):
    v = value(spark, tags.valid_tags(F.array(F.lit(" React "), F.lit("JS"), F.lit("js"), F.lit("zzz")), F.array(F.lit("react"), F.lit("javascript")), F.create_map(F.lit("js"), F.lit("javascript"), F.lit("zzz"), F.lit("elsewhere")), 5))
    assert v.tags == ["react", "javascript"] and v.dropped == ["zzz"]
    full = F.create_map(*(x for f in tags.MANDATORY for x in (F.lit(f), F.lit(1))))
    none = F.array().cast("array<string>")
    assert value(spark, tags.classification_status(none, full)) == "done"
    assert value(spark, tags.classification_status(F.array(F.lit("difficulty")), full)) == "partial"
    assert value(spark, tags.classification_status(F.array(F.lit("domain")), full)) is None
    assert value(spark, tags.classification_status(none, F.create_map(F.lit("domain"), F.lit(1)))) == "partial"


@pytest.mark.parametrize("word, want", [("caresses", "caress"), ("ponies", "poni"), ("running", "run"), ("agreed", "agre"), ("hopping", "hop"), ("filing", "file"), ("relational", "relat"), ("adjustable", "adjust"), ("controlling", "control"), ("happy", "happi"), ("sky", "sky")])
def test_stem(word, want):
    assert stem.stem(word) == want


PAGE = """<html><head><title>T</title><script type="application/ld+json">{"@graph": [{"dateModified": "2020-01-01", "datePublished": "2026-05-04"}]}</script></head><body><nav><a href="/n">n</a></nav>
<article><h1>Head <b>line</b></h1><p>One</p><p>Two &amp; three</p><ul><li><a href="/x?page=3">X</a> <time datetime="2026-01-02">then</time></li></ul></article><a href="?page=3">next</a></body></html>"""


def test_pages():
    assert pages.title(PAGE) == "Head line" and pages.published_date(PAGE, 2026) == "2026-05-04"
    assert pages.published_date("<body><h1>637</h1><p>August 13th, 2026</p></body>", 2026) == "August 13, 2026"
    assert pages.published_date("<body>May 4, 2019</body>", 2026) is None
    assert pages.links(PAGE, "https://h.com/a")[1] == ("https://h.com/x?page=3", "X")
    assert pages.block_text("<h1>A</h1><p>B<br>C</p>") == "A\nB\nC"
    assert pages.plain_text("a < b &amp; c") == "a < b & c" and pages.plain_text("<p>One</p><p>Two</p>") == "One Two"
    assert pages.next_page(PAGE, "https://h.com/l?page=2") == "https://h.com/x?page=3"
    assert pages.selected_links(PAGE, "ul li a", "https://h.com") == [("https://h.com/x?page=3", "X", "2026-01-02")]
    assert pages.markdown("<h2>T</h2><p>a <b>b</b> <a href='/c'>c</a></p>", "https://h.com") == "## T\n\na **b** [c](https://h.com/c)"
    assert pages.chunks("aa\n\nbb\n\n" + "c" * 9, 6) == ["aa\n\nbb", "cccccc"]
    assert pages.release_text("<main><div>" + "note " * 100 + "<a>View changes on GitHub</a></div></main>") == ("note " * 100).strip()


def test_titles_of_the_query_keep_references_that_its_sql_keeps(spark, tmp_path):
    from tidewell.plans.catalogue import QUERIES

    said = ["a &amp;&amp; b&amp", "key = &quot;7&#33;", "&amp;lt; &lt;b&gt;", " two\n words "]
    spark.createDataFrame([(k, "https://h.com", f"<title>no</title><h1>{x}</h1>") for k, x in enumerate(said)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r.title for r in QUERIES["html_titles"](spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(["a && b&amp", "key = &quot;7&#33;", "&lt; <b>", "two words"]))
    assert pages.title("<h1>a &quot;b&quot; &amp</h1>") == 'a "b" &'  # the operator itself decodes as a browser does


@pytest.mark.parametrize("name", ["html_text", "html_markdown"])
def test_batches_of_pages_are_bounded_by_their_bytes(spark, tmp_path, name):
    """8,000 pages of 4 KB would come as one batch of 32 MB."""
    from tidewell.plans.catalogue import QUERIES

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.unset(key)
    try:
        spark.range(0, 8000, 1, 1).select(F.col("id").alias("page_id"), F.lit("https://h.com").alias("url"), F.repeat(F.lit("<p>a"), 1000).alias("html")).write.parquet(str(tmp_path / "pages.parquet"))
        QUERIES[name](spark, str(tmp_path))
        rows = spark.read.parquet(str(tmp_path / "pages.parquet")).select("html").mapInPandas(lambda frames: (f.assign(html=str(len(f))) for f in frames), "html string")
        assert max(int(r.html) for r in rows.distinct().collect()) <= 1200
    finally:
        if before is not None:
            spark.conf.set(key, before)
