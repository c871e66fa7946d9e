"""Operators on pages: URL rules and main text."""

import pytest
from pyspark.sql import functions as F

from tidewell.llm import html, urls
from tidewell.llm.urls import host_and_path
from tidewell.llm.queries import ORACLES, QUERIES, URL_RULES


def brute_rule(host, path, rules):
    fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fit, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r[2] == "block"), default=None)
    return (best[0] + best[1], best[2]) if best else (None, "allow")


URLS = [
    None, "", "no scheme", "http://", "HTTP://Example.ORG/en/1?x#y", "https://a.b.example.org/es/", "https://example.org", "https://example.org?x=/es/", "x://notexample.org/es/",
    "ftp://h.com/de/x://y", "http://h.com/fr", "http://h.com/fr/", "http://org/", "http://ÄB.com/de/", "http://u@h.com:80/de/", "http://h.com#/de/", "http://com/de/a/b/c",
]


@pytest.mark.parametrize("rules", [URL_RULES, [("a.com", "/b", "allow"), ("a.com", "/b/c", "block"), ("com", "/", "block"), ("a.com", "", "allow"), ("b.a.com", "/b/", "block")]])
def test_rules(spark, rules, monkeypatch):
    more = ["http://a.com/b", "http://b.a.com/b/cd", "http://x.b.a.com/b/", "http://a.com", "http://z.com/q", "http://a.com/bb/c"]
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(URLS + more)] + [(0, None, None)], "page_id long, url string, host string")

    def answers():
        return sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in urls.judged(pages, rules).collect())

    want = []
    for page, url, _ in [tuple(r) for r in pages.collect()]:
        host, path = urls.host_and_path(url)
        rule, verdict = brute_rule(host, path, rules)
        want.append((page, host, path, rule or "", verdict))
    assert answers() == sorted(want)
    monkeypatch.setattr(urls, "LARGEST_TRIE", 0)
    assert answers() == sorted(want)


def test_url_parts():
    assert urls.host_and_path("HTTP://Www.Example.ORG/en/1?x#y") == ("www.example.org", "/en/1")
    assert urls.host_and_path("a://b?c/d") == ("b", "") and urls.host_and_path("abc") == ("", "")


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header class="top">Site</header><nav><ul><li><a href=/a>A</a></ul></nav>
<aside>Side</aside><div class='cookie-notice'>We use <b>cookies</b></div><article><h1>Head &amp; line</h1><p>First<br>para  with <b>bo</b>ld.<p class="ad">Buy!</p>
<div class="share">Share</div><ul><li>One</li><li>Two</li></ul><form><input name=q>Go</form></article><section id="comments"><article>A reader's view</article></section>
<script>var t="</p>";</script><footer>&copy; x</footer></body></html>"""


def page_table(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string, start int")


def test_article(spark):
    got = html.main_texts(page_table(spark, [(1, "http://h/1", PAGE, "clash", 0), (2, None, None, None, None), (3, "http://h/3", "", None, None), (4, "http://h/4", "plain &lt;words&gt;", None, None), (5, "http://h/5", "<p>unclosed <b>tag", None, None), (None, "u", PAGE, None, None)])).collect()
    found = {r.page_id: (r.text, r.n_chars) for r in got}
    assert found[1][0] == "Head & line First para with bold. One Two" and found[None] == found[1]
    assert found[2] == ("", 0) and found[3] == ("", 0)
    assert found[4] == ("plain <words>", 13) and found[5] == ("unclosed tag", 12)


def test_host_repeats_without_article(spark):
    chrome = "<div>Welcome to the very best site of all sites</div>{}<div>All of this is ours and ours alone forever</div>"
    rows = [(k, f"http://host.example/{k}", chrome.format(f"<p>Story number {k} tells of thing {k * 7} and ends there</p><p>Short {k}</p>"), None, None) for k in range(40)]
    rows += [(100, "http://other.example/", chrome.format("<p>Alone</p>"), None, None)]
    got = {r.page_id: r.text for r in html.main_texts(page_table(spark, rows)).collect()}
    for k in range(40):
        assert got[k] == f"Story number {k} tells of thing {k * 7} and ends there Short {k}"
    assert got[100].startswith("Welcome")


def test_copied_page_keeps_its_text(spark):
    body = "<div>The same words on two pages of one single host</div>"
    got = html.main_texts(page_table(spark, [(1, "http://h/1", body, None, None), (2, "http://h/2", body, None, None)])).collect()
    assert {r.text for r in got} == {"The same words on two pages of one single host"}


@pytest.mark.parametrize("copies", [2, 3, 12])
def test_near_copies_keep_their_text(spark, copies):
    body = "<div>The council met on a cold evening to speak of the bridge that nobody had crossed for years</div>"
    rows = [(k, f"http://h/{k}", f"<p>Headline number {k}</p>{body}", None, None) for k in range(copies)]
    rows += [(None, "http://h/n", f"<p>Null {k}</p><p>One of the {k} pages that have no name at all</p>", None, None) for k in range(3)]
    got = {r.text for r in html.main_texts(page_table(spark, rows)).where("page_id is not null").collect()}
    assert got == {f"Headline number {k} The council met on a cold evening to speak of the bridge that nobody had crossed for years" for k in range(copies)}


def test_copies_on_part_of_a_host_keep_every_block(spark):
    body = "<p>The council met on a cold evening to speak of it</p><p>Nobody had crossed the old bridge for more than ten long years</p>"
    rows = [(k, f"http://h/{k}", f"<p>Page {k}</p>" + (body if k < 4 else f"<p>Other page {k} with words {k + 1} of its own {k + 2}</p>"), None, None) for k in range(12)]
    got = {r.page_id: r.text for r in html.main_texts(page_table(spark, rows)).collect()}
    assert all("cold evening" in got[k] and "old bridge" in got[k] for k in range(4))


def test_articles_are_judged_by_their_own_words(spark):
    ask = "<p>Please support our work by telling all your friends about this site</p>"
    story = "Story {0} tells at length of thing {1} and of thing {2} and of all that came after {3}"
    rows = [(k, f"http://h/{k}", f"<article><p>{story.format(k, 3 * k, 5 * k, 7 * k)}</p>{ask}</article>", None, None) for k in range(9)]
    rows += [(50, "http://i/", f"<div><p>{story.format(1, 2, 3, 4)}</p></div><article><h2>Read this next</h2></article>", None, None)]
    got = {r.page_id: r.text for r in html.main_texts(page_table(spark, rows)).collect()}
    assert all(got[k] == story.format(k, 3 * k, 5 * k, 7 * k) for k in range(9))
    assert got[50].startswith(story.format(1, 2, 3, 4))


@pytest.mark.parametrize(
    "page",
    [
        "<div class='layout has-sidebar'><div><p>{}</p></div></div>",
        "<main class='with-sidebar'><p>{}</p></main>",
        "<article class='post no-comments'><p>{}</p></article>",
        "<article class='sidebar'><p>{}</p></article>",
        "<div class='share-price legal-news'><p id='notice-of-meeting'>{}</p></div>",
        "<div aria-label='How to fill in a search form'><p>{}</p></div>",
        "<nav>Home</nav><div class='sidebar'><p>{}</p></div>",
        "<div class='comment-list'><article>Nice</article></div><div class='sidebar-inner'><main>{}</main></div>",
    ],
)
def test_names_do_not_close_the_content(page):
    assert html.page_text(page.format("The body of the page")) == "The body of the page"


def test_names_close_furniture():
    names = ("sidebar", "left-sidebar", "sidebar-1", "comments-area", "siteFooter", "cookie-notice", "ad ad-300x250", "share-buttons")
    page = "".join(f"<div class='{name}'><p>Furniture of the page</p></div>" for name in names)
    assert html.page_text(page + "<p>Body</p>") == "Body" and html.page_text("<nav>Home</nav><footer>End</footer>") == ""


BODY = " ".join(f"Word{k} of the body," for k in range(15))  # 60 words, expected texts below are written by hand


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<form id='aspnetForm'><input type=hidden name=v><nav>Home</nav><article><p>{}</p></article></form>", "{}"),
        ("<form><div class='content'><p>{}</p></div><fieldset><label>Name <input></label><button>Send</button></fieldset></form>", "{}"),
        ("<form id='form1'><div><input name=q><button>Go</button></div><div><p>{}</p></div></form>", "{}"),
        ("<article><p>{}</p><form><p>Leave a reply, your address stays with us</p><input><textarea></textarea></form></article>", "{}"),
        ("<p>{}</p><form><p>{}</p></form>", "{}"),
        ("<form><p>Name and password</p><input><input></form>", ""),
        ("<div class='overflow-hidden'><p>{}</p></div>", "{}"),
        ("<article><div class='overflow-hidden'><p>{}</p></div><p>Tail</p></article>", "{} Tail"),
        ("<div data-x='hidden'><p title='the hidden truth'>{}</p></div>", "{}"),
        ("<div hidden><p>Secret</p></div><div HIDDEN=hidden>Secret</div><p aria-hidden='true'>Secret</p><div style='color:red; display : none'>Secret</div><p>{}</p>", "{}"),
        ("<div hidden=false aria-hidden=false><p>{}</p></div>", "{}"),
        ("<article><h1>Head</h1><fieldset><p>{}</p></fieldset></article>", "Head {}"),
        ("<article><p>{}</p><section id='cookies'><p>Bake them for ten minutes.</p></section></article>", "{} Bake them for ten minutes."),
        ("<article><p>{}</p><section class='cookies'><p>We use cookies.</p></section></article>", "{}"),
        ("<article><h1>Head</h1><div class='legal'><div><p>{}</p></div><nav>Next</nav></div></article>", "Head {}"),
        ("<article><h1>Head</h1><div class='product-form'><p>{}</p></div></article>", "Head {}"),
        ("<article><p>Head</p><section id='comments'><p>{}</p></section></article>", "Head"),
        ("<article><p>{}</p><div class='promo'><p>Buy one, get one.</p></div></article>", "{}"),
        ("<body><nav><ul><li>Home<li>News</ul><article><p>{}</p></article></body>", "{}"),
        ("<body><nav><ul><li>Home</ul><article><p>Teaser</p></article></nav><article><p>{}</p></article></body>", "{}"),
        ("<aside>Note<main><p>{}</p></main>", "{}"),
    ],
)
def test_hand_written_texts(page, want):
    assert html.page_text(page.replace("{}", BODY)) == want.replace("{}", BODY)


def test_empty_tables(spark):
    empty = page_table(spark, [])
    assert html.main_texts(empty).count() == 0 and urls.judged(empty, URL_RULES).count() == 0


@pytest.mark.parametrize("unnamed", ["", "<p>Read this fine magazine every morning with your coffee and tell a friend.</p>"])
def test_repeats_equal_brute_force(spark, unnamed):
    """The table as it is (its furniture is all named), and with a line of furniture that only its repetition tells."""
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").withColumn("html", F.regexp_replace("html", "</(article|main)>", f"{unnamed}</$1>"))
    rows = table.select("page_id", "url", "html").collect()
    once = {(r.page_id, r.url, r.html) for r in rows}
    on, of = {}, {}
    words = {p: [w for zone, text, _ in html.blocks(p[2] or "") if zone in html.JUDGED for w in text.split()] for p in once}
    for p, own in words.items():
        host = host_and_path(p[1])[0]
        if len(own) >= 6:
            of[host] = of.get(host, 0) + 1
        for window in {tuple(own[k : k + 6]) for k in range(len(own) - 5)}:
            on[host, window] = on.get((host, window), 0) + 1
    want, plain = {}, {}
    for p, own in words.items():
        host = host_and_path(p[1])[0]
        counts = [on[host, tuple(own[k : k + 6])] for k in range(len(own) - 5)]
        ranges = [{"start": k, "count": 1} for k, n in enumerate(counts) if n >= 3 and 2 * n > of[host]]
        want[p], plain[p] = html.page_text(p[2], ranges), html.page_text(p[2])
    got = html.main_texts(table).collect()
    assert len(got) == len(rows)
    texts: dict = {}
    for (page_id, url, _), text in want.items():
        texts.setdefault((page_id, url), set()).add(text)
    assert [(r.page_id, r.text) for r in got if r.text not in texts[r.page_id, r.url]] == []
    assert bool(unnamed) == (sum(want[p] != plain[p] for p in once) > len(once) // 4)


def test_tokens_do_not_depend_on_their_place():
    words = ["a", "ÄÖ", "x" * (html.CHUNK_BYTES + 5), "日本"] + [f"w{k % 1000}" for k in range(100_000)] + ["a", "ÄÖ"]
    got = html._text_tokens(" ".join(words))
    assert len(got) == len(words) and len(html._text_tokens("")) == 0
    assert len(set(got.tolist())) == len(set(words)) == len(set(zip(words, got.tolist())))
    assert [html._text_tokens(w)[0] for w in words[:4]] == got[:4].tolist()


def test_furniture_beside_other_words_on_each_page(spark):
    """Every page's run at the edge of the furniture is different; a rare host, a long page and repeated rows beside it."""
    line = "<p>Posted by the editors of this fine paper on a day in May</p>"
    story = "Story {0} tells of thing {1} and {2} and then of {3} at length"
    rows = [(k, f"http://hot/{k}", f"{line}<p>{story.format(k, 3 * k, 5 * k, 7 * k)}</p>", None, None) for k in range(300)]
    long = " ".join(f"word{k}" for k in range(200_000))
    rows += [(900, "http://hot/long", f"{line}<p>{long}</p>", None, None)] * 3 + [(901, "http://cold/", line, None, None)]
    got = [(r.page_id, r.text) for r in html.main_texts(page_table(spark, rows)).collect()]
    assert sorted(got) == sorted([(k, story.format(k, 3 * k, 5 * k, 7 * k)) for k in range(300)] + [(900, long)] * 3 + [(901, line[3:-4])])


def test_pages_query(spark, small):
    got = QUERIES["op10_html_extraction"](spark, small).collect()
    assert len(got) == spark.read.parquet(f"{small}/pages.parquet").count() and all(r.n_chars == len(r.text) > 0 for r in got)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    answer = con.execute(ORACLES[name])
    columns = [d[0] for d in answer.description]
    assert sorted(map(repr, answer.fetchall())) == sorted(repr(tuple(r[c] for c in columns)) for r in QUERIES[name](spark, folder).collect())
