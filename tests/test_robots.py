"""Robots rules: agents, wildcards, ties, delays and awkward files."""

import pytest

from tidewell.operators import robots

FILE = """# for all
Disallow: /before-any-agent
User-agent: *
Disallow: /private/   # not for robots
Allow: /private/open
Crawl-delay: 2
Sitemap: https://a.com/map.xml

USER-AGENT: Tide/2.1
User-agent: other
disallow: /*.pdf$
Disallow: /tie
Allow: /tie
Disallow: /q?x=
Disallow:
Crawl-delay: soon
Crawl-delay: 0.5
User-agent: wall
Disallow: /
User-agent: tide
Disallow: /*/deep/*end
Disallow: /a.b(c)
"""


@pytest.mark.parametrize(
    ("agent", "path", "allowed"),
    [
        ("nobody", "/private/x", False),
        ("nobody", "/private/open/x", True),
        ("nobody", "/before-any-agent", True),
        ("nobody", "", True),
        ("tide", "/private/x", True),
        ("TIDE", "/x/y.pdf", False),
        ("tide", "/x/y.pdf?z", True),
        ("tide", "/tie/x", True),
        ("tide", "/q?x=1", False),
        ("tide", "/q?y=1", True),
        ("tide", "/p/deep/q/end/more", False),
        ("tide", "/deep/end", True),
        ("tide", "/a.b(c)d", False),
        ("tide", "/aXb(c)d", True),
        ("wall", "", False),
        ("other", "/p/deep/q/end", True),
    ],
)
def test_rules_of_agents(spark, agent, path, allowed):
    rules = robots.rules_for(spark.createDataFrame([("https://A.com", FILE)], "origin string, text string"), agent)
    row = robots.judged(spark.createDataFrame([(f"https://a.com{path}", 1)], "url string, allowed int").drop("allowed"), rules).first()
    assert row.allowed is allowed
    assert row.delay_ms == {"tide": 500, "other": 500, "wall": 0}.get(agent.lower(), 2000)


def test_awkward_files_and_urls(spark):
    files = spark.createDataFrame([("https://a.com", "User-agent:*\r\nDisallow:/x\rDisallow: /y"), ("https://b.com", None), ("https://c.com", ""), (None, FILE), ("https://d.com:8080", "User-agent: *\nDisallow: /")], "origin string, text string")
    rules = robots.rules_for(files, "tide")
    urls = [None, "", "no url", "https://a.com/x", "https://a.com/y", "https://b.com/x", "https://c.com/x", "https://d.com/x", "https://D.com:8080/x", "http://a.com/x"]
    got = robots.judged(spark.createDataFrame([(u, "x" * 3) for u in urls], "url string, rules string"), rules)
    assert got.columns == ["url", "rules", "allowed", "delay_ms"]
    assert {r.url for r in got.collect() if not r.allowed} == {"https://a.com/x", "https://a.com/y", "https://D.com:8080/x"} and got.count() == len(urls)
    assert robots.judged(got.select("url").limit(0), rules).count() == 0 and robots.judged(got.select("url"), rules.limit(0)).where("NOT allowed").count() == 0
