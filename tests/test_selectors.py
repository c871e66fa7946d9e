"""The selector cache as a stream: kept, replaced, failed, replayed and expired."""

import re
import sys
import time

import pytest
from pyspark import cloudpickle

from tidewell.streaming.selectors import STORE, selectors

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers have no folder of tests
PAGES = "sig string, seq long, url string, html string"


def page(name, links):
    return "".join(f"<a class={name}>{k}</a>" for k in range(links))


def count(html, selector, attribute, url):
    return len(re.findall(f"<a class={selector}>", html))


def derive(html):
    names = re.findall(r"<a class=(\w+)>", html)
    if "boom" in names:
        raise RuntimeError("no answer")
    return (max(set(names), key=names.count), "href") if names else None


@pytest.fixture
def store(spark):
    spark.conf.set(*STORE)
    yield spark
    spark.conf.unset(STORE[0])


def ran(spark, folder, name, **options):
    stream = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{folder}/pages")
    out = selectors(stream, count, derive, **options)
    return out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/{name}-state").option("path", f"{folder}/{name}")


def add(spark, folder, rows):
    spark.createDataFrame(rows, PAGES).coalesce(1).write.mode("append").parquet(f"{folder}/pages")
    time.sleep(0.05)


def told(spark, folder, name):
    return sorted((r.sig, r.seq, r.action, r.selector, r.links) for r in spark.read.schema("sig string, seq long, action string, selector string, links int").parquet(f"{folder}/{name}").collect())


def test_selectors_heal(store, tmp_path):
    spark, folder = store, str(tmp_path)
    add(spark, folder, [("a", 2, "u", page("old", 4)), ("a", 1, "u", page("old", 3)), ("b", 1, "u", page("x", 2)), ("c", 1, "u", page("boom", 5))])
    add(spark, folder, [("a", 3, "u", page("new", 5)), ("a", 4, "u", page("new", 6)), ("b", 2, "u", page("x", 9)), ("c", 2, "u", "")])
    add(spark, folder, [("a", 5, "u", page("z", 1)), ("a", 6, "u", page("new", 3)), ("c", 3, "u", page("y", 3))])
    want = [
        ("a", 1, "derived", "old", 3), ("a", 2, "kept", "old", 4), ("a", 3, "replaced", "new", 5), ("a", 4, "kept", "new", 6), ("a", 5, "failed", None, 0), ("a", 6, "kept", "new", 3),
        ("b", 1, "failed", None, 0), ("b", 2, "derived", "x", 9), ("c", 1, "failed", None, 0), ("c", 2, "failed", None, 0), ("c", 3, "derived", "y", 3),
    ]
    ran(spark, folder, "whole").trigger(availableNow=True).start().awaitTermination(120)
    assert told(spark, folder, "whole") == want
    # the same micro-batches again, and a stop between them, end in the same rows
    for _ in range(2):
        ran(spark, folder, "again").trigger(availableNow=True).start().awaitTermination(120)
    add(spark, folder, [("a", 7, "u", page("new", 3)), ("b", 3, "u", page("x", 3))])
    ran(spark, folder, "again").trigger(availableNow=True).start().awaitTermination(120)
    assert told(spark, folder, "again") == sorted([*want, ("a", 7, "kept", "new", 3), ("b", 3, "kept", "x", 3)])


def test_idle_templates_are_forgotten(store, tmp_path):
    spark, folder = store, str(tmp_path)
    add(spark, folder, [("a", 1, "u", page("old", 4))])
    stream = ran(spark, folder, "out", idle_ms=1500).trigger(processingTime="500 milliseconds").start()

    def waited(want):
        until = time.time() + 40
        while time.time() < until:
            time.sleep(1)
            found = told(spark, folder, "out") if (tmp_path / "out" / "_spark_metadata").exists() else []
            if want in found:
                return found
        return found

    try:
        assert waited(("a", 1, "expired", "old", 0)) == [("a", 1, "derived", "old", 4), ("a", 1, "expired", "old", 0)]
        add(spark, folder, [("a", 2, "u", page("old", 4))])
        assert ("a", 2, "derived", "old", 4) in waited(("a", 2, "derived", "old", 4))
    finally:
        stream.stop()
