"""Shapes of JSON answers against the same rules in plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidewell.functions.shapes import Flag, Items, Key, Number, Record, Text, validated
from tidewell.plans.catalogue import QUERIES

SHAPE = Record({
    "title": Key(Text()),
    "relation": Key(Text(("direct", "similar", "none")), default="none"),
    "items": Key(Items(Record({"id": Key(Number(whole=True)), "note": Key(Text(), optional=True)})), default=()),
    "tags": Key(Items(Text()), default=("a", "b")),
    "score": Key(Number(), optional=True),
    "more": Key(Record({"deep": Key(Record({"on": Key(Flag())})), "n": Key(Number(), default=1.5)}), optional=True),
})


def fits(shape, value):
    if isinstance(shape, Text):
        return isinstance(value, str) and (not shape.choices or value in shape.choices)
    if isinstance(shape, Number):
        return isinstance(value, (int, float)) and not isinstance(value, bool) and (not shape.whole or value == int(value))
    if isinstance(shape, Flag):
        return isinstance(value, bool)
    if isinstance(shape, Items):
        return isinstance(value, list) and all(fits(shape.of, v) for v in value)
    return isinstance(value, dict) and all(key_fits(key, value, name) for name, key in shape.keys.items())


def key_fits(key, record, name):
    if name not in record:
        return key.optional or key.has_default
    return fits(key.shape, record[name]) or key.optional and record[name] is None


def read(shape, value):
    if isinstance(shape, Items):
        return [read(shape.of, v) for v in value]
    if isinstance(shape, Record):
        return {name: read_key(key, value, name) for name, key in shape.keys.items()}
    return int(value) if isinstance(shape, Number) and shape.whole else float(value) if isinstance(shape, Number) else value


def read_key(key, record, name):
    if name in record and fits(key.shape, record[name]):
        return read(key.shape, record[name])
    return (list(key.default) if isinstance(key.default, tuple) else key.default) if key.has_default else None


def plain(text):
    try:
        value = json.loads(text or "")
    except ValueError:
        value = None
    if not isinstance(value, dict):
        return "broken", None, [], []
    dropped = [k for k, key in SHAPE.keys.items() if not key_fits(key, value, k)]
    if any(not SHAPE.keys[k].optional and not SHAPE.keys[k].has_default for k in dropped):
        return "invalid", None, dropped, []
    defaulted = [k for k, key in SHAPE.keys.items() if key.has_default and not (k in value and fits(key.shape, value[k]))]
    return "tolerant" if dropped or defaulted else "strict", read(SHAPE, value), dropped, defaulted


CASES = [
    None, "", "null", "[]", "{}", "12", '"x"', "{", '{"title": "a"', '{"title": "a"}', '{"title": 1}', '{"title": null}',
    '{"title": "a", "relation": "direct", "items": [], "tags": []}', '{"title": "a", "relation": "other", "items": [], "tags": []}',
    '{"title": "a", "relation": "none", "items": [{"id": 1}, {"id": "2"}], "tags": ["x"]}', '{"title": "a", "relation": "none", "items": [{"id": 1, "note": null, "extra": {}}, {"id": 2, "note": "é\\n"}], "tags": ["x", null]}',
    '{"title": "a", "relation": "none", "items": {"id": 1}, "tags": "x", "score": "1"}', '{"title": "", "relation": null, "items": [{"id": 1.5}], "tags": [], "score": 2, "unknown": [1, {"a": null}]}',
    '{"title": "a", "relation": "none", "items": [null], "tags": [], "more": {"deep": {"on": true}}}', '{"title": "a", "relation": "none", "items": [], "tags": [], "more": {"deep": {"on": 1}, "n": 2}}',
    '{"title": "a", "relation": "none", "items": [], "tags": [], "more": null, "score": null}', '{"title": "a", "relation": "none", "items": [], "tags": [], "more": {"deep": {"on": false}, "n": "x"}}',
    '{"title": "a", "relation": "none", "items": [{"id": 3.0}], "tags": [], "score": 1e3}', ' {"title": "a b", "relation": "similar", "items": [{"id": -7}], "tags": ["", "x"]} ',
]


def drawn(count):
    """Random answers, each key right, wrong, null or absent."""
    draw, values = random.Random(5), [None, True, 3, 2.5, "none", "direct", [], ["x"], [{"id": 1}], [{"id": "1"}], {"deep": {"on": True}}, {"deep": {}}, {}]
    for _ in range(count):
        answer = json.dumps({k: draw.choice(values) for k in [*SHAPE.keys, "other"] if draw.random() < 0.8})
        yield answer[: draw.randrange(len(answer))] if draw.random() < 0.05 else answer


def test_answers_equal_plain_rules(spark):
    texts = [*CASES, *drawn(600)]
    rows = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "id long, text string, status int")
    checked = validated(rows, "text", SHAPE)
    assert checked.columns == [*rows.columns, "checked"]
    seen = set()
    for r in checked.collect():
        status, value, dropped, defaulted = plain(texts[r.id])
        c = r.checked
        assert (c.status, c.value and c.value.asDict(True), c.dropped, c.defaulted) == (status, value, dropped, defaulted), texts[r.id]
        seen.add(status)
    assert seen == {"strict", "tolerant", "invalid", "broken"}


def test_a_key_that_comes_twice_is_broken(spark):
    row = validated(spark.createDataFrame([('{"title": "a", "title": "b"}',)], "text string"), "text", SHAPE).first()
    assert row.checked.status == "broken" and row.checked.value is None


def test_no_python_in_the_plan(spark, small):
    df = QUERIES["validated_answers"](spark, small)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "parseJson" in plan
    assert {r.status for r in df.select("status").distinct().collect()} >= {"strict", "tolerant", "broken"}
    assert validated(df.limit(0).select(F.lit("x").alias("text")), "text", SHAPE).count() == 0


@pytest.mark.parametrize("shape, text, want", [(Record({"n": Key(Number(whole=True))}), '{"n": 9223372036854775807}', 9223372036854775807), (Record({"n": Key(Number(whole=True), default=0)}), '{"n": 99999999999999999999}', 0)])
def test_large_numbers(spark, shape, text, want):
    assert validated(spark.createDataFrame([(text,)], "text string"), "text", shape).first().checked.value.n == want
