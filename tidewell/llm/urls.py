"""Allow and block lists for URLs: a trie over reversed host labels and path segments.

A rule is a host and a path. It fits its host and every subdomain when the
URL's path starts with the rule's path; of several that fit, the one written
with most characters (host and path) wins, and between equally long ones first
the longer host, then block. Only tries of a checked size are broadcast.

host: what follows the first `://` up to `/`, `?`, `#` or the end, A-Z lowered
and nothing else removed (a port or user name stays). path: from there to `?`,
`#` or the end. Both are empty for null or where `://` is missing; such URLs get
no rule and the default verdict.
"""

from __future__ import annotations

import pickle

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest pickled trie that is broadcast; longer lists are matched by a join.
LARGEST_TRIE = 64 << 20

_LOWER = {k: k + 32 for k in range(65, 91)}


class UrlTrie:
    """Nodes are [children by label or segment, rules whose path ends in a segment's prefix]."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        """rules: (host, path, verdict)."""
        self.root: list = [{}, None]
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node[0].setdefault(label, [{}, None])
            if node[1] is None:
                node[1] = [{}, []]
            place = node[1]
            segments = path.split("/")
            for segment in segments[:-1]:
                place = place[0].setdefault(segment, [{}, []])
            rank = (len(host) + len(path), len(host), verdict == "block")
            place[1].append((segments[-1], rank, host + path, verdict))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """The winning rule and its verdict."""
        best, node, segments = None, self.root, path.split("/")
        for label in reversed(host.split(".")):
            node = node[0].get(label)
            if node is None:
                break
            place, depth = node[1], 0
            while place is not None:
                for start, *found in place[1]:
                    if segments[depth].startswith(start) and (best is None or found[0] > best[0]):
                        best = found
                place = place[0].get(segments[depth]) if depth + 1 < len(segments) else None
                depth += 1
        return best and (best[1], best[2])


def host_and_path(url: str | None) -> tuple[str, str]:
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    for mark in "?#":
        rest = rest.partition(mark)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


def judged(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The kept columns with host, path, rule (null where none fits) and verdict."""
    blob = pickle.dumps(UrlTrie(rules))
    if len(blob) > LARGEST_TRIE:
        return _judged_by_join(pages, rules, default, url, keep)
    shared = pages.sparkSession.sparkContext.broadcast(blob)
    base = pages.select(*keep, F.col(url).alias("__url"))

    def run(batches):
        trie = pickle.loads(shared.value)
        for batch in batches:
            parts = [host_and_path(u) for u in batch.column("__url").to_pylist()]
            found = [trie.match(*p) or (None, default) for p in parts]
            columns = [[p[0] for p in parts], [p[1] for p in parts], [f[0] for f in found], [f[1] for f in found]]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(c, pa.string()) for c in columns)], [*keep, "host", "path", "rule", "verdict"])

    kept = base.select(*keep).schema
    return base.mapInArrow(run, kept.add("host", "string").add("path", "string").add("rule", "string").add("verdict", "string"))


def _judged_by_join(pages: DataFrame, rules: list[tuple[str, str, str]], default: str, url: str, keep: tuple[str, ...]) -> DataFrame:
    """The same for lists too large to broadcast: every host suffix meets its rules, each distinct URL once."""
    spark = pages.sparkSession
    listed = spark.createDataFrame([(h.translate(_LOWER), p, v) for h, p, v in rules], "rule_host string, rule_path string, rule_verdict string")
    has = F.coalesce(F.locate("://", F.col(url)) > 0, F.lit(False))
    rest = F.when(has, F.substring_index(F.substring_index(F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)"), "?", 1), "#", 1)).otherwise("")
    base = pages.select(*keep, rest.alias("__rest")).withColumn("__host", F.substring_index("__rest", "/", 1))
    base = base.withColumn("path", F.expr("substring(__rest, length(__host) + 1)"))
    base = base.withColumn("host", F.translate("__host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    suffixes = base.select("host", "path").distinct().withColumn("rule_host", F.explode(F.expr("transform(sequence(1, size(split(host, '[.]'))), k -> array_join(slice(split(host, '[.]'), k, size(split(host, '[.]'))), '.'))")))
    fits = suffixes.join(listed, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    rank = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), (F.col("rule_verdict") == "block").cast("int"))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict"), rank).alias("best"))
    out = base.join(best, ["host", "path"], "left")
    return out.select(*keep, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
