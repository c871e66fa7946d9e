"""Row functions that a model would answer, with deterministic rules in its place.

Each takes a plain function (the boundary) and runs it over Arrow batches; the
default rules are column expressions, so offline plans stay in the JVM. Cheap
predicates are applied before a function is called, as the optimizer does not
know its cost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tags import clamp_kind, clamp_relation, relation_rank
from .ordering import in_batches


def answered(rows: DataFrame, answer: Callable[[dict], dict], schema: str, key: str = "id") -> DataFrame:
    """L0: answer(row) for each row, merged over defaults of null; errors give a row with `error`."""
    names = [f.split()[0] for f in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                try:
                    said = {n: answer(row).get(n) for n in names} | {"error": None}
                except Exception as error:  # a failed call is a result: the row stays unanswered
                    said = dict.fromkeys(names) | {"error": str(error)[:200]}
                out.append({key: row[key]} | said)
            yield pd.DataFrame(out, columns=[key, *names, "error"])

    kind = dict(rows.dtypes)[key]
    return rows.mapInPandas(run, f"{key} {kind}, {schema}, error string")


def overlap(words: list[str], hay: Column) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, words)).cast("array<string>"), lambda w: F.contains(hay, w)))


def relevance(words: list[str], title: Column, body: Column) -> Column:
    """Direct from half of the words on, similar from one, else none; an empty row is none."""
    n = overlap(words, F.lower(F.concat_ws(" ", title, body)))
    return F.when(n * 2 >= max(1, len(words)), "direct").when(n > 0, "similar").otherwise("none") if words else F.lit("none")


def judged(rows: DataFrame, words: list[str], title: str = "title", body: str = "content", chars: int = 8000) -> DataFrame:
    """Relation, kind and rank of each row."""
    relation = clamp_relation(relevance(words, F.col(title), F.substring(F.col(body), 1, chars)))
    return rows.withColumn("relation", relation).withColumn("judged_kind", clamp_kind(F.col("kind"))).withColumn("rank", relation_rank(F.col("relation")))


def judged_in_batches(rows: DataFrame, judge: Callable[[list[dict]], list[dict]], size: int = 40, spread: int = 64) -> DataFrame:
    """judge(list of rows) by batches of `size`; a failed batch is none for its rows and counts as failed.

    Rows are dealt to `spread` groups by id, so batches form without one global order.
    """
    grouped = in_batches(rows.withColumn("spread", F.pmod(F.xxhash64("id"), F.lit(spread))), size, "spread", "id")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        try:
            said, failed = {r["id"]: r for r in reversed(judge(frame.to_dict("records")))}, False
        except Exception:
            said, failed = {}, True
        none = {"relation": "none", "kind": "news"}
        return pd.DataFrame([{"id": i, "relation": said.get(i, none)["relation"], "kind": said.get(i, none)["kind"], "failed": failed} for i in frame["id"]])

    return grouped.groupBy("spread", "batch").applyInPandas(run, "id long, relation string, kind string, failed boolean")


def buckets(hits: DataFrame) -> DataFrame:
    """Scanned, relevant, failed and skipped rows; a null relation was skipped, which is not none."""
    return hits.agg(
        F.count("*").alias("scanned"),
        F.count_if(F.col("relation").isin("direct", "similar")).alias("relevant"),
        F.count_if(F.coalesce("failed", F.lit(False))).alias("failed"),
        F.count_if(F.col("relation").isNull()).alias("skipped"),
        F.count_if((F.col("relation") == "similar")).alias("hidden_similar"),
    )


def shown(hits: DataFrame, strict: bool = False, kind: str | None = None) -> DataFrame:
    """Direct ones alone when strict, and one kind: the judged, else the stored."""
    out = hits.where(F.col("relation") == "direct") if strict else hits.where(F.col("relation").isin("direct", "similar"))
    return out if kind is None else out.where(F.coalesce("judged_kind", "kind") == kind)


def verify(rows: DataFrame) -> DataFrame:
    """Junk for a challenge page, suspect for a menu or thin text, else ok."""
    content = F.col("content")
    status = F.when(T.is_blocked_page(F.col("title"), content), "junk").when(T.starts_with_menu(content) | T.is_thin(content) | T.is_json_page(content), "suspect").otherwise("ok")
    return rows.withColumn("verdict", status)


def classify(articles: DataFrame, vocabulary: DataFrame, limits: dict[str, int], text: str = "content") -> DataFrame:
    """Tags whose words occur in the text, by position in the vocabulary, up to each facet's limit.

    Words of the text meet the vocabulary in a join, so no article is paired with every tag.
    """
    words = articles.select("id", F.explode(F.array_distinct(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"))).alias("tag"))
    hit = words.join(vocabulary.select("facet", "tag", "position"), "tag")
    most = F.element_at(F.create_map(*(x for f, n in limits.items() for x in (F.lit(f), F.lit(n)))), F.col("facet"))
    listed = hit.groupBy("id", "facet").agg(F.array_sort(F.collect_list(F.struct("position", "tag"))).alias("l"))
    return listed.select(F.col("id").alias("article_id"), "facet", F.posexplode(F.slice("l", F.lit(1), most)).alias("rank", "x")).select("article_id", "facet", F.col("x.tag").alias("tag"), "rank")


def summarize(rows: DataFrame, sentences: int = 2) -> DataFrame:
    """The first sentences; null where the language guard refuses them."""
    from ..functions.tags import wrong_language

    first = F.array_join(F.slice(F.split(T.squeezed(F.col("content")), r"(?<=[.!?])\s+"), 1, sentences), " ")
    summary = F.substring(first, 1, 400)
    return rows.withColumn("summary", F.when(~wrong_language(F.col("title"), summary), summary))


def query_spec(query: Column) -> Column:
    """The compiled query."""
    terms = T.spec_words(query)
    return F.struct(F.slice(terms, 1, 3).alias("must_have"), F.slice(terms, 4, 20).alias("nice_to_have"), F.lower(query).alias("query_en"), terms.alias("terms"))


def query_tags(query: str, vocabulary: DataFrame) -> DataFrame:
    """Vocabulary tags that the query names."""
    words = [w for w in query.lower().split() if w]
    return vocabulary.where(F.col("tag").isin(*words) if words else F.lit(False)).select("facet", "tag")


def by_query_tags(query: str, vocabulary: DataFrame, tags: DataFrame) -> DataFrame:
    """Articles with the number of different tags of theirs that the query names."""
    wanted = query_tags(query, vocabulary).distinct()
    return tags.join(wanted, ["facet", "tag"]).groupBy("article_id").agg(F.countDistinct("facet", "tag").alias("matches"))


def junk_spans(text: Column) -> Column:
    """Lines of the text that come more than once."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), F.trim), lambda s: F.length(s) >= 4)
    counts = F.aggregate(lines, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>")), lambda acc, s: F.map_concat(F.map_filter(acc, lambda k, v: k != s), F.create_map(s, F.coalesce(F.try_element_at(acc, s), F.lit(0)) + 1)))
    return F.map_keys(F.map_filter(counts, lambda k, v: v > 1))


def search(rows: DataFrame, words: list[str], most: int = 500) -> DataFrame:
    """OR6: judged hits, direct before similar, then candidate position."""
    return judged(rows, words).where("relation <> 'none'").orderBy("rank", "pos").limit(most)
