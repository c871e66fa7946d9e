"""Lexical, dense and hybrid retrieval.

Postings are a table (id, field, term, tf); scores are joins and sums over the
query's few terms, which are pushed to the postings as a filter.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .ordering import reciprocal_ranks

#: Field weights and the engine constants of the ranking function (fixed values).
WEIGHTS = {"title": 10.0, "title_pt": 8.0, "content": 1.0, "summary_pt": 3.0}
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
POOL, RERANKED = 200, 128


def tokens(text: Column) -> Column:
    """Lower-cased letter or digit runs."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


@F.pandas_udf(ArrayType(StringType()))
def stemmed(terms: pd.Series) -> pd.Series:
    """R2: Porter stems of terms without diacritics."""
    from ..functions.stem import stem

    return terms.map(lambda ts: None if ts is None else [stem(t) for t in ts])


def postings(articles: DataFrame, fields: dict[str, float] = WEIGHTS, porter: bool = False, terms: list[str] | None = None) -> DataFrame:
    """(id, term, wtf, len): field-weighted term frequency, and the length over all fields; with `terms` theirs alone, picked before the shuffle."""
    have = [f for f in fields if f in articles.columns]
    cut = articles.select("id", *((stemmed(tokens(F.col(f))) if porter else tokens(F.col(f))).alias(f) for f in have))

    def weighed(field: str) -> Column:
        wanted = F.col(field) if terms is None else F.filter(field, lambda t: t.isin(*terms))
        return F.transform(wanted, lambda t: F.struct(t.alias("term"), F.lit(fields[field]).alias("w")))

    length = sum((F.size(f) for f in have), F.lit(0))
    rows = cut.select("id", length.alias("len"), F.inline(F.flatten(F.array(*map(weighed, have)))))
    return rows.groupBy("id", "len", "term").agg(F.sum("w").alias("wtf"))


def lengths(articles: DataFrame, fields: dict[str, float] = WEIGHTS) -> Column:
    """A document's tokens over all fields."""
    return sum((F.size(tokens(F.col(f))) for f in fields if f in articles.columns), F.lit(0))


def corpus_stats(articles: DataFrame, fields: dict[str, float] = WEIGHTS) -> DataFrame:
    """One row: the number of documents and their mean length."""
    return articles.agg(F.count("*").alias("docs"), F.avg(lengths(articles, fields)).alias("avg_len"))


def bm25(posted: DataFrame, stats: DataFrame, terms: list[str], most: int | None = None) -> DataFrame:
    """R1, OR4: (id, score), lower is better. A term that the query repeats counts as often; statistics are of the whole corpus."""
    spark = posted.sparkSession
    query = spark.createDataFrame([(t,) for t in terms], "term string").groupBy("term").agg(F.count("*").alias("times"))
    hit = posted.where(F.col("term").isin(*terms)) if terms else posted.limit(0)
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.ln((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR))
    weighed = query.join(df, "term").join(stats, F.lit(True)).select("term", "times", idf.alias("idf"), "avg_len")
    scored = hit.join(F.broadcast(weighed), "term")  # one row for each query term
    part = F.col("times") * F.col("idf") * F.col("wtf") * (K1 + 1) / (F.col("wtf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    out = scored.groupBy("id").agg((-F.sum(part)).alias("score"))
    return out if most is None else out.orderBy("score", "id").limit(most)


def knn(vectors: DataFrame, query: list[float], most: int, id: str = "id", embedding: str = "embedding", where: DataFrame | None = None) -> DataFrame:
    """R4, OR5: (id, distance) by cosine, built-in functions alone. `where` limits the ids before the top rows are taken."""
    if where is not None:
        vectors = vectors.join(where.select(F.col("id").alias(id)), id, "left_semi")
    norm = math.sqrt(sum(x * x for x in query))
    q = F.array(*(F.lit(float(x)) for x in query))
    dot = F.aggregate(F.zip_with(F.col(embedding), q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda acc, x: acc + x)
    own = F.sqrt(F.aggregate(F.col(embedding), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    distance = 1 - dot / (own * norm)
    return vectors.select(F.col(id).alias("id"), distance.alias("distance")).orderBy("distance", "id").limit(most)


def ranked(scored: DataFrame, number: int, by: str) -> DataFrame:
    """(list, id, rank from 0) of a scored top list; the list is bounded by its limit."""
    listed = scored.agg(F.array_sort(F.collect_list(F.struct(F.col(by).alias("s"), "id"))).alias("l"))
    return listed.select(F.lit(number).alias("list"), F.posexplode("l").alias("rank", "x")).select("list", F.col("x.id").alias("id"), "rank")


def hybrid(articles: DataFrame, lexical: DataFrame, dense: DataFrame, most: int = POOL) -> DataFrame:
    """Fuse both top lists, keep rows of the scope, cut."""
    fused = reciprocal_ranks(ranked(lexical, 0, "score").union(ranked(dense, 1, "distance")), keep=articles)
    return fused.limit(most)


def hybrid_mode(query: str, n_scope: int, lexical: int, dense: int, pool: int = POOL) -> str:
    """The label; none where nothing is asked, the scope is small, or both lists are empty."""
    if not (query or "").strip() or n_scope <= pool or not (lexical or dense):
        return "none"
    return "hybrid" if lexical and dense else "lexical" if lexical else "dense"


def prefiltered(scope: DataFrame, query: str, found: DataFrame, pool: int = POOL) -> DataFrame:
    """The rows of scope that found(id) has; all of them where nothing is asked, the scope is within the pool, or none is found."""
    if not (query or "").strip():
        return scope
    hit = scope.join(found.select("id").distinct(), "id", "left_semi")
    return scope if len(scope.select("id").take(pool + 1)) <= pool or hit.isEmpty() else hit


def reordered(rows: DataFrame, scores: DataFrame, keep: int = RERANKED) -> DataFrame:
    """By aligned scores, missing ones last, ties as they were (pos)."""
    return rows.join(scores.select("id", "rerank"), "id", "left").orderBy(F.coalesce("rerank", F.lit(float("-inf"))).desc(), "pos").limit(keep)


def hash_embedding(text: str, size: int = 384) -> list[float]:
    """A deterministic unit vector of hashed words; the offline stand-in for a model."""
    import xxhash

    out = np.zeros(size)
    for word in (text or "").lower().split():
        h = xxhash.xxh64_intdigest(word)
        out[h % size] += 1.0 if h >> 63 else -1.0
    norm = float(np.linalg.norm(out))
    return (out / norm if norm else out).tolist()


def embedded(articles: DataFrame, known: DataFrame | None = None, model: Callable[[str], list[float]] = hash_embedding, text: str = "content") -> DataFrame:
    """R5, SK24: vectors of the rows that have none yet, in Arrow batches."""
    from .joins import missing_from

    todo = missing_from(articles, known, "id") if known is not None else articles

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "embedding": [model(t) for t in frame["t"]]})

    return todo.select("id", F.col(text).alias("t")).mapInPandas(run, "id long, embedding array<float>")
