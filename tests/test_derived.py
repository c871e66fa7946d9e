"""Derived tables fed by one stream: kills between tables, repeated saves, refusals and sweeps."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidewell.streaming import derived
from tidewell.streaming.derived import Derived, PostSave

SCHEMA = "id long, seq long, text string"


def tables(folder, spark, fail=()):
    def sizes(rows):
        return rows.select("id", F.length("text").alias("size"))

    def heads(rows):
        if fail:
            fail.pop()
            raise RuntimeError("killed between two tables")
        return rows.where("text LIKE 'a%'").select("id", F.substring("text", 1, 2).alias("head"))

    return PostSave(spark, folder, {"sizes": Derived("id long, size int", sizes), "heads": Derived("id long, head string", heads)})


def save(spark, folder, number, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/saved/part={number}")


def follow(post, spark, folder):
    post.follow(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/saved/part=*")).awaitTermination()


def found(post, name):
    return sorted(tuple(r) for r in post.table(name).drop("tx").collect())


def test_killed_between_tables(spark, tmp_path):
    folder = str(tmp_path)
    save(spark, folder, 0, [(1, 1, "ab"), (2, 1, "bcd"), (None, 1, "a")])
    save(spark, folder, 1, [(3, 2, "abcd"), (3, 3, "abcde"), (1, 2, "a longer text")])
    post = tables(f"{folder}/derived", spark, fail := [1])
    with pytest.raises(StreamingQueryException):
        follow(post, spark, folder)
    assert post.table("sizes").count() > 0 and post.table("heads").count() == 0 and not fail
    follow(tables(f"{folder}/derived", spark), spark, folder)
    assert found(post, "sizes") == [(1, 2), (2, 3), (3, 5)] and found(post, "heads") == [(1, "ab"), (3, "ab")]
    follow(post, spark, folder)  # nothing new
    assert found(post, "sizes") == [(1, 2), (2, 3), (3, 5)]


@pytest.mark.parametrize("most", [derived.BROADCAST_BYTES, 0])
def test_replayed_batch_and_sweep(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(derived, "BROADCAST_BYTES", most)
    post = tables(str(tmp_path), spark)
    batch = spark.createDataFrame([(1, 1, "ab"), (2, 1, "ba")], SCHEMA)
    post.land(batch, 0)
    post.land(batch, 0)
    post.land(batch, 1)
    assert found(post, "sizes") == [(1, 2), (2, 2)] and found(post, "heads") == [(1, "ab")]
    saved = batch.union(spark.createDataFrame([(4, 1, "zz"), (None, 1, "a")], SCHEMA))
    seen = []

    def every(rows):
        seen.extend(r.id for r in rows.collect())
        return rows.select("id", F.substring("text", 1, 2).alias("head"))

    for _ in range(2):
        post.sweep(saved, "night", {"heads": every})
    assert found(post, "heads") == [(1, "ab"), (2, "ba"), (4, "zz")] and found(post, "sizes") == [(1, 2), (2, 2), (4, 2)]
    assert sorted(seen) == [2, 2, 4, 4]  # 1 is never derived again
    post.land(batch.limit(0), 2)
    assert found(post, "sizes") == [(1, 2), (2, 2), (4, 2)]
