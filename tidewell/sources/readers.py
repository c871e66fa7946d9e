"""Readers of files and of paged archives."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_SOURCES = "sources array<struct<name:string,base_url:string,type:string,max_index_pages:int>>"


def configured_sources(spark: SparkSession, path: str) -> DataFrame:
    """SC10: the sources of a JSON file; none where it is absent or broken."""
    empty = spark.createDataFrame([], "name string, base_url string, type string, max_index_pages int")
    try:
        read = spark.read.schema(_SOURCES).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
        return read.select(F.inline(F.coalesce("sources", F.array().cast(read.schema["sources"].dataType))))
    except Exception as error:  # a missing path is no source; other faults are raised
        if "PATH_NOT_FOUND" in str(error):
            return empty
        raise


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """SC11: (facet, tag, position) of a vocabulary file; a missing file is an error."""
    read = spark.read.schema("facets map<string,array<string>>").option("multiLine", True).json(path)
    return read.select(F.explode("facets").alias("facet", "tags")).select("facet", F.posexplode("tags").alias("position", "tag"))


def snapshot(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """SC12: the parts of an exported snapshot; contents are read only where joined."""
    return {part: spark.read.json(f"{folder}/{part}") for part in ("meta", "articles", "contents")}


class ArchivePages(DataSource):
    """SC13: a paged archive, one task for each page.

    Options: `pages`, a JSON array of arrays of {url, title, post_date, type}
    that stands for the remote pages; `since`, the floor; `page_size`.
    Pages after the first short one, or after one whose newest item is below
    the floor, are not read. Items of other types, and repeats, are dropped.
    """

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return "url string, title string, post_date string, page int"

    def reader(self, schema) -> DataSourceReader:
        return _ArchiveReader(self.options)


class _ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.pages = json.loads(options.get("pages", "[]"))
        self.since, self.size = options.get("since", ""), int(options.get("page_size", "12"))

    def partitions(self):
        wanted = []
        for k, page in enumerate(self.pages):
            wanted.append(InputPartition(k))
            if len(page) < self.size or max((p.get("post_date") or "" for p in page), default="") < self.since:
                break
        return wanted or [InputPartition(-1)]

    def read(self, partition):
        if partition.value < 0:
            return
        earlier = {p["url"] for page in self.pages[: partition.value] for p in page}
        for item in self.pages[partition.value]:
            if item.get("type", "newsletter") == "newsletter" and item["url"] not in earlier and (item.get("post_date") or "9") >= self.since:
                earlier.add(item["url"])
                yield (item["url"], item.get("title"), item.get("post_date"), partition.value)
