"""The test tables as the entities: articles, tags, events, a queue, searches.

Each adapter is a projection, so filters and column pruning reach the Parquet
scan. Values that the tables lack are derived from doc_id by fixed rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Entities over one folder of test tables; `live`: as streams of their files."""

    def __init__(self, spark: SparkSession, folder: str, live: bool = False):
        self.spark, self.folder, self.live = spark, folder, live

    def raw(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        # a file source takes one file only by a pattern
        return self.spark.readStream.schema(table.schema).parquet(f"{self.folder}/{name}[.]parquet") if self.live else table

    def articles(self) -> DataFrame:
        """Without verify_status, which needs a join: see verified()."""
        day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 400).cast("int"))
        published = (
            F.when(F.col("doc_id") % 4 == 1, F.date_format(day, "yyyy-MM-dd"))
            .when(F.col("doc_id") % 4 == 2, F.date_format(day, "MMMM d, yyyy"))
            .when(F.col("doc_id") % 4 == 3, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T10:00:00Z")))
        )
        kind = F.when(F.col("doc_id") % 7 == 1, "tool").when(F.col("doc_id") % 7 == 2, "release").when(F.col("doc_id") % 7 > 2, "news")
        return self.raw("documents").select(
            F.col("doc_id").alias("id"),
            F.substring("source", 4, 9).cast("long").alias("source_id"),
            F.concat(F.lit("https://"), "source", F.lit(".example.com/a/"), F.col("doc_id").cast("string")).alias("url"),
            F.substring(F.substring_index("text", "\n", 1), 1, 80).alias("title"),
            F.col("text").alias("content"),
            published.alias("published_at"),
            F.date_add(F.lit("2025-06-01").cast("date"), (F.col("doc_id") % 100).cast("int")).alias("extracted_at"),
            (1 + F.col("doc_id") % 5).alias("run_id"),
            kind.alias("kind"),
            F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("https://issue.example.com/"), F.expr("doc_id div 10").cast("string"))).alias("issue_url"),
            F.when(F.col("doc_id") % 3 > 0, F.substring("text", 1, 60)).alias("blurb"),
            "lang",
            (F.col("doc_id") % 11 == 0).alias("needs_enrich"),
            (F.col("doc_id") % 4).cast("int").alias("enrich_attempts"),
        )

    def sources(self) -> DataFrame:
        return self.raw("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("group_id"))

    def statuses(self) -> DataFrame:
        status = F.when(F.col("quality") == 1, "ok").when(F.col("toxic") == 1, "junk").otherwise("suspect")
        return self.raw("labels").select(F.col("doc_id").alias("id"), status.alias("verify_status"))

    def verified(self) -> DataFrame:
        return self.articles().join(self.statuses(), "id", "left")

    def tags(self) -> DataFrame:
        """(article_id, facet, tag, rank)."""
        docs = self.raw("documents").select("doc_id", "lang", "source")
        kinds = F.when(F.col("doc_id") % 6 == 0, "tool-release").when(F.col("doc_id") % 6 == 1, "release-announcement").otherwise("tutorial")
        entries = F.array(
            F.struct(F.lit("domain").alias("facet"), F.col("lang").alias("tag"), F.lit(0).alias("rank")),
            F.struct(F.lit("topic-technology").alias("facet"), F.col("source").alias("tag"), F.lit(0).alias("rank")),
            F.struct(F.lit("topic-technology").alias("facet"), F.concat(F.lit("t"), (F.col("doc_id") % 13).cast("string")).alias("tag"), F.lit(1).alias("rank")),
            F.struct(F.lit("content-type").alias("facet"), kinds.alias("tag"), F.lit(0).alias("rank")),
            F.struct(F.lit("framework-library-tool").alias("facet"), F.when(F.col("doc_id") % 9 == 0, "spark").alias("tag"), F.lit(0).alias("rank")),
        )
        return docs.select(F.col("doc_id").alias("article_id"), F.inline(entries)).where("tag IS NOT NULL")

    def events(self) -> DataFrame:
        """The event log and usage ledger: run, stage, cost."""
        return self.raw("events").select("event_id", "ts", F.col("user_id").alias("run_id"), F.col("event_type").alias("stage"), F.col("value").alias("cost_usd"), "props")

    def frontier(self) -> DataFrame:
        state = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "pending").otherwise(F.when(F.col("o_orderkey") % 2 == 0, "failed").otherwise("in_progress"))
        kind = F.when(F.col("o_orderkey") % 3 == 0, "article").when(F.col("o_orderkey") % 3 == 1, "roundup").otherwise("listing")
        return self.raw("orders").select(
            F.col("o_orderkey").alias("id"),
            F.concat(F.lit("https://src"), (F.col("o_orderkey") % 20).cast("string"), F.lit(".example.com/a/"), F.col("o_orderkey").cast("string")).alias("url"),
            state.alias("state"),
            kind.alias("kind"),
            (F.col("o_orderkey") % 5).cast("int").alias("retries"),
            (F.col("o_custkey") % 20).alias("source_id"),
            F.to_date("o_orderdate").alias("created"),
        )

    def searches(self) -> DataFrame:
        """(search_id, run_id, query, hits): a conversation is a search, its turns point at articles."""
        hit = F.struct(
            F.col("turn").alias("pos"),
            (F.col("conv_id") * 37 + F.col("turn") * 11).alias("id"),
            F.when(F.col("turn") % 3 == 0, "direct").when(F.col("turn") % 3 == 1, "similar").otherwise("none").alias("relation"),
            F.when(F.col("turn") % 2 == 0, "news").otherwise("tool").alias("kind"),
        )
        turns = self.raw("conversations")
        return turns.groupBy(F.col("conv_id").alias("search_id")).agg((F.col("conv_id") % 150).alias("run_id"), F.array_sort(F.collect_list(hit)).alias("hits"), F.min_by("text", "turn").alias("query"))


#: The same entities for DuckDB, to go before an oracle's statement.
SQL = """
WITH articles AS (
  SELECT doc_id AS id, CAST(substr(source, 4) AS BIGINT) AS source_id, 'https://' || source || '.example.com/a/' || doc_id AS url,
    substr(split_part(text, chr(10), 1), 1, 80) AS title, text AS content,
    CASE doc_id % 4 WHEN 1 THEN strftime(DATE '2024-01-01' + CAST(doc_id % 400 AS INTEGER), '%Y-%m-%d')
      WHEN 2 THEN strftime(DATE '2024-01-01' + CAST(doc_id % 400 AS INTEGER), '%B %-d, %Y')
      WHEN 3 THEN strftime(DATE '2024-01-01' + CAST(doc_id % 400 AS INTEGER), '%Y-%m-%d') || 'T10:00:00Z' END AS published_at,
    CASE WHEN doc_id % 4 > 0 THEN DATE '2024-01-01' + CAST(doc_id % 400 AS INTEGER) ELSE DATE '2025-06-01' + CAST(doc_id % 100 AS INTEGER) END AS date_iso,
    DATE '2025-06-01' + CAST(doc_id % 100 AS INTEGER) AS extracted_at, 1 + doc_id % 5 AS run_id,
    CASE WHEN doc_id % 7 = 1 THEN 'tool' WHEN doc_id % 7 = 2 THEN 'release' WHEN doc_id % 7 > 2 THEN 'news' END AS kind,
    CASE WHEN doc_id % 5 > 0 THEN 'https://issue.example.com/' || (doc_id // 10) END AS issue_url,
    CASE WHEN doc_id % 3 > 0 THEN substr(text, 1, 60) END AS blurb, lang, doc_id % 11 = 0 AS needs_enrich, CAST(doc_id % 4 AS INTEGER) AS enrich_attempts
  FROM documents),
sources AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(n_regionkey AS BIGINT) AS group_id FROM nation),
statuses AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'ok' WHEN toxic = 1 THEN 'junk' ELSE 'suspect' END AS verify_status FROM labels),
verified AS (SELECT a.*, s.verify_status FROM articles a LEFT JOIN statuses s ON a.id = s.id),
tags AS (
  SELECT doc_id AS article_id, 'domain' AS facet, lang AS tag, 0 AS rank FROM documents
  UNION ALL SELECT doc_id, 'topic-technology', source, 0 FROM documents
  UNION ALL SELECT doc_id, 'topic-technology', 't' || (doc_id % 13), 1 FROM documents
  UNION ALL SELECT doc_id, 'content-type', CASE doc_id % 6 WHEN 0 THEN 'tool-release' WHEN 1 THEN 'release-announcement' ELSE 'tutorial' END, 0 FROM documents
  UNION ALL SELECT doc_id, 'framework-library-tool', 'spark', 0 FROM documents WHERE doc_id % 9 = 0),
ledger AS (SELECT event_id, ts, user_id AS run_id, event_type AS stage, value AS cost_usd, props FROM events),
frontier AS (
  SELECT o_orderkey AS id, 'https://src' || (o_orderkey % 20) || '.example.com/a/' || o_orderkey AS url,
    CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'failed' ELSE 'in_progress' END END AS state,
    CASE o_orderkey % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'roundup' ELSE 'listing' END AS kind, CAST(o_orderkey % 5 AS INTEGER) AS retries,
    o_custkey % 20 AS source_id, CAST(o_orderdate AS DATE) AS created FROM orders),
hits AS (
  SELECT conv_id AS search_id, turn AS pos, conv_id * 37 + turn * 11 AS id,
    CASE turn % 3 WHEN 0 THEN 'direct' WHEN 1 THEN 'similar' ELSE 'none' END AS relation,
    CASE turn % 2 WHEN 0 THEN 'news' ELSE 'tool' END AS kind FROM conversations)
"""
