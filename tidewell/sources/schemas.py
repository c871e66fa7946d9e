"""Schemas of the entities, as DDL; 0/1 flags are booleans and money is double."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DDL = {
    "sources": "id long, name string, base_url string, type string, max_index_pages int, created_at timestamp",
    "pages": "id long, source_id long, url string, html_hash string, status string, pagination_depth int, fetched_at timestamp",
    "articles": "id long, source_id long, url string, title string, content string, content_hash string, published_at string, extracted_at timestamp, title_pt string, summary_pt string, run_id long, kind string, issue_url string, section string, blurb string, content_source string, needs_enrich boolean, cleaned boolean, verify_status string, verify_notes string, enrich_attempts int",
    "selectors": "template_sig string, link_selector string, link_attribute string, content_selector string, next_selector string, date_selector string, date_attribute string, date_regex string, model_used string, confidence double, last_validated timestamp",
    "frontier": "url string, kind string, state string, retries int, discovered_from string, source_id long, depth int, created_at timestamp, discovered_date string, id long",
    "runs": "id long, command string, args string, budget_usd double, new_count long, status string, started_at timestamp, finished_at timestamp",
    "classifications": "article_id long, result_json string, domain_confidence double, taxonomy_version string, model_used string, status string, classified_at timestamp",
    "article_tags": "article_id long, facet string, tag string, rank int",
    "classification_uncovered": "article_id long, facet string, term string",
    "llm_usage": "run_id long, stage string, model string, prompt_tokens long, completion_tokens long, cost_usd double, created_at timestamp",
    "events": "run_id long, source_id long, url string, stage string, status string, detail string, created_at timestamp",
    "searches": "id long, run_id long, origin string, query string, mode string, scope_json string, stats_json string, hits_json string, created_at timestamp",
    "articles_vec": "id long, embedding array<float>",
}
HITS = "array<struct<id:bigint,relation:string,kind:string,score:double,bucket:string>>"

_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "array<float>": T.ArrayType(T.FloatType())}
SCHEMAS: dict[str, T.StructType] = {name: T.StructType([T.StructField(*(f := field.split())[:1], _TYPES[f[1]]) for field in ddl.split(", ")]) for name, ddl in _DDL.items()}


def conform(df: DataFrame, entity: str) -> DataFrame:
    """Additive evolution: missing columns become null, the entity's types and order hold, others go."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMAS[entity]))


def duplicate_keys(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once: the uniqueness check that no table enforces here."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
