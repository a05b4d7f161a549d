"""The tables' schemas, declared once and never inferred."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = 2
SCHEMAS = {
    "threads": "id string, namespace string, title string, summary string, metadata map<string,string>, created_at timestamp_ntz, updated_at timestamp_ntz",
    "messages": "id string, namespace string, thread_id string, role string, content string, metadata map<string,string>, summarized boolean, created_at timestamp_ntz",
    "collections": "id string, namespace string, name string, description string, chunk_config struct<strategy:string,max_tokens:int,overlap:int,separator:string>, created_at timestamp_ntz",
    "documents": "id string, namespace string, collection_id string, title string, content string, content_type string, source string, metadata map<string,string>, created_at timestamp_ntz, updated_at timestamp_ntz",
    "chunks": "id string, document_id string, namespace string, collection_id string, content string, chunk_index int, token_count int, metadata map<string,string>, embedding array<float>, created_at timestamp_ntz",
    "context_history": "id long, namespace string, run_id string, key string, value string, version long, operation string, updated_at timestamp_ntz, updated_by string, ttl_expires_at timestamp_ntz",
    "entities": "id string, namespace string, name string, type string, aliases array<string>, summary string, attributes map<string,string>, metadata map<string,string>, mention_count long, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz",
    "entity_aliases": "namespace string, alias string, entity_id string",
    "entity_mentions": "id string, entity_id string, namespace string, source_type string, source_id string, context string, snippet string, created_at timestamp_ntz",
    "entity_relationships": "id string, namespace string, source_entity_id string, target_entity_id string, relation_type string, description string, confidence double, mention_count long, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz",
    "extraction_queue": "id long, namespace string, source_type string, source_id string, content string, status string, attempts int, created_at timestamp_ntz, processed_at timestamp_ntz",
    "message_embeddings": "message_id string, embedding array<float>",
    "entity_embeddings": "entity_id string, embedding array<float>",
    "metadata": "key string, value string",
}

#: (table, version): what brings rows of this version to the next. Version 2 added the time to live of context entries.
MIGRATIONS: dict[tuple[str, int], Callable[[DataFrame], DataFrame]] = {
    ("context_history", 1): lambda rows: rows.withColumn("ttl_expires_at", F.lit(None).cast("timestamp_ntz")),
}


def migrated(rows: DataFrame, table: str, version: int) -> DataFrame:
    """Rows written under an older version of the schemas in the form of the present one."""
    for v in range(version, SCHEMA_VERSION):
        if (table, v) in MIGRATIONS:
            rows = MIGRATIONS[table, v](rows)
    return rows
