"""Retention rules and statistics. Every rule is a condition, so a dry run counts what a run would delete."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cutoff(now: datetime, days: int) -> Column:
    return F.lit(now - timedelta(days=days)).cast("timestamp_ntz")


def old_conversations(threads: DataFrame, now: datetime, days: int) -> DataFrame:
    """Threads without an update for so many days; none if days is not positive."""
    return threads.where(F.col("updated_at") < cutoff(now, days) if days > 0 else F.lit(False))


def stale_entities(entities: DataFrame, now: datetime, days: int, least_mentions: int) -> DataFrame:
    return entities.where((F.col("last_seen_at") < cutoff(now, days)) & (F.col("mention_count") < least_mentions) if days > 0 else F.lit(False))


def orphan_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks whose document does not exist; a chunk without a document is none."""
    have = documents.select(F.col("id").alias("document_id"))
    return chunks.where("document_id IS NOT NULL").join(have, "document_id", "left_anti")


def old_history(log: DataFrame, now: datetime, days: int) -> DataFrame:
    return log.where(F.col("updated_at") < cutoff(now, days) if days > 0 else F.lit(False))


def old_runs(entries: DataFrame, now: datetime, days: int) -> DataFrame:
    return old_history(entries, now, days).where("run_id != ''")


def without(rows: DataFrame, gone: DataFrame, key: str, gone_key: str = "id") -> DataFrame:
    """Rows that don't depend on deleted ones: the cascade of a delete."""
    return rows.join(gone.select(F.col(gone_key).alias("__gone")), rows[key] == F.col("__gone"), "left_anti")


def collection_stats(documents: DataFrame, chunks: DataFrame, collections: DataFrame) -> DataFrame:
    """Documents, chunks, tokens and the last document of each collection. Both sides are added up before they meet."""
    docs = documents.groupBy("collection_id").agg(F.count("*").alias("n_documents"), F.max("created_at").alias("last_document_at"))
    parts = chunks.groupBy("collection_id").agg(F.count("*").alias("n_chunks"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("n_tokens"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (
        collections.select(F.col("id").alias("collection_id"), "name").join(docs, "collection_id", "left").join(parts, "collection_id", "left")
        .select("collection_id", "name", zero("n_documents"), zero("n_chunks"), zero("n_tokens"), "last_document_at")
    )


def namespace_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """namespace and one count per table, from one aggregate a table."""
    parts = None
    for name, df in tables.items():
        one = df.groupBy("namespace").agg(F.count("*").alias("n")).select("namespace", F.lit(name).alias("t"), "n")
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy("namespace").agg(*(F.coalesce(F.sum(F.when(F.col("t") == n, F.col("n"))), F.lit(0)).alias(f"n_{n}") for n in tables))
