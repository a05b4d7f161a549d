"""Queries of the general data-quality operators: orphan references and change feeds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.keys import code
from tessera.operators import delete_vectors as dv
from tessera.operators import orphans as orph
from tessera.plans.lineage import shared_dir
from tessera.sources.tables import table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    kind = code("source_type")
    mention_target = F.when(kind == "conversation", F.lit("messages")).when(kind == "knowledge", F.lit("chunks"))
    chunks, messages = table(spark, d, "chunks"), table(spark, d, "messages")
    refs = (
        orph.references(chunks, "chunks", "document_id", F.lit("documents"))
        .unionByName(orph.references(messages, "messages", "thread_id", F.lit("threads")))
        .unionByName(orph.references(table(spark, d, "entity_mentions"), "entity_mentions", "source_id", mention_target))
    )
    known = (
        orph.parents(table(spark, d, "documents"), "documents")
        .unionByName(orph.parents(table(spark, d, "threads"), "threads"))
        .unionByName(orph.parents(messages, "messages"))
        .unionByName(orph.parents(chunks, "chunks"))
    )
    return orph.find_orphans(refs, known, orph.tombstones(table(spark, d, "deletions")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("table_name", "record_id", "ref_state")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return orph.orphan_report(_orphans(spark, d))


_P4 = r"""
WITH m AS (SELECT *, nullif(lower(trim(source_type)), '') AS kind FROM entity_mentions),
refs AS (
  SELECT 'chunks' AS table_name, id AS record_id, 'documents' AS target, lower(trim(document_id)) AS key, created_at FROM chunks
  UNION ALL SELECT 'messages', id, 'threads', lower(trim(thread_id)), created_at FROM messages
  UNION ALL SELECT 'entity_mentions', id, CASE kind WHEN 'conversation' THEN 'messages' ELSE 'chunks' END, lower(trim(source_id)), created_at
  FROM m WHERE kind IN ('conversation', 'knowledge')),
known AS (
  SELECT target, key, min(created_at) AS born FROM (
    SELECT 'documents' AS target, lower(trim(id)) AS key, created_at FROM documents
    UNION ALL SELECT 'threads', lower(trim(id)), created_at FROM threads
    UNION ALL SELECT 'messages', lower(trim(id)), created_at FROM messages
    UNION ALL SELECT 'chunks', lower(trim(id)), created_at FROM chunks) GROUP BY ALL),
gone AS (SELECT DISTINCT lower(trim(table_name)) AS target, lower(trim(record_id)) AS key FROM deletions WHERE restored_at IS NULL),
states AS (
  SELECT r.table_name, r.record_id, r.key, r.created_at,
    CASE WHEN g.key IS NOT NULL THEN 'deleted' WHEN k.key IS NULL THEN 'missing' WHEN k.born > r.created_at THEN 'late' END AS ref_state
  FROM refs r LEFT JOIN gone g USING (target, key) LEFT JOIN known k USING (target, key)
  WHERE r.key IS NOT NULL AND r.key <> '')
"""

_CURRENT = """
SELECT namespace, coalesce(run_id, '') AS run_id, key, version, value, updated_at, id, lower(trim(operation)) AS op
FROM context_history WHERE lower(trim(operation)) IN ('set', 'merge', 'delete')
QUALIFY row_number() OVER (PARTITION BY namespace, coalesce(run_id, ''), key ORDER BY updated_at DESC, version DESC, id DESC) = 1
"""


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return dv.current_entries(table(spark, d, "context_history")).select(*dv.KEY, "version")


def p6_current(spark: SparkSession, d: str) -> DataFrame:
    """The current rows read from a delete-vector table to which the feed was applied in two batches, the later arrivals first."""
    feed = table(spark, d, "context_history")
    place = f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}/feed-{uuid.uuid4().hex}"
    middle = feed.agg(F.percentile_approx("id", 0.5)).first()[0]
    later = F.coalesce(F.col("id") > F.lit(middle), F.lit(False))
    entries = dv.DeleteVectorTable(spark, place)
    entries.apply(feed.where(later))
    entries.apply(feed.where(~later))
    return entries.read().select(*dv.KEY, "version", "value", "updated_at")


QUERIES = {f.__name__: f for f in (p4_found, p4_report, p6_found, p6_current)}

ORACLE = {
    "p4_found": _P4 + "SELECT DISTINCT table_name, record_id, ref_state FROM states WHERE ref_state IS NOT NULL",
    "p4_report": _P4
    + """SELECT table_name, ref_state, month, count(*) AS n_refs, count(DISTINCT key) AS n_keys FROM (
      SELECT DISTINCT table_name, record_id, ref_state, key, coalesce(strftime(created_at, '%Y-%m'), '') AS month FROM states WHERE ref_state IS NOT NULL)
    GROUP BY ALL""",
    "p6_found": f"SELECT namespace, run_id, key, version FROM ({_CURRENT}) WHERE op <> 'delete'",
    "p6_current": f"SELECT namespace, run_id, key, version, value, updated_at FROM ({_CURRENT}) WHERE op <> 'delete'",
}
