"""p7: conversations rebuilt from message rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.conversations import conversations, verdicts
from tessera.sources.tables import table


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return verdicts(table(spark, d, "messages"), table(spark, d, "threads")).where("NOT kept").select("thread_id")


def p7_conversations(spark: SparkSession, d: str) -> DataFrame:
    return conversations(table(spark, d, "messages"), table(spark, d, "threads"))


QUERIES = {f.__name__: f for f in (p7_found, p7_conversations)}

_WS = r"'^[\s\x0b\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x0b\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '', 'g'"
_BASE = rf"""
WITH m AS (
  SELECT DISTINCT id, thread_id, content, created_at,
    CASE lower(regexp_replace(role, {_WS})) WHEN 'human' THEN 'user' WHEN 'bot' THEN 'assistant' WHEN 'ai' THEN 'assistant' ELSE lower(regexp_replace(role, {_WS})) END AS role
  FROM messages WHERE thread_id IS NOT NULL AND regexp_replace(content, {_WS}) <> ''),
said AS (
  SELECT thread_id, role, lead(role) OVER w AS after, row_number() OVER w AS n FROM m WHERE role IN ('user', 'assistant')
  WINDOW w AS (PARTITION BY thread_id ORDER BY created_at, id)),
a AS (
  SELECT thread_id, bool_or(role = 'user') AS has_user, bool_or(role = 'assistant') AS has_reply,
    bool_or(n = 1 AND role = 'assistant') AS starts_badly, bool_or(role = 'user' AND after IS DISTINCT FROM 'assistant') AS unanswered FROM said GROUP BY 1),
b AS (SELECT thread_id, bool_or(created_at IS NULL OR role IS NULL OR role NOT IN ('user', 'assistant', 'system', 'tool')) AS bad FROM m GROUP BY 1),
ids AS (SELECT id AS thread_id FROM threads WHERE id IS NOT NULL UNION SELECT thread_id FROM messages WHERE thread_id IS NOT NULL),
verdict AS (
  SELECT ids.thread_id, coalesce(NOT bad AND has_user AND has_reply AND NOT starts_badly AND NOT unanswered, false) AS kept
  FROM ids LEFT JOIN a USING (thread_id) LEFT JOIN b USING (thread_id))
"""
ORACLE = {
    "p7_found": _BASE + "SELECT thread_id FROM verdict WHERE NOT kept",
    "p7_conversations": _BASE
    + """SELECT thread_id, row_number() OVER (PARTITION BY thread_id ORDER BY created_at, id) AS turn, id, role, content, created_at
    FROM m WHERE thread_id IN (SELECT thread_id FROM verdict WHERE kept)""",
}
