"""p5: near-duplicate documents and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.neardup import NearDuplicates
from tessera.sources.tables import table

WIDTH, THRESHOLD, LEAST_WORDS = 3, 0.6, 20


def _texts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.lit("documents").alias("collection"), "id", "text")
    return docs.unionByName(table(spark, d, "messages").select(F.lit("messages").alias("collection"), "id", F.col("content").alias("text")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return NearDuplicates(_texts(spark, d), WIDTH, THRESHOLD, LEAST_WORDS).pairs().withColumnRenamed("collection", "table_name")


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return NearDuplicates(_texts(spark, d), WIDTH, THRESHOLD, LEAST_WORDS).groups().withColumnRenamed("collection", "table_name")


def p5_groups_five(spark: SparkSession, d: str) -> DataFrame:
    """The same with runs of five words and a similarity of 0.8."""
    return NearDuplicates(_texts(spark, d), 5, 0.8, LEAST_WORDS).groups().withColumnRenamed("collection", "table_name")


QUERIES = {f.__name__: f for f in (p5_found, p5_groups, p5_groups_five)}
ORACLE = {
    "p5_found": r"""
WITH t AS (SELECT 'documents' AS table_name, id, text FROM documents UNION ALL SELECT DISTINCT 'messages', id, content FROM messages),
w AS (SELECT table_name, id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM t WHERE id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT DISTINCT table_name, id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 20),
n AS (SELECT table_name, id, count(*) AS n FROM s GROUP BY ALL),
c AS (SELECT a.table_name, a.id AS id_a, b.id AS id_b, count(*) AS c FROM s a JOIN s b ON a.table_name = b.table_name AND a.s = b.s AND a.id < b.id GROUP BY ALL)
SELECT c.table_name, id_a, id_b FROM c JOIN n x ON x.table_name = c.table_name AND x.id = id_a JOIN n y ON y.table_name = c.table_name AND y.id = id_b
WHERE c >= 0.6 * (x.n + y.n - c)""",
}
