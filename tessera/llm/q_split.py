"""p1: splitting oversized documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.splitting import limit_of, split_documents
from tessera.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return split_documents(table(spark, d, "documents"), table(spark, d, "collections"), with_content=False).where("piece = 0").select("doc_id")


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_documents(table(spark, d, "documents"), table(spark, d, "collections"))


def p1_coverage(spark: SparkSession, d: str) -> DataFrame:
    """By document: the words that are new in its pieces, all together, and whether every piece stays within the limit, numbers run from 0 and no piece is missing."""
    docs, collections = table(spark, d, "documents"), table(spark, d, "collections")
    pieces = split_documents(docs, collections, with_content=False)
    fresh = F.sum(F.col("n_words") - F.col("n_overlap"))
    by = pieces.groupBy("doc_id").agg(
        fresh.alias("n_words"), F.max("n_words").alias("longest"), (F.max("piece") + 1).alias("n"),
        F.count("*").alias("found"), F.max("n_pieces").alias("said"),
    )
    limits = docs.join(
        collections.select(F.col("id").alias("collection_id"), "chunk_config.max_tokens"), "collection_id", "left",
    ).select("doc_id", limit_of(F.col("max_tokens")).alias("most"))
    return by.join(limits, "doc_id").select(
        "doc_id", "n_words", (F.col("longest") <= F.col("most")).alias("within"),
        ((F.col("n") == F.col("found")) & (F.col("n") == F.col("said"))).alias("whole"),
    )


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p1_coverage)}
_WORDS = r"regexp_extract_all(text, '[^\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+')"
_LIMIT = "CASE WHEN c.chunk_config.max_tokens > 0 THEN c.chunk_config.max_tokens ELSE 512 END"
ORACLE = {
    "p1_coverage": f"SELECT doc_id, CAST(len({_WORDS}) AS BIGINT) AS n_words, true AS within, true AS whole FROM documents d LEFT JOIN collections c ON d.collection_id = c.id WHERE len({_WORDS}) > {_LIMIT}",
    "p1_found": r"""
SELECT doc_id FROM documents d LEFT JOIN collections c ON d.collection_id = c.id
WHERE len(regexp_extract_all(text, '[^\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'))
  > CASE WHEN c.chunk_config.max_tokens > 0 THEN c.chunk_config.max_tokens ELSE 512 END""",
}
