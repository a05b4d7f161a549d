"""p8: encoding of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import decoded_sizes, encode_texts
from tessera.sources.tables import table


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(table(spark, d, "documents"))


def p8_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Tokens, characters and tokens per character of each language and content type."""
    docs = table(spark, d, "documents")
    ids = encode_texts(docs.select("doc_id", "text")).select("doc_id", F.size("ids").alias("n"))
    by = docs.select("doc_id", "lang", "content_type", F.length("text").alias("chars")).join(ids, "doc_id")
    return by.groupBy("lang", "content_type").agg(
        F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"), F.sum("chars").alias("n_chars"), F.round(F.try_divide(F.sum("n"), F.sum("chars")), 6).alias("tokens_per_char")
    )


def p8_bytes(spark: SparkSession, d: str) -> DataFrame:
    """The bytes that each document's ids stand for: as many as its text has."""
    return decoded_sizes(encode_texts(table(spark, d, "documents"))).select("doc_id", "n_bytes")


QUERIES = {f.__name__: f for f in (p8_ids, p8_lengths, p8_bytes)}
ORACLE = {"p8_bytes": "SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents"}
