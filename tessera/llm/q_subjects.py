"""p10: subject areas of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.subjects import classify, train_on
from tessera.sources.tables import table


def _classified(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return classify(docs, train_on(docs, table(spark, d, "subject_labels")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d).select("doc_id", "subject")


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents and words by language and subject; a document of two subjects is shared out."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.size(F.split("text", r"\s+")).alias("words"))
    by = _classified(spark, d).join(docs, "doc_id")
    return by.groupBy("lang", "subject").agg(
        F.count("*").alias("n_docs"), F.round(F.sum("share"), 3).alias("docs_shared_out"),
        F.round(F.sum(F.col("share") * F.col("words")), 1).alias("words_shared_out"),
    )


QUERIES = {f.__name__: f for f in (p10_found, p10_composition)}
ORACLE: dict[str, str] = {}
