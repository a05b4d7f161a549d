"""p9: evaluation passages in the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.leakage import leaks
from tessera.sources.tables import table


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    found = leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.where("kind = 'words'").select("doc_id", "item_id")


def p9_reparameterised(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold an item's passage with other numbers, names or units; slots_agree is false where these don't stand one to one."""
    found = leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.where("kind = 'template'").select("doc_id", "item_id", "n_words", "slots_agree")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Leaking documents of each item, by kind."""
    found = leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.groupBy("item_id", "kind").agg(
        F.count("*").alias("n_docs"), F.max("n_words").alias("most_words"),
        F.count_if("slots_agree").alias("n_slots_agree"),
    )


QUERIES = {f.__name__: f for f in (p9_found, p9_reparameterised, p9_report)}
ORACLE: dict[str, str] = {}
