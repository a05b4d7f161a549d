"""p3: rows of entities and extracted entities that stand for one thing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.names import link_names, pairs
from tessera.sources.tables import table


def _linked(spark: SparkSession, d: str) -> DataFrame:
    entities, extracted = table(spark, d, "entities"), table(spark, d, "extracted_entities")
    shape = lambda df: df.select(
        "id", "namespace", "name", "aliases", "type", F.try_element_at("attributes", F.lit("city")).alias("city"),
    )
    return link_names(shape(entities).unionByName(shape(extracted)), trusted=shape(entities))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs(_linked(spark, d))


def p3_things(spark: SparkSession, d: str) -> DataFrame:
    """One row an id: its thing, named by the smallest id of it, and how many rows the thing has."""
    linked = _linked(spark, d)
    sizes = linked.groupBy("namespace", "thing").agg(F.min("id").alias("thing_id"), F.count("*").alias("n_rows"))
    return linked.join(sizes, ["namespace", "thing"]).select("id", "namespace", "thing_id", "n_rows")


QUERIES = {f.__name__: f for f in (p3_found, p3_things)}
ORACLE: dict[str, str] = {}
