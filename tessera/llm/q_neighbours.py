"""p2: most similar chunk vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.neighbours import exact_neighbours, neighbours
from tessera.sources.tables import table

K = 5
#: All rows against all: only neighbours of a cosine of 0.9 and more.
NEAR = {"least": 0.9}
#: Every twentieth id against all rows, at any cosine: compared with all, as no forest keeps far neighbours at every size.
FAR = {"trees": 0}


def every_twentieth() -> Column:
    return F.try_to_number(F.regexp_extract("id", r"(\d+)$", 1), F.lit("999999999999999999")).cast("long") % 20 == 0


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with a cosine of 0.9 where one is among the five most similar of the other."""
    near = neighbours(table(spark, d, "chunks"), K, **NEAR)
    return near.select(F.least("id", "neighbour").alias("chunk_a"), F.greatest("id", "neighbour").alias("chunk_b")).distinct()


def p2_search(spark: SparkSession, d: str) -> DataFrame:
    return neighbours(table(spark, d, "chunks"), K, asks=every_twentieth(), **FAR)


def p2_recall(spark: SparkSession, d: str) -> DataFrame:
    """Share of the true five nearest of every twentieth id that the search and the forest find, at any cosine and at 0.9 and more."""
    chunks = table(spark, d, "chunks")
    out = exact_neighbours(chunks, K, every_twentieth())
    settings = {"search": FAR, "forest": {}, "found": NEAR}
    for name, setting in settings.items():
        got = neighbours(chunks, K, asks=every_twentieth(), **setting)
        out = out.join(got.select("id", "neighbour", F.lit(1).alias(name)), ["id", "neighbour"], "left")
    close = F.col("cosine") >= 0.9
    share = lambda name, among: F.round(F.try_divide(F.count_if(among & F.col(name).isNotNull()), F.count_if(among)), 4)
    return out.agg(
        F.count("*").alias("n_true"),
        F.count_if(close).alias("n_close"),
        *(share(name, F.lit(True)).alias(f"recall_{name}") for name in settings),
        *(share(name, close).alias(f"recall_{name}_close") for name in settings),
    )


QUERIES = {f.__name__: f for f in (p2_found, p2_search, p2_recall)}
ORACLE = {
    "p2_found": """
WITH v AS (SELECT DISTINCT ON (id) id, CAST(embedding AS DOUBLE[]) AS e FROM chunks WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) > 0),
p AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.e, b.e), 7) AS c FROM v a JOIN v b ON a.id <> b.id),
r AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) <= 5)
SELECT DISTINCT least(a, b) AS chunk_a, greatest(a, b) AS chunk_b FROM r WHERE c >= 0.9""",
}
