"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a grouped minimum and a join; the edge table is written out every round, so lineage stays
short and a lost executor repeats one round at most. Large-star hangs a node's larger neighbours under
the smallest neighbour, small-star its smaller ones; both together halve distances, so rounds grow
with the logarithm of a component's diameter. No component is ever gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.lineage import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with u > v. Large: both directions, neighbours larger than the node; small: the others and the node."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, a: str, b: str, tag: str = "components") -> DataFrame:
    """node, component (its smallest node) for every node of an edge; nulls and loops are ignored."""
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = written(e.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), tag)
    facts = F.xxhash64("u", "v").cast("decimal(38,0)")
    before = None
    while True:
        e = written(_star(_star(e, True), False), tag)
        now = e.agg(F.count("*"), F.sum(facts)).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
