"""Reciprocal rank fusion of a vector list and a text list, and hybrid search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.fulltext import search
from tessera.operators.vectors import top_k

OVERFETCH, CONSTANT = 3, 60


def fuse(vector: DataFrame, text: DataFrame, id_col: str, alpha: float = 0.5, constant: int = CONSTANT) -> DataFrame:
    """id_col, score: alpha / (constant + rank) by vector plus the rest by text; a list without the id adds nothing."""
    alpha = alpha if 0 <= alpha <= 1 else 0.5
    constant = constant if constant > 0 else CONSTANT
    parts = vector.select(id_col, (F.lit(alpha) / (constant + F.col("rank"))).alias("w")).unionByName(
        text.select(id_col, (F.lit(1 - alpha) / (constant + F.col("rank"))).alias("w"))
    )
    return parts.groupBy(id_col).agg(F.sum("w").alias("score"))


def ranked(scored: DataFrame, id_col: str, k: int, min_score: float = 0.0) -> DataFrame:
    hits = scored.withColumn("__s", F.round("score", 12)).orderBy(F.desc("__s"), id_col).limit(k)
    hits = hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("__s"), id_col))).drop("__s")
    return hits.where(F.col("score") >= min_score) if min_score > 0 else hits


def hybrid_search(
    rows: DataFrame, id_col: str, text: Column, query: str, vector: list[float], k: int, alpha: float = 0.5,
    constant: int = CONSTANT, min_score: float = 0.0, where: Column | None = None, mode: str = "hybrid",
    empty_text_fallback: bool = True, vector_col: str = "embedding", repeated: bool = False,
    vector_where: Column | None = None,
) -> DataFrame:
    """id_col, score, rank. `where` chooses among all rows, `vector_where` among those of the vector list only. Modes: vector; hybrid; text, which is hybrid with alpha 0. alpha 0 in mode hybrid means 0.5.

    If no row matches the text, the vector list comes back with its own scores (empty_text_fallback); this is a
    flag on the data, not an action in between."""
    fetch = OVERFETCH * k
    near = rows if vector_where is None else rows.where(vector_where)
    by_vector = top_k(
        near.select(id_col, vector_col, *(["namespace"] if "namespace" in rows.columns else [])), vector,
        fetch if mode != "vector" else k, id_col, vector_col, "one_minus", where=where, repeated=repeated,
    )
    if mode == "vector":
        return ranked(by_vector.select(id_col, "score"), id_col, k, min_score)
    alpha = 0.0 if mode == "text" else (alpha or 0.5)
    by_text = search(rows, text, query, fetch, id_col, where, repeated, columns=False).select(id_col, "rank")
    fused = fuse(by_vector, by_text, id_col, alpha, constant)
    if empty_text_fallback:
        n = F.broadcast(by_text.agg(F.count("*").alias("__n")))  # one row
        own = by_vector.select(id_col, F.col("score").alias("__own"))
        fused = fused.join(own, id_col, "left").join(n).select(
            id_col, F.when(F.col("__n") == 0, F.col("__own")).otherwise(F.col("score")).alias("score"),
        )
    return ranked(fused, id_col, k, min_score)
