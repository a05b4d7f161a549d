"""Exact vector search: the k best rows for one vector, or for each of a stated set of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.similarity import cosine_to, matrix

#: Queries that go to the workers at once, and that one call may ask: a stated set, which is read to the driver block by block.
BLOCK, MOST_QUERIES = 4_096, 1 << 18
#: Rows that are compared with a block at once: bounds a worker's memory.
ROWS = 2_048


def scored(cosine: Column, mode: str = "half") -> Column:
    """`half`: 1 - distance / 2; `one_minus`: 1 - distance."""
    return (1 + cosine) / 2 if mode == "half" else cosine


def top_k(
    rows: DataFrame, query: list[float], k: int, id_col: str, vector_col: str = "embedding", mode: str = "half",
    min_score: float = 0.0, where: Column | None = None, repeated: bool = False,
) -> DataFrame:
    """The k rows nearest to `query` with score and rank; min_score is applied to the k. Ties go to the smaller id.

    Filters and columns reach the scan; each task keeps its k best, so nothing but k rows a task moves. If ids may be
    delivered more than once (`repeated`), deliveries share a dense rank, which Spark also cuts in each task."""
    rows = rows if where is None else rows.where(where)
    # unusable vectors have no cosine and come last; they are dropped behind the cut, as a filter before it would
    # make Spark compute every cosine twice
    rows = rows.withColumn("__cos", cosine_to(F.col(vector_col), query)).drop(vector_col)
    if repeated:
        best = F.dense_rank().over(Window.orderBy(F.desc("__cos"), id_col))
        hits = rows.withColumn("__r", best).where(F.col("__r") <= k).drop("__r").dropDuplicates([id_col])
    else:
        hits = rows.orderBy(F.desc("__cos"), id_col).limit(k)
    hits = hits.where(F.col("__cos").isNotNull())
    out = hits.withColumn("score", scored(F.col("__cos"), mode)).withColumn(
        "rank", F.row_number().over(Window.orderBy(F.desc("__cos"), id_col)),
    ).drop("__cos")
    return out.where(F.col("score") >= min_score) if min_score > 0 else out


def with_metadata(rows: DataFrame, wanted: dict[str, str], column: str = "metadata") -> DataFrame:
    """Rows whose map holds every wanted pair; null maps and missing keys don't."""
    for key, value in wanted.items():
        rows = rows.where(F.coalesce(F.try_element_at(column, F.lit(key)) == value, F.lit(False)))
    return rows


def batch_top_k(
    rows: DataFrame, queries: DataFrame, k: int, dim: int, id_col: str = "id", query_col: str = "query_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_col, id_col, cosine, rank for each row of `queries` (query_col, vector_col), which go out in blocks.

    Beyond MOST_QUERIES queries it is an error: that is a join of tables, not a batch of questions."""
    spark = rows.sparkSession
    n = queries.count()
    if n > MOST_QUERIES:
        raise ValueError(f"{n} queries; {MOST_QUERIES} at most")
    blocks = max(1, -(-n // BLOCK))
    kinds = f"`{query_col}` {queries.schema[query_col].dataType.simpleString()}, `{id_col}` {rows.schema[id_col].dataType.simpleString()}, cosine double"
    out = spark.createDataFrame([], kinds)
    for b in range(blocks):
        part = queries.select(query_col, vector_col).where(F.pmod(F.xxhash64(query_col), F.lit(blocks)) == b).toArrow()
        at, q = matrix(part[vector_col].combine_chunks(), dim)
        names = part[query_col].combine_chunks().take(pa.array(at))
        shared = spark.sparkContext.broadcast((names, q / np.sqrt((q * q).sum(axis=1))[:, None]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            for batch in (whole.slice(i, ROWS) for whole in batches for i in range(0, len(whole), ROWS)):
                at, x = matrix(batch[1], dim)
                if not len(at) or not len(names):
                    continue
                s = q @ (x / np.sqrt((x * x).sum(axis=1))[:, None]).T
                n = min(k, s.shape[1])
                # all that tie with the k-th stay, so that the smaller id can win
                least = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
                i, j = np.nonzero(s >= least[:, None])
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(i)), batch[0].take(pa.array(at[j])), pa.array(s[i, j])],
                    names=[query_col, id_col, "cosine"],
                )

        found = rows.select(id_col, vector_col).mapInArrow(run, kinds)
        out = found if b == 0 else out.unionByName(found)
    order = Window.partitionBy(query_col).orderBy(F.desc(F.round("cosine", 12)), id_col)
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def upserted(vectors: DataFrame, key: list[str], order: list[str], vector_col: str = "embedding") -> DataFrame:
    """The latest vector of each key, by `order`."""
    return vectors.groupBy(*key).agg(
        F.max_by(vector_col, F.struct(*order)).alias(vector_col), F.max(F.struct(*order)).alias("__at"),
    ).select(*key, vector_col, "__at.*")
