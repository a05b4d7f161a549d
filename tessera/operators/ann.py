"""Approximate search: vectors in cells around centroids, stored cell by cell, so that a query reads few of them.

Centroids are fitted on a bounded sample (SAMPLE rows, all where there are fewer); every row is stored. A query looks into
the cells whose centroids are nearest to it, and the rows there are compared exactly. More probes find more."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.similarity import matrix
from tessera.operators.vectors import top_k
from tessera.plans.shared import Folder, read_parts, write_parts

SAMPLE, MOST_CELLS, ROUNDS = 65_536, 4_096, 8


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-30)


def centroids(x: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Directions around which the rows gather, by a few rounds of spherical k-means. Empty cells keep their place."""
    rng = np.random.default_rng(seed)
    x = _unit(x).astype(np.float32)
    c = x[rng.choice(len(x), cells, replace=False)].copy()
    for _ in range(ROUNDS):
        own = np.concatenate([(part @ c.T).argmax(axis=1) for part in np.array_split(x, max(1, len(x) // 4_096))])
        total = np.zeros(c.shape, np.float64)
        np.add.at(total, own, x)
        full = np.bincount(own, minlength=cells) > 0
        c[full] = _unit(total[full]).astype(np.float32)
    return c


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str, dim: int) -> None:
        self.spark, self.path, self.dim = spark, path.rstrip("/"), dim
        self.files = Folder(spark, self.path)

    def _cell(self, vector: Column, c: np.ndarray) -> Column:
        shared, dim = self.spark.sparkContext.broadcast(c), self.dim  # MOST_CELLS x dim numbers at most

        @F.arrow_udf("int")
        def nearest(column: pa.Array) -> pa.Array:
            at, x = matrix(column, dim)
            out = np.full(len(column), -1, np.int32)
            if len(at):
                out[at] = np.concatenate([(part @ shared.value.T).argmax(axis=1) for part in np.array_split(x, max(1, len(x) // 4_096))])
            return pa.array(out, mask=out < 0)

        return nearest(vector)

    def build(self, rows: DataFrame, id_col: str = "id", vector_col: str = "embedding", cells: int | None = None) -> VectorIndex:
        """Index all rows with a usable vector. A crowded cell is written by as many tasks as it needs."""
        n = rows.count()
        cells = min(MOST_CELLS, max(1, round(n**0.5))) if cells is None else cells
        share = F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(n, 1)))
        _, x = matrix(rows.where(share).select(vector_col).toArrow()[vector_col].combine_chunks(), self.dim)
        c = centroids(x, min(cells, len(x))) if len(x) else np.zeros((1, self.dim), np.float32)
        self.spark.createDataFrame(
            [(i, r.tolist()) for i, r in enumerate(c)], "cell int, center array<float>",
        ).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centroids")
        placed = rows.withColumn("cell", self._cell(F.col(vector_col), c)).where("cell IS NOT NULL")
        write_parts(placed.hint("rebalance", "cell"), self.files, "rows", "cell")
        return self

    def search(self, query: list[float], k: int, probes: int = 16, id_col: str = "id", vector_col: str = "embedding", **options) -> DataFrame:
        """The k nearest rows of the `probes` nearest cells, as vectors.top_k gives them; only these cells' folders are read."""
        found = self.spark.read.parquet(f"{self.path}/centroids").collect()
        near = np.array([r.center for r in found]) @ np.asarray(query, np.float64)
        cells = [found[i].cell for i in np.argsort(-near, kind="stable")[:probes]]
        rows = read_parts(self.spark, self.files, "rows").where(F.col("cell").isin(*cells)).drop("cell")
        return top_k(rows, query, k, id_col, vector_col, **options)
