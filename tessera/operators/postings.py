"""A text index: postings by term, so that a query reads its own terms and no text.

Below the index's path lie postings (term, id, at: the places of the term in the text, length: of the text), in folders by
the hash of the term, and counts (one row: rows and their mean length). Scores are those of fulltext.bm25."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import terms
from tessera.operators.fulltext import K1, LEAST_IDF, B, phrases
from tessera.plans.shared import Folder, read_parts, write_parts

BUCKETS = 64


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in (whole.slice(i, 256) for i in range(0, len(whole), 256)):
            cols: tuple[list, ...] = ([], [], [], [])
            for key, words in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                at: dict[str, list[int]] = {}
                for i, w in enumerate(words):
                    at.setdefault(w, []).append(i)
                for w, places in at.items():
                    for c, v in zip(cols, (w, key, places, len(words)), strict=True):
                        c.append(v)
            if cols[0]:
                types = (pa.string(), batch[0].type, pa.list_(pa.int32()), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["term", "id", "at", "length"])


class TextIndex:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.files = Folder(spark, self.path)

    def build(self, rows: DataFrame, id_col: str, text: Column) -> TextIndex:
        """Index all rows. Rows of one id must be alike; they count once. Each bucket's rows are split while it is too large for one task."""
        tokens = rows.select(F.col(id_col).alias("id"), terms(text).alias("t"))
        kind = tokens.schema["id"].dataType.simpleString()
        postings = tokens.mapInArrow(_places, f"term string, id {kind}, at array<int>, length int").withColumn("bucket", _bucket(F.col("term")))
        write_parts(postings.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term"), self.files, "postings", "bucket")
        sizes = tokens.select("id", F.size("t").alias("n")).groupBy("id").agg(F.max("n").alias("n"))
        sizes.agg(F.count("*").alias("n"), F.avg("n").alias("mean")).write.mode("overwrite").parquet(f"{self.path}/counts")
        return self

    def search(self, query: str, k: int) -> DataFrame:
        """id, score, rank of the k best. Only the folders of the query's terms are read."""
        wanted = phrases(query)
        postings = read_parts(self.spark, self.files, "postings")
        if not wanted:
            return postings.limit(0).select("id", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
        used = sorted({t for p in wanted for t in p})
        buckets = [
            r.b for r in self.spark.createDataFrame([(t,) for t in used], "term string").select(_bucket(F.col("term")).alias("b")).distinct().collect()
        ]
        found = postings.where(F.col("bucket").isin(*buckets) & F.col("term").isin(*used)).dropDuplicates(["id", "term"])
        at = {t: F.max(F.when(F.col("term") == t, F.col("at"))).alias(f"t{i}") for i, t in enumerate(used)}
        rows = found.groupBy("id").agg(F.max("length").alias("length"), *at.values())
        place = {t: F.coalesce(F.col(f"t{i}"), F.array().cast("array<int>")) for i, t in enumerate(used)}

        def moved(places: Column, n: int) -> Column:
            return F.transform(places, lambda x: x - n)

        def frequency(phrase: tuple[str, ...]) -> Column:
            starts = place[phrase[0]]
            for n, t in enumerate(phrase[1:], 1):
                starts = F.array_intersect(starts, moved(place[t], n))
            return F.size(starts)

        rows = rows.select("id", "length", *(frequency(p).alias(f"f{i}") for i, p in enumerate(wanted)))
        counted = rows.agg(*(F.count_if(F.col(f"f{i}") > 0).alias(f"df{i}") for i in range(len(wanted))))  # one row
        scored = rows.join(F.broadcast(counted)).join(F.broadcast(self.spark.read.parquet(f"{self.path}/counts")))  # one row each

        def part(i: int) -> Column:
            df, f = F.col(f"df{i}"), F.col(f"f{i}")
            idf = F.greatest(F.log((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))
            return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.col("mean")))

        some = F.greatest(*(F.col(f"f{i}") for i in range(len(wanted))), F.lit(0)) > 0
        hits = scored.where(some).select("id", sum((part(i) for i in range(len(wanted))), F.lit(0.0)).alias("score"))
        hits = hits.withColumn("__s", F.round("score", 12)).orderBy(F.desc("__s"), "id").limit(k)
        return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("__s"), "id"))).drop("__s")
