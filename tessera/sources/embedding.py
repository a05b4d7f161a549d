"""Embedding of texts through a pluggable function, with each distinct text embedded once."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.keys import WHITE_SPACE

BATCH = 100
_WORD = re.compile(f"[^{re.escape(WHITE_SPACE)}]+")
Embed = Callable[[list[str]], np.ndarray]


def hash_embedder(dim: int = 64) -> Embed:
    """Deterministic offline stand-in for a model: signed hashes of words, summed."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in _WORD.findall(text.lower()):
                h = hashlib.md5(word.encode("utf-8", "ignore"), usedforsecurity=False).digest()
                row[int.from_bytes(h[:4], "big") % dim] += 1 if h[4] & 1 else -1
        return out

    return embed


class Provider:
    """A model behind the rules of the service: single texts must not be empty, batches hold `limit` texts at most, and empty
    texts in a batch have the zero vector and don't reach the model."""

    def __init__(self, model: Embed, dim: int, limit: int = BATCH) -> None:
        self.model, self.dim, self.limit = model, dim, limit

    def one(self, text: str) -> np.ndarray:
        if not text or not text.strip():
            raise ValueError("an empty text has no vector")
        return np.asarray(self.model([text]), np.float32)[0]

    def batch(self, texts: list[str | None]) -> np.ndarray:
        if len(texts) > self.limit:
            raise ValueError(f"{len(texts)} texts; {self.limit} at most")
        out = np.zeros((len(texts), self.dim), np.float32)
        full = [i for i, t in enumerate(texts) if t]
        if full:
            out[full] = self.model([texts[i] for i in full])
        return out


def embedded(rows: DataFrame, text_col: str, embed: Embed, dim: int, cache: DataFrame | None = None) -> DataFrame:
    """rows with an `embedding`; empty and null texts get the zero vector. Only distinct texts that `cache`
    (text_hash, embedding) lacks go to the function, in batches of BATCH."""
    keyed = rows.withColumn("__h", F.sha2(F.coalesce(text_col, F.lit("")), 256))
    todo = keyed.select(F.col("__h").alias("text_hash"), F.coalesce(text_col, F.lit("")).alias("text")).dropDuplicates(["text_hash"])
    if cache is not None:
        todo = todo.join(cache, "text_hash", "left_anti")

    provider = Provider(embed, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), provider.limit):
                part = whole.slice(at, provider.limit)
                v = provider.batch(part["text"].to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, dim, dtype=np.int32)), pa.array(v.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part["text_hash"], lists], names=["text_hash", "embedding"])

    made = todo.mapInArrow(run, "text_hash string, embedding array<float>")
    made = made if cache is None else made.unionByName(cache.select("text_hash", "embedding"))
    return keyed.join(made.withColumnRenamed("text_hash", "__h"), "__h", "left").drop("__h")
