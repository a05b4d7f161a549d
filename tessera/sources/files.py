"""Text files, in-memory batches and vector bytes as sources; JSON export and table copies as sinks."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Sections of an export, and where each comes from.
SECTIONS = (
    "threads", "messages", "collections", "documents", "chunks", "context", "context_history", "entities", "aliases",
    "mentions", "relationships",
)
_TABLES = {"context": "context_history", "aliases": "entity_aliases", "mentions": "entity_mentions", "relationships": "entity_relationships"}
_VECTORS = {"messages": ("message_embeddings", "message_id"), "entities": ("entity_embeddings", "entity_id")}


def text_files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """One document a file: title (the file's name), source (its path), content, id by content and path; error, where the
    bytes are no UTF-8, and then no content. One bad file fails nothing but itself."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    rows = reader.load(path).select(
        F.col("path").alias("source"), F.element_at(F.split("path", "/"), -1).alias("title"),
        F.expr("try_validate_utf8(cast(content as string))").alias("content"),
    )
    error = F.when(F.col("content").isNull(), F.lit("not UTF-8"))
    return rows.select(F.sha2(F.concat_ws("\x01", "source", "content"), 256).alias("id"), "title", "source", "content", error.alias("error"))


def batch(spark: SparkSession, docs: list[dict]) -> DataFrame:
    """Documents of a call: title, content, content_type, source, metadata."""
    rows = [(d.get("title"), d.get("content"), d.get("content_type") or "text", d.get("source"), d.get("metadata")) for d in docs]
    return spark.createDataFrame(rows, "title string, content string, content_type string, source string, metadata map<string,string>")


def vector_bytes(vector: Column) -> Column:
    """float32 little-endian bytes of a vector. All vectors of a batch are slices of its one buffer of numbers."""

    @F.arrow_udf("binary")
    def pack(v: pa.Array) -> pa.Array:
        offsets = (v.offsets.to_numpy().astype(np.int64) * 4).astype(np.int32)
        numbers = pa.py_buffer(np.ascontiguousarray(v.values.to_numpy(zero_copy_only=False), "<f4").tobytes())
        packed = pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(offsets.tobytes()), numbers])
        return pc.if_else(v.is_valid(), packed, pa.scalar(None, pa.binary()))

    return pack(vector.cast("array<float>"))


def bytes_vector(data: Column) -> Column:
    """The vector of float32 little-endian bytes; null if the length is no multiple of four."""

    @F.arrow_udf("array<float>")
    def unpack(b: pa.Array) -> pa.Array:
        whole = pc.fill_null(pc.equal(pc.bit_wise_and(pc.binary_length(b), 3), 0), False)
        kept = pc.if_else(whole, b, pa.scalar(b"", pa.binary()))
        sizes = pc.binary_length(kept).to_numpy() // 4
        numbers = np.frombuffer(b"".join(kept.to_pylist()), "<f4")
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(numbers))
        return pc.if_else(whole, lists, pa.scalar(None, lists.type))

    return unpack(data)


def export_sections(read, namespace: str, embeddings: bool = False, sections: tuple[str, ...] = SECTIONS) -> dict[str, DataFrame]:
    """The sections of one namespace; `read` gives a table by name. context holds the current entries. With `embeddings`, the
    vectors of messages and entities are joined to their rows, null where there is none; without, chunks come without theirs."""
    from tessera.operators.context import current

    out = {}
    for name in sections:
        rows = read(_TABLES.get(name, name)).where(F.col("namespace") == namespace)
        if name == "context":
            rows = current(rows)
        if embeddings and name in _VECTORS:
            table, key = _VECTORS[name]
            rows = rows.join(read(table).select(F.col(key).alias("id"), "embedding"), "id", "left")
        elif not embeddings and "embedding" in rows.columns:
            rows = rows.drop("embedding")
        out[name] = rows
    return out


def export_json(sections: dict[str, DataFrame], path: str) -> dict[str, str]:
    """One folder of JSON lines for each section."""
    out = {name: f"{path.rstrip('/')}/{name}" for name in sections}
    for name, rows in sections.items():
        rows.write.mode("overwrite").json(out[name])
    return out


def backup(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(os.path.join(path, f"{name}.parquet"))
