"""Chunking of documents: fixed windows, sentence packing, paragraph packing, semantic breaks.

Fixed windows are column expressions. Packing depends on what is already packed, so it is a fold over
each document, run on Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.keys import WHITE_SPACE
from tessera.functions.text import words

_WORD = re.compile(f"[^{re.escape(WHITE_SPACE)}]+")
_BREAK = re.compile(f"(?<=[.!?])[{re.escape(WHITE_SPACE)}](?=(.))", re.S)
Embed = Callable[[list[str]], np.ndarray]
#: Documents of hits up to which they are looked up by name; more are joined.
HITS = 1_000


def sizes(max_tokens: int, overlap: int) -> tuple[int, int]:
    """Window and step: 512 words by default; an overlap that reaches the window is a quarter of it."""
    window = max_tokens if max_tokens > 0 else 512
    overlap = max(overlap, 0)
    return window, max(1, window - (overlap if overlap < window else window // 4))


def fixed_chunks(docs: DataFrame, id_col: str, text_col: str, max_tokens: int, overlap: int, around: int = 0) -> DataFrame:
    """id_col, chunk_index, content, token_count; with `around` also context_before and context_after, the texts of so
    many chunks on either side, cut from the same words, so that no chunk is joined to another."""
    window, step = sizes(max_tokens, overlap)
    tokens = docs.select(id_col, words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    n: Column = F.greatest(F.lit(1), F.ceil((F.size("w") - window) / step).cast("int") + 1)
    chunk = lambda i: F.slice("w", i * step + 1, F.lit(window))
    cols = [F.array_join("c", " ").alias("content"), F.size("c").cast("long").alias("token_count")]
    if around:
        i, last = F.col("chunk_index").cast("int"), F.col("n") - 1
        side = lambda lo, hi: F.when(lo > hi, F.lit("")).otherwise(
            F.array_join(F.transform(F.sequence(lo, F.greatest(lo, hi)), lambda j: F.array_join(chunk(j), " ")), "\n\n")
        )
        cols += [side(F.greatest(F.lit(0), i - around), i - 1).alias("context_before"), side(i + 1, F.least(last, i + around)).alias("context_after")]
    pieces = tokens.select(id_col, "w", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_index"))
    return pieces.select(
        id_col, F.col("chunk_index").cast("long").alias("chunk_index"), "w", "n",
        chunk(F.col("chunk_index")).alias("c"),
    ).select(id_col, "chunk_index", *cols)


def split_sentences(text: str) -> list[str]:
    out, at = [], 0
    for m in _BREAK.finditer(text):
        if m[1].isupper():
            out.append(text[at : m.start()])
            at = m.end()
    out.append(text[at:])
    return [s for s in (x.strip(WHITE_SPACE) for x in out) if s]


def split_paragraphs(text: str) -> list[str]:
    return [p for p in (x.strip(WHITE_SPACE) for x in text.replace("\r\n", "\n").split("\n\n")) if p]


def _windows(text: str, window: int, step: int) -> Iterator[tuple[str, int]]:
    w = _WORD.findall(text)
    for i in range(0, len(w), step):
        yield " ".join(w[i : i + window]), len(w[i : i + window])
        if i + window >= len(w):
            return


def packed(
    units: list[str], glue: str, window: int, oversize: Callable[[str], Iterator[tuple[str, int]]],
    breaks: frozenset[int] = frozenset(),
) -> Iterator[tuple[str, int]]:
    """Units joined while they fit, and before each break; units that don't fit alone go through `oversize`."""
    held: list[str] = []
    count = 0
    for i, unit in enumerate(units):
        n = len(_WORD.findall(unit))
        if held and (n > window or count + n > window or i in breaks):
            yield glue.join(held), count
            held, count = [], 0
        if n > window:
            yield from oversize(unit)
        else:
            held.append(unit)
            count += n
    if held:
        yield glue.join(held), count


def sentence_chunks(text: str, max_tokens: int, overlap: int) -> Iterator[tuple[str, int]]:
    window, step = sizes(max_tokens, overlap)
    return packed(split_sentences(text), " ", window, lambda s: _windows(s, window, step))


def paragraph_chunks(text: str, max_tokens: int, overlap: int) -> Iterator[tuple[str, int]]:
    window, _ = sizes(max_tokens, overlap)
    return packed(split_paragraphs(text), "\n\n", window, lambda p: sentence_chunks(p, max_tokens, overlap))


def breakpoints(vectors: np.ndarray, threshold: float) -> list[int]:
    """Windows that resemble the window before less than the threshold."""
    vectors = np.asarray(vectors, np.float64)
    norm = np.sqrt((vectors * vectors).sum(axis=1))
    both = norm[1:] * norm[:-1]
    cos = np.divide((vectors[1:] * vectors[:-1]).sum(axis=1), both, out=np.zeros(len(both)), where=both > 0)
    return [i + 1 for i in np.flatnonzero(np.round(cos, 9) < threshold).tolist()]


def semantic_chunks(text: str, max_tokens: int, overlap: int, embed: Embed, width: int = 3, threshold: float = 0.5) -> Iterator[tuple[str, int]]:
    """Sentences are packed, and cut where the meaning of neighbouring windows of sentences differs."""
    parts = split_sentences(text)
    if len(parts) < 2 * width:
        return sentence_chunks(text, max_tokens, overlap)
    vectors = embed([" ".join(parts[i : i + width]) for i in range(len(parts) - width + 1)])
    window, step = sizes(max_tokens, overlap)
    return packed(parts, " ", window, lambda s: _windows(s, window, step), frozenset(b + width - 1 for b in breakpoints(vectors, threshold)))


#: Chunkers by strategy: (text, max_tokens, overlap, embed) to chunks with their sizes. More may be added.
STRATEGIES: dict[str, Callable[[str, int, int, Embed], Iterator[tuple[str, int]]]] = {
    "fixed": lambda text, limit, overlap, embed: _windows(text, *sizes(limit, overlap)),
    "sentence": lambda text, limit, overlap, embed: sentence_chunks(text, limit, overlap),
    "paragraph": lambda text, limit, overlap, embed: paragraph_chunks(text, limit, overlap),
    "semantic": lambda text, limit, overlap, embed: semantic_chunks(text, limit, overlap, embed),
}


def cut(text: str, strategy: str | None, max_tokens: int | None, overlap: int | None, embed: Embed) -> Iterator[tuple[str, int]]:
    """A text's chunks by a collection's settings; an unset or unknown strategy is fixed windows."""
    chunker = STRATEGIES.get((strategy or "").strip().lower(), STRATEGIES["fixed"])
    return chunker(text, max_tokens or 0, overlap or 0, embed)


def collection_chunks(docs: DataFrame, id_col: str, text_col: str, config_col: str, embed: Embed) -> DataFrame:
    """id_col, chunk_index, content, token_count, each document by its own settings (a struct of strategy, max_tokens, overlap)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                cols = (batch[i].to_pylist() for i in range(5))
                rows = [(d, i, c, n) for d, t, *config in zip(*cols, strict=True) if t for i, (c, n) in enumerate(cut(t, *config, embed))]
                if rows:
                    types = (batch[0].type, pa.int64(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                        names=[id_col, "chunk_index", "content", "token_count"],
                    )

    kind = docs.schema[id_col].dataType.simpleString()
    settings = (F.col(f"{config_col}.strategy"), *(F.col(f"{config_col}.{c}").cast("int").alias(c) for c in ("max_tokens", "overlap")))
    return docs.select(id_col, text_col, *settings).mapInArrow(run, f"`{id_col}` {kind}, chunk_index long, content string, token_count long")


def text_chunks(docs: DataFrame, id_col: str, text_col: str, cut: Callable[[str], Iterator[tuple[str, int]]]) -> DataFrame:
    """id_col, chunk_index, content, token_count by any of the functions above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                rows = [(d, i, c, n) for d, t in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True) if t for i, (c, n) in enumerate(cut(t))]
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(cols, (batch[0].type, pa.int64(), pa.string(), pa.int64()), strict=True)],
                        names=[id_col, "chunk_index", "content", "token_count"],
                    )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, chunk_index long, content string, token_count long")


def with_neighbours(hits: DataFrame, chunks: DataFrame, doc_col: str, before: int, after: int) -> DataFrame:
    """hits (doc_col, chunk_index, ...) with the joined text of the chunks before and after, as context_before and context_after.

    hits are few: their documents, HITS at most, are looked up in the scan of the chunks. Chunks delivered more than once count once; repeats are dropped behind the join, where few rows are left."""
    ids = [r[0] for r in hits.select(doc_col).distinct().limit(HITS + 1).collect()]
    chunks = chunks.where(F.col(doc_col).isin(*ids)) if len(ids) <= HITS else chunks
    near = chunks.select(
        F.col(doc_col).alias("__d"), F.col("chunk_index").alias("__i"), F.col("content").alias("__c"),
        *(["id"] if "id" in chunks.columns else [])
    )
    keys = hits.select(F.col(doc_col).alias("__hd"), F.col("chunk_index").alias("__hi")).distinct()
    joined = keys.join(near, (F.col("__hd") == F.col("__d")) & F.col("__i").between(F.col("__hi") - before, F.col("__hi") + after))
    joined = joined.dropDuplicates(["__hd", "__hi", "id"]) if "id" in near.columns else joined
    # at most before + after rows a hit
    listed = F.array_sort(F.collect_list(F.struct("__i", "__c")))
    side = lambda keep: F.array_join(F.transform(F.filter(listed, keep), lambda x: x["__c"]), "\n\n")
    text = joined.groupBy("__hd", "__hi").agg(
        side(lambda x: x["__i"] < F.col("__hi")).alias("context_before"),
        side(lambda x: x["__i"] > F.col("__hi")).alias("context_after"),
    )
    return hits.join(text, (hits[doc_col] == text["__hd"]) & (hits["chunk_index"] == text["__hi"]), "left").drop("__hd", "__hi")
