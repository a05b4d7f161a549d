"""Splitting oversized texts at natural boundaries by structure-tree packing.

A text is parsed into a tree: sections below their headings, then paragraphs (blank lines and block
tags), lines and list items, sentences, words. A node that fits becomes one unit; only an oversized
node is descended into, and the units of its children are merged with their neighbours from the
bottom up while they fit. Units become pieces: each piece begins with the last words of the piece
before, ends where its unit ends, and the stretches that are new in each piece join to the text.

Strategy names the finest natural boundary that is used: `fixed` none (windows of words), `sentence`
sentences only, all others (`paragraph`, `semantic`, unset or unknown) the whole tree.

Sizes count words, or characters that aren't white space (`unit="characters"`), for texts that are written without
spaces; words are the finest boundaries there before characters.

Defined results: a limit that is null, zero or negative is 512; a null or negative overlap is 0, one
that reaches the limit is a quarter of it; words are runs without Unicode white space, so an unbroken
string is one word however long; null, empty, blank and fitting texts give no pieces.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.keys import WHITE_SPACE, code

DEFAULT_LIMIT = 512
#: Ranks of boundaries, coarse to fine; headings are 1 to 6. HEAD is the place behind a heading, a last resort.
PARAGRAPH, LINE, SENTENCE, HEAD, WORD, CHARACTER = 7, 8, 9, 10, 11, 12
END_KINDS = {
    **{r: "section" for r in range(1, 7)}, PARAGRAPH: "paragraph", LINE: "line", SENTENCE: "sentence", HEAD: "line",
    WORD: "word", CHARACTER: "character", 0: "end",
}

_WORD = re.compile(f"[^{re.escape(WHITE_SPACE)}]+")
_UNITS = {"words": _WORD, "characters": re.compile(f"[^{re.escape(WHITE_SPACE)}]")}
_HEADING_END = {True: re.compile(r"[\n\r]|$"), False: re.compile(r"</h[1-6]>|[\n\r]|$", re.I)}
_HEADING = re.compile(r"(?:^|(?<=[\n\r]))[ ]{0,3}(#{1,6})[ \t]|<h([1-6])\b[^<>]*>", re.I)
_BLOCK = re.compile(
    r"(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)\s*|</h[1-6]>\s*|<(?:p|div|ul|ol|dl|table|section|article|blockquote|pre|hr)\b[^<>]*>|</(?:p|div|ul|ol|dl|table|section|article|blockquote|pre)>\s*",
    re.I,
)
_LINE = re.compile(r"\r\n|\n|\r|<(?:li|tr|dt|dd)\b[^<>]*>|<br\s*/?>", re.I)
_SENTENCE = re.compile(r"(?:[.!?…][\"'”’)\]]*(?:\s+|(?=<))|[。！？．])")


def boundaries(text: str, starts: list[int], sentences_only: bool) -> dict[int, int]:
    """Word number -> rank of the coarsest boundary right before that word."""
    found: dict[int, int] = {}
    n = len(starts)

    def put(pos: int, rank: int) -> None:
        w = bisect_left(starts, pos)
        if 0 < w < n and found.get(w, WORD) > rank:
            found[w] = rank

    for m in _SENTENCE.finditer(text):
        at = m.end()
        # a lower-case letter goes on with the sentence, as after an abbreviation
        if at < len(text) and not text[at].islower():
            put(at, SENTENCE)
    if not sentences_only:
        for m in _LINE.finditer(text):
            put(m.end() if m[0][0] in "\r\n" else m.start(), LINE)
        for m in _BLOCK.finditer(text):
            put(m.start() if m[0].startswith("<") and m[0][1] != "/" else m.end(), PARAGRAPH)
        heads = list(_HEADING.finditer(text))
        for m in heads:
            put(m.start(), len(m[1]) if m[1] else int(m[2]))
        for m in heads:
            behind = bisect_left(starts, _HEADING_END[bool(m[1])].search(text, m.end()).end())
            if found.get(behind, 0) >= PARAGRAPH:
                found[behind] = HEAD
    return found


def pack(lo: int, hi: int, cuts: list[tuple[int, int]], cap: int) -> list[tuple[int, int]]:
    """Units of at most `cap` words that cover words lo to hi; cuts: (word, rank) inside, in order."""
    if hi - lo <= cap:
        return [(lo, hi)]
    if not cuts:
        return [(i, min(i + cap, hi)) for i in range(lo, hi, cap)]
    top = min(r for _, r in cuts)
    units: list[tuple[int, int]] = []
    at, inner, closed = lo, [], True
    for w, r in [*cuts, (hi, top)]:
        if r != top:
            inner.append((w, r))
            continue
        oversized = w - at > cap and top < PARAGRAPH
        for k, unit in enumerate(pack(at, w, inner, cap)):
            # neither side of an oversized section goes with its neighbours
            if units and not closed and not (oversized and k == 0) and unit[1] - units[-1][0] <= cap:
                units[-1] = (units[-1][0], unit[1])
            else:
                units.append(unit)
            closed = False
        at, inner, closed = w, [], oversized
    return units


def settings(limit: int | None, overlap: int | None) -> tuple[int, int]:
    limit = limit if limit and limit > 0 else DEFAULT_LIMIT
    overlap = max(0, overlap or 0)
    return limit, overlap if overlap < limit else limit // 4


def split_text(
    text: str | None, limit: int | None, overlap: int | None, strategy: str | None, unit: str = "words",
) -> list[tuple[int, int, int, int, int, str]]:
    """Pieces (start, fresh, end, n_words, n_overlap, end_kind): text[start:end] is the piece, text[start:fresh]
    repeats the piece before; none if the text fits."""
    limit, overlap = settings(limit, overlap)
    by_words = unit == "words"
    if not text or len(text) < (2 * limit + 1 if by_words else limit + 1):
        return []
    spans = [m.span() for m in _UNITS[unit].finditer(text)]
    n = len(spans)
    if n <= limit:
        return []
    starts = [a for a, _ in spans]
    strategy = (strategy or "").strip().lower()
    found = {} if strategy == "fixed" else boundaries(text, starts, strategy == "sentence")
    if not by_words:
        found = {bisect_left(starts, m.start()): WORD for m in _WORD.finditer(text)} | found
    # the first piece repeats nothing, so it has room for `overlap` words more than the others have for new ones
    units = pack(overlap, n, [c for c in sorted(found.items()) if c[0] > overlap], limit - overlap)
    units[0] = (0, units[0][1])
    out, before = [], 0
    for k, (lo, hi) in enumerate(units):
        first = max(before, lo - overlap) if k else 0
        kind = 0 if hi == n else found.get(hi, WORD if by_words else CHARACTER)
        out.append((starts[first] if k else 0, starts[lo] if k else 0, len(text) if hi == n else starts[hi], hi - first, lo - first, END_KINDS[kind]))
        before = first
    return out


def limit_of(max_tokens: Column) -> Column:
    return F.when(max_tokens > 0, max_tokens).otherwise(DEFAULT_LIMIT)


def split_documents(
    docs: DataFrame, collections: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    with_content: bool = True, unit: str = "words",
) -> DataFrame:
    """id, piece (from 0), n_pieces, start_char, fresh_char, end_char, n_words, n_overlap, end_kind[, content] of
    each document that has more words than its collection allows."""
    config = collections.select(
        F.col("id").alias("__cid"),
        F.col("chunk_config.max_tokens").alias("__limit"),
        F.col("chunk_config.overlap").alias("__overlap"),
        code("chunk_config.strategy").alias("__strategy"),
    ).dropDuplicates(["__cid"])
    limit = limit_of(F.col("__limit"))
    rows = (
        docs.select(F.col(id_col).alias("__id"), F.col("collection_id").alias("__c"), F.col(text_col).alias("__text"))
        .join(config, F.col("__c") == F.col("__cid"), "left")
        # n words take 2n - 1 characters at least
        .where(F.length("__text") >= (2 * limit if unit == "words" else limit) + 1)
        .select("__id", "__text", limit.cast("int").alias("__limit"), F.col("__overlap").cast("int").alias("__overlap"), "__strategy")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                cols: list[list] = [[] for _ in range(10)]
                for id_, text, lim, over, strategy in zip(*(batch[i].to_pylist() for i in range(5)), strict=True):
                    pieces = split_text(text, lim, over, strategy, unit)
                    for k, p in enumerate(pieces):
                        for c, v in zip(cols, (id_, k, len(pieces), *p, text[p[0] : p[2]] if with_content else None), strict=True):
                            c.append(v)
                if cols[0]:
                    kinds = [batch[0].type, *[pa.int32()] * 2, *[pa.int64()] * 3, *[pa.int32()] * 2, pa.string(), pa.string()]
                    arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays if with_content else arrays[:-1], names=names if with_content else names[:-1])

    names = [id_col, "piece", "n_pieces", "start_char", "fresh_char", "end_char", "n_words", "n_overlap", "end_kind", "content"]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, n_pieces int, start_char long, fresh_char long, end_char long, n_words int, n_overlap int, end_kind string"
    return rows.mapInArrow(run, schema + (", content string" if with_content else ""))
