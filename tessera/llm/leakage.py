"""Evaluation passages in training text, by template canonicalisation.

Words are runs of letters and digits, compared without case; tags and character references are
markup. In a passage, numbers, names (words that the passages write with a capital only) and units
are slots; a document's numbers, units and words that no passage holds take the same placeholders.
Four successive template words, the longest run that one change in every five words must leave, are
looked up in a hash table of the passages' windows; windows with fewer than two plain words are
looked up by their exact words instead, so nothing is lost and hits stay few.

A hit is checked around its diagonal. It repeats the passage (kind `words`) if in some 20 successive
passage words at least 16, or with drops and additions in order 15, are the document's. Else the slots
decide: it is the passage with other parameters (kind `template`) if 16 of 20 template words agree, REMAIN of
them plain words, and slots stand one to one: equal slot values of the passage against equal ones of
the document, and the other way round. `slots_agree` tells whether they do; template hits whose slots
don't agree are given too, marked false.

The passages are a stated query set: they go to the workers in blocks of ITEMS_PER_BLOCK items, and a scan
of the documents takes BLOCKS_PER_SCAN blocks, so the corpus is read and cut into words once for up to
their product, some 200 MB of broadcast blocks at 60 words a passage. Defined results: null and empty texts or passages leak nothing, nor
do passages below 20 words; repeated documents each count; repeated items count once.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN, MATCHED, ALIGNED, WINDOW, DRIFT = 20, 16, 15, 4, 4
#: Plain words that a template hit must have in common with the passage.
REMAIN = 12
ITEMS_PER_BLOCK, BLOCKS_PER_SCAN = 5_000, 20
#: Unit words.
UNITS = frozenset("percent prozent pourcent ciento days tage jours dias hours stunden heures horas km kg mb gb ms mm cm".split())
_NUM, _NAME, _UNIT, _PLAIN = 1, 2, 3, 4
_GAP = -1_000
_TOKEN = re.compile(r"[^\W_]+")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
_JOINERS = re.compile("[\\u00ad\\u200b-\\u200d\\u2060\\ufeff]")


def cleaned(text: str) -> str:
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _JOINERS.sub("", text))
    return text


def words(text: str) -> list[str]:
    return _TOKEN.findall(cleaned(text).lower())


class Passages:
    """Word numbers and template windows of one block of items."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        shown: dict[str, bool] = {}
        lists = []
        for item, passage in items:
            raw = _TOKEN.findall(cleaned(passage))
            for w in raw:
                shown[w.lower()] = shown.get(w.lower(), False) or w[0].islower()
            lists.append((item, [w.lower() for w in raw]))
        lists = [(i, w) for i, w in lists if len(w) >= SPAN]
        # word numbers from 1; 0 is a word that no passage holds
        self.number = {w: n for n, w in enumerate(sorted({w for _, ws in lists for w in ws}), 1)}
        self.lookup = _Numbers(self.number)
        self.kind = np.full(len(self.number) + 1, _PLAIN, np.int64)
        self.kind[0] = _NAME
        for w, n in self.number.items():
            self.kind[n] = _NUM if w[0].isdigit() else _UNIT if w in UNITS else _PLAIN if shown[w] else _NAME
        self.template = np.where(self.kind == _PLAIN, np.arange(len(self.kind)) + _PLAIN, self.kind)
        self.items = [i for i, _ in lists]
        self.seqs = [np.array([self.number[w] for w in ws], np.int64) for _, ws in lists]
        codes, refs = [], []
        for k, seq in enumerate(self.seqs):
            c = self.codes(seq, np.zeros(len(seq), np.int64))
            codes.append(c)
            refs.append(np.stack([np.full(len(c), k), np.arange(len(c))], 1))
        codes = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        refs = np.concatenate(refs) if refs else np.zeros((0, 2), np.int64)
        order = np.argsort(codes, kind="stable")
        self.refs, codes = refs[order], codes[order]
        self.codes_at, self.first = np.unique(codes, return_index=True)
        self.count = np.diff(np.append(self.first, len(codes)))
        #: passages one behind the other with room between them, so that neighbourhoods can be cut out
        self.pad = SPAN + DRIFT
        self.flat = np.concatenate(
            [np.concatenate([np.full(self.pad + SPAN, -2), s]) for s in self.seqs] + [np.full(self.pad + SPAN, -2)]
        ).astype(np.int32)
        at, self.start = 0, []
        for s in self.seqs:
            self.start.append(at + self.pad + SPAN)
            at += self.pad + SPAN + len(s)
        self.start = np.array(self.start, np.int64)
        #: the same as template words, 0 outside passages
        self.flat_template = np.where(self.flat > 0, self.template[np.maximum(self.flat, 0)], 0)

    def templates(self, exact: np.ndarray, unknown: np.ndarray) -> np.ndarray:
        """Template words; `unknown` holds the placeholder of words with number 0."""
        return np.where(exact > 0, self.template[exact], np.where(unknown > 0, unknown, _NAME))

    def codes(self, exact: np.ndarray, unknown: np.ndarray) -> np.ndarray:
        """Window codes."""
        n = len(exact) - WINDOW + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        tmpl = self.templates(exact, unknown)
        base = np.uint64(len(self.kind) + _PLAIN + 1)
        t, e = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        plain, known = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(WINDOW):
            t = _mix(t, tmpl[k : k + n].astype(np.uint64), base)
            e = _mix(e, exact[k : k + n].astype(np.uint64), base)
            plain += tmpl[k : k + n] > _PLAIN
            known &= exact[k : k + n] > 0
        return np.where(plain >= 2, t | np.uint64(1), np.where(known, e & ~np.uint64(1), np.uint64(0)))


class _Numbers(dict):
    """Word -> number in the passages; words that no passage holds -> minus their placeholder."""

    def __missing__(self, word: str) -> int:
        return -(_NUM if word[0].isdigit() else _UNIT if word in UNITS else _NAME)


def _mix(acc: np.ndarray, x: np.ndarray, base: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        if int(base) ** WINDOW < 1 << 62:
            return (acc // np.uint64(2) * base + x) * np.uint64(2)  # exact; the lowest bit is left for the kind
        acc = (acc ^ x) * np.uint64(0x9E3779B97F4A7C15)
        return acc ^ (acc >> np.uint64(29))


def _aligned(doc: list[int], passage: list[int], q: int, p: int) -> tuple[int, list[tuple[int, int]]]:
    """The most passage words in any SPAN of them that stand in order in the document near the hit, and the pairs."""
    lo, hi = max(0, q - SPAN), min(len(passage), q + SPAN + WINDOW)
    pairs: list[tuple[int, int]] = []
    dlo, dhi = max(0, p - (q - lo) - DRIFT), min(len(doc), p + (hi - q) + DRIFT)
    a, b = passage[lo:hi], doc[dlo:dhi]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(len(b) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if a[i] == b[j] and a[i] else max(below[j], row[j + 1])
    i = j = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j] and a[i]:
            pairs.append((lo + i, dlo + j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    top, k = 0, 0
    for n, (i, j) in enumerate(pairs):
        while i - pairs[k][0] >= SPAN or j - pairs[k][1] >= SPAN + DRIFT + 1:
            k += 1
        top = max(top, n - k + 1)
    return top, pairs


def _slots_agree(raw: list[str], known: Passages, seq: np.ndarray, p: int, q: int, first: int, last: int) -> bool:
    """Slots one to one along the hit's diagonal, from word `first` to `last` of the passage: equal values against equal ones."""
    theirs: dict[int, str] = {}
    mine: dict[str, int] = {}
    for j in range(max(0, first), min(len(seq), last)):
        i, slot = p + j - q, int(seq[j])
        if 0 <= i < len(raw) and known.kind[slot] != _PLAIN and (theirs.setdefault(slot, raw[i]) != raw[i] or mine.setdefault(raw[i], slot) != slot):
            return False
    return True


def _scan(ids: list, token_lists: list[list[str]], known: Passages) -> Iterator[tuple]:
    """(id, item, matched words, whether slots agree, whether by words); one pair may come more than once."""
    number = known.lookup
    lengths = np.array([len(w) for w in token_lists], np.int64)
    gap = known.pad + SPAN
    exact = np.full(int(lengths.sum()) + gap * (len(ids) + 1), _GAP, np.int32)
    starts = np.zeros(len(ids), np.int64)
    at = gap
    for k, ws in enumerate(token_lists):
        starts[k] = at
        exact[at : at + len(ws)] = [number[w] for w in ws]
        at += len(ws) + gap
    inside = exact != _GAP
    unknown = np.where(exact < 0, -exact, 0)
    exact = np.where(inside, np.maximum(exact, 0), -1).astype(np.int32)
    codes = known.codes(np.maximum(exact, 0), unknown)
    template = np.where(inside, known.templates(np.maximum(exact, 0), unknown), -1)
    ok = np.lib.stride_tricks.sliding_window_view(inside, WINDOW).all(axis=1) & (codes != 0)
    pos = np.flatnonzero(ok)
    if not len(pos) or not len(known.codes_at):
        return
    slot = np.minimum(np.searchsorted(known.codes_at, codes[pos]), len(known.codes_at) - 1)
    hit = known.codes_at[slot] == codes[pos]
    pos, slot = pos[hit], slot[hit]
    for lo in range(0, len(pos), 5_000):
        p, s = pos[lo : lo + 5_000], slot[lo : lo + 5_000]
        n = known.count[s]
        which = np.repeat(np.arange(len(p)), n)
        ref = known.refs[np.repeat(known.first[s], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        p, item, q = p[which], ref[:, 0], ref[:, 1]
        # upper bound: passage words around the hit that the document has within DRIFT words of the diagonal
        span = np.arange(-SPAN, SPAN + WINDOW)
        theirs = known.flat[known.start[item][:, None] + q[:, None] + span]
        same = exact[p[:, None] + span] == theirs
        straight = _most(same)
        unsure = np.flatnonzero(straight < MATCHED)
        alike = unsure
        if len(unsure):
            near = same[unsure]
            sub_p, sub_t = p[unsure], theirs[unsure]
            for d in range(1, DRIFT + 1):
                near |= exact[sub_p[:, None] + span + d] == sub_t
                near |= exact[sub_p[:, None] + span - d] == sub_t
            drifted = _most(near) >= ALIGNED
            at = known.start[item[unsure]][:, None] + q[unsure][:, None] + span
            matches = template[sub_p[:, None] + span] == known.flat_template[at]
            good = (_in_span(matches) >= MATCHED) & (_in_span(matches & (known.flat_template[at] > _PLAIN)) >= REMAIN)
            some = good.any(axis=1)
            alike, counted, good = unsure[some], _in_span(matches)[some].max(axis=1), good[some]
            opens, closes = good.argmax(axis=1), good.shape[1] - 1 - good[:, ::-1].argmax(axis=1)
            unsure = unsure[drifted]
        doc_of = np.searchsorted(starts, p, "right") - 1

        def agree(h: int, first: int, last: int) -> bool:
            k, m = int(doc_of[h]), int(item[h])
            return _slots_agree(token_lists[k], known, known.seqs[m], int(p[h] - starts[k]), int(q[h]), first, last)

        done = set()
        for h in np.flatnonzero(straight >= MATCHED).tolist():
            k, m = int(doc_of[h]), int(item[h])
            if (k, m) not in done:
                done.add((k, m))
                yield ids[k], known.items[m], int(straight[h]), agree(h, int(q[h]) - SPAN, int(q[h]) + SPAN), True
        tried: dict[tuple, int] = defaultdict(int)
        for h in unsure.tolist():
            k, m = int(doc_of[h]), int(item[h])
            cell = (k, m, int(q[h]) // WINDOW, int(p[h] - q[h]))
            if (k, m) in done or tried[cell]:
                continue
            tried[cell] = 1
            doc = exact[starts[k] : starts[k] + lengths[k]].tolist()
            top, _ = _aligned(doc, known.seqs[m].tolist(), int(q[h]), int(p[h] - starts[k]))
            if top >= ALIGNED:
                done.add((k, m))
                yield ids[k], known.items[m], top, agree(h, int(q[h]) - SPAN, int(q[h]) + SPAN), True
        for n, h in enumerate(alike.tolist()):
            k, m = int(doc_of[h]), int(item[h])
            if (k, m) not in done:
                first, last = int(q[h]) - SPAN + int(opens[n]), int(q[h]) + int(closes[n])  # all spans that agree
                yield ids[k], known.items[m], int(counted[n]), agree(h, first, last), False


def _in_span(same: np.ndarray) -> np.ndarray:
    """Trues in each SPAN successive columns, by row."""
    total = np.zeros((len(same), same.shape[1] + 1), np.int8)  # rows are shorter than 128
    np.cumsum(same, axis=1, dtype=np.int8, out=total[:, 1:])
    return total[:, SPAN:] - total[:, :-SPAN]


def _most(same: np.ndarray) -> np.ndarray:
    """The most trues in SPAN successive columns, by row."""
    return _in_span(same).max(axis=1) if len(same) else np.zeros(0, np.int64)


def leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    passage_col: str = "passage",
) -> DataFrame:
    """id_col, item_col, n_words (matched in the best 20), slots_agree, kind: one row a document and item that it leaks.

    kind `words` before `template`, agreeing slots before others, where a document holds several."""
    spark = docs.sparkSession
    items = items.select(F.col(item_col).cast("long").alias("item"), F.col(passage_col).alias("passage")).dropna().dropDuplicates(["item"])
    blocks = -(-items.count() // ITEMS_PER_BLOCK)
    rows = docs.where(F.length(text_col) >= 2 * (SPAN - DRIFT) - 1).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, `{item_col}` long, n_words int, slots_agree boolean, kind string"
    out = spark.createDataFrame([], schema)

    def block(b: int):
        some = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()
        return spark.sparkContext.broadcast(Passages([(r.item, r.passage) for r in some]))

    for first in range(0, blocks, BLOCKS_PER_SCAN):
        known = [block(b) for b in range(first, min(first + BLOCKS_PER_SCAN, blocks))]

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, len(whole), 512):
                    batch = whole.slice(at, 512)
                    ids, token_lists = batch[0].to_pylist(), [words(t) if t else [] for t in batch[1].to_pylist()]
                    found: dict[tuple, tuple] = {}
                    for passages in known:
                        for r in _scan(ids, token_lists, passages.value):
                            old = found.get(r[:2])
                            if old is None or (r[4], r[3], r[2]) > (old[4], old[3], old[2]):
                                found[r[:2]] = r
                    if found:
                        *cols, by_words = zip(*found.values(), strict=True)
                        arrays = [pa.array(c, t) for c, t in zip(cols, (batch[0].type, pa.int64(), pa.int32(), pa.bool_()), strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [*arrays, pa.array(["words" if w else "template" for w in by_words])],
                            names=[id_col, item_col, "n_words", "slots_agree", "kind"],
                        )

        found = rows.mapInArrow(run, schema)
        out = found if first == 0 else out.unionByName(found)
    return out
