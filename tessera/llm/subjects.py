"""Subject areas of documents by one-versus-rest linear classifiers on hashed word n-grams.

Sentences are classified, documents are labelled by the shares of their sentences, so a passing
remark weighs as much as it takes up. Training uses bounded samples: hand-labelled documents, and
sections of other documents. A section whose heading carries a word that among the hand-labelled ones
nearly always means one subject is weakly labelled by it; any other takes the subject that the
classifiers are sure of (by GUESS), if there is one, each time before they are fitted again. Before that
each sentence of a hand-labelled document takes the likeliest of its document's subjects, or another one
where that is far likelier. Each subject's classifier is fitted in a task of its own. The share from
which a further subject counts is calibrated for each subject on a fifth of the hand-labelled sample,
which training has not seen.

Bounds: HAND hand-labelled documents (an expected number of a hash sample), WEAK others (the first by
hash), SECTION sentences of each of their sections; all are taken where there are fewer. They bound
training only: every document is classified, over its whole text.

Defined results: null, empty and blank texts and texts without a letter have no subject; every other
document has one to `most` (two if not said otherwise); without any labels no document has one; ties go
to the subject first in order; labels of unknown documents are ignored; a label given twice counts once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIMENSIONS = 1 << 18
HAND, WEAK = 4_000, 4_000
ROUNDS, STEPS = 4, 30
#: Pairs of words fill the upper half of the dimensions and count for less than words, which fill the lower.
HALF, PAIR = DIMENSIONS // 2, 0.1
#: One hand-labelled document in so many calibrates thresholds instead of training.
HELD_OUT = 5
#: Sentences of a section that training takes; it may turn to something else later. A text without headings is one section.
SECTION = 4
#: How much likelier (in log-odds) another subject must be to overrule a label; how clear a sentence must be to count.
OVERRULE, CLEAR = 1.5, 0.4
#: How much likelier a subject must be than all others for a section to be taken as its example.
GUESS = 0.6
_SENTENCE = re.compile(r"[.!?。！？](?=\s)|[\n\r]+|<[^<>]*>")
_WORD = re.compile(r"[^\W\d_]{3,}")
_HEADING = re.compile(r"[ ]{0,3}#{1,6}[ \t]+([^\n\r]*)|<h[1-6][^<>]*>([^<>]*)</h[1-6]>", re.I)
_HASHES: dict[str, int] = {}


def _hash(word: str) -> int:
    h = _HASHES.get(word)
    if h is None:
        if len(_HASHES) > 500_000:
            _HASHES.clear()
        h = _HASHES[word] = zlib.crc32(word.encode("utf-8", "ignore"))
    return h


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and pairs of words of all sentences, and the number of them in each sentence."""
    words, sizes = [], []
    for sentence in _SENTENCE.split(text.lower()):
        found = _WORD.findall(sentence)
        if found:
            words += found
            sizes.append(len(found))
    h = np.fromiter(map(_hash, words), np.uint64, len(words))
    n = np.array(sizes, np.int64)
    return _with_pairs(h, n)


def _with_pairs(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(h):
        return np.zeros(0, np.int32), n
    pair = (h * np.uint64(0x9E3779B1) + np.append(h[1:], np.uint64(0)) * np.uint64(0x85EBCA77)) >> np.uint64(7)
    idx = np.empty(2 * len(h), np.int64)
    idx[0::2], idx[1::2] = h % HALF, HALF + pair % HALF
    keep = np.ones(len(idx), bool)
    keep[2 * np.cumsum(n) - 1] = False  # the last word of a sentence has no pair
    return idx[keep].astype(np.int32), 2 * n - 1


class Model:
    """Weights by subject; `share` of each: the part of a document's sentences from which it counts beside the first."""

    def __init__(self, subjects: list[str], weights: np.ndarray, bias: np.ndarray, share: float = 0.18, least: int = 2) -> None:
        self.subjects, self.weights, self.bias, self.least = subjects, weights, bias, least
        self.share = np.full(len(subjects), share)

    def scores(self, idx: np.ndarray, n: np.ndarray) -> np.ndarray:
        at = np.cumsum(n) - n
        return np.add.reduceat(self.weights[idx], at, axis=0) / np.sqrt(n)[:, None].astype(np.float32) + self.bias

    def counts(self, z: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
        """Clear sentences by document and subject; where none is clear, the mean scores decide."""
        k = len(self.subjects)
        order = np.partition(z, k - 2, axis=1) if k > 1 else z
        clear = (order[:, -1] - order[:, -2] > CLEAR) if k > 1 else np.ones(len(z), bool)
        best = z.argmax(axis=1)
        out = np.bincount(doc[clear] * k + best[clear], minlength=n_docs * k).reshape(n_docs, k).astype(float)
        mean = np.stack([np.bincount(doc, z[:, j], n_docs) for j in range(k)], 1) / np.maximum(np.bincount(doc, minlength=n_docs), 1)[:, None]
        return out + 1e-6 / (1 + np.exp(-np.clip(mean, -30, 30)))

    def decide(self, counts: np.ndarray, share: np.ndarray | float | None = None, least: int | None = None, most: int = 2) -> np.ndarray:
        """Documents x most: subjects in order, -1 where there is none. Each document has its first."""
        order = np.argsort(-counts, axis=1, kind="stable")[:, :most]
        n = np.take_along_axis(counts, order, axis=1)
        needed = np.broadcast_to(self.share if share is None else share, counts.shape[1:])[order] * counts.sum(axis=1, keepdims=True)
        ok = (n >= (self.least if least is None else least)) & (n >= needed)
        ok[:, 0] = True
        return np.where(ok, order, -1)


def _fit(idx: np.ndarray, n: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression of one subject against the rest, by full-batch adaptive gradient steps."""
    at, row, scale = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n), 1 / np.sqrt(n)
    w, b = np.zeros(DIMENSIONS, np.float32), np.float32(-2.0)
    w2, b2 = np.full_like(w, 1e-8), 1e-8
    for _ in range(STEPS):
        used = w.copy()
        used[HALF:] *= PAIR
        z = np.add.reduceat(used[idx], at) * scale + b
        g = (1 / (1 + np.exp(-z)) - y) * weight * (1000 / len(n))
        step = np.bincount(idx, (g * scale).astype(np.float32)[row], DIMENSIONS).astype(np.float32)
        step[HALF:] *= PAIR
        step += 1e-6 * w
        w2 += step * step
        w -= 0.5 * step / np.sqrt(w2)
        total = g.sum()
        b2 += total * total
        b -= np.float32(0.3 * total / np.sqrt(b2))
    w[HALF:] *= PAIR
    return w, float(b)


def _fit_all(spark: SparkSession, idx: np.ndarray, n: np.ndarray, label: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All subjects' classifiers, a task each; the sample is sent once."""
    sample = spark.sparkContext.broadcast((idx.astype(np.int32), n, label, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in batch["id"].to_pylist():
                idx, n, label, weight = sample.value
                w, b = _fit(idx, n, (label == j).astype(float), weight)
                yield pa.RecordBatch.from_arrays([pa.array([j]), pa.array([w.tobytes()], pa.binary()), pa.array([b])], names=["id", "w", "b"])

    fitted = sorted(spark.range(0, k, 1, k).mapInArrow(run, "id long, w binary, b double").collect())
    sample.unpersist()
    return np.stack([np.frombuffer(r.w, np.float32) for r in fitted], 1), np.array([r.b for r in fitted], np.float32)


def _said(found: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((len(found), k + 1), bool)
    out[np.arange(len(found))[:, None], found] = True  # -1 is the last column
    return out[:, :k]


def _calibrate(model: Model, counts: np.ndarray, true: np.ndarray) -> None:
    """Shares by subject, on documents that training has not seen: first one for all, then each on its own if that saves two decisions."""
    k = len(model.subjects)
    exact_of = lambda share, least: float((_said(model.decide(counts, share, least), k) == true).all(axis=1).mean())
    shares = (0.1, 0.12, 0.15, 0.18, 0.2, 0.25, 0.3)
    best = exact_of(model.share, model.least) + 0.25 / np.sqrt(len(true))  # a change must be worth it
    for least in (1, 2, 3):
        for share in shares:
            exact = exact_of(share, least)
            if exact > best:
                best, model.least = exact, least
                model.share[:] = share
    for j in range(k):
        def wrong(share: float, j: int = j) -> int:
            tried = model.share.copy()
            tried[j] = share
            return int((_said(model.decide(counts, tried), k)[:, j] != true[:, j]).sum())

        now = wrong(model.share[j])
        fewest = min(shares, key=lambda x: (wrong(x), abs(x - model.share[j])))
        if wrong(fewest) <= now - 2:
            model.share[j] = fewest


def _guessed(model: Model, sections: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Sections with a subject whose mean score is GUESS above all others."""
    if not sections or len(model.subjects) < 2:
        return []
    which = np.repeat(np.arange(len(sections)), [len(n) for _, n in sections])
    z = model.scores(np.concatenate([i for i, _ in sections]), np.concatenate([n for _, n in sections]))
    mean = np.stack([np.bincount(which, z[:, j]) for j in range(z.shape[1])], 1) / np.bincount(which)[:, None]
    two = np.sort(mean, axis=1)[:, -2:]
    return [(int(mean[i].argmax()), *sections[i]) for i in np.flatnonzero(two[:, 1] - two[:, 0] >= GUESS)]


def train(
    spark: SparkSession, hand: list[tuple[tuple[str, ...], list[str], np.ndarray, np.ndarray]],
    weak: list[tuple[list[str], np.ndarray, np.ndarray]], subjects: list[str],
) -> Model:
    """hand: (subjects, heading words, indices, sizes); weak: (heading words, indices, sizes)."""
    number = {s: i for i, s in enumerate(subjects)}
    k = len(subjects)
    hand = [x for x in hand if len(x[3])]
    held = hand[::HELD_OUT] if len(hand) >= 100 else hand
    hand = [x for i, x in enumerate(hand) if i % HELD_OUT] if len(hand) >= 100 else hand
    meant: dict[str, Counter] = defaultdict(Counter)
    for labels, heads, _, _ in hand:
        for word in heads:
            meant[word].update(labels if len(labels) == 1 else ())
    sure = {w: c.most_common(1)[0][0] for w, c in meant.items() if (top := c.most_common(1)) and top[0][1] >= 2 and top[0][1] >= 0.8 * c.total()}
    weak_y, open_ = [], []
    for heads, idx, n in weak:
        said = {sure[w] for w in heads if w in sure}
        if len(said) == 1 and len(n):
            weak_y.append((number[said.pop()], idx, n))
        elif len(n):
            open_.append((idx, n))
    single = [(number[x[0][0]], x[2], x[3], 1.0) for x in hand if len(x[0]) == 1] + [(*x, 0.5) for x in weak_y]
    if not single:
        single = [(number[x[0][0]], x[2], x[3], 1.0) for x in hand]
    idx, n = np.concatenate([x[1] for x in single]), np.concatenate([x[2] for x in single])
    lengths = [len(x[2]) for x in single]
    model = Model(subjects, *_fit_all(spark, idx, n, np.repeat([x[0] for x in single], lengths), np.repeat([x[3] for x in single], lengths), k))
    for _ in range(ROUNDS):
        # sections whose heading says nothing take the subject that the classifiers are sure of
        more = weak_y + _guessed(model, open_)
        idx, n = np.concatenate([x[2] for x in hand] + [x[1] for x in more]), np.concatenate([x[3] for x in hand] + [x[2] for x in more])
        lengths = [len(x[3]) for x in hand] + [len(x[2]) for x in more]
        allowed = [[0.0 if s in x[0] else -1e9 for s in subjects] for x in hand] + [[0.0 if i == j else -1e9 for i in range(k)] for j, _, _ in more]
        allowed = np.repeat(np.array(allowed), lengths, axis=0)
        weight = np.repeat([1.0] * len(hand) + [0.5] * len(more), lengths)
        rows = np.arange(len(n))
        z = model.scores(idx, n)
        best, own = z.argmax(axis=1), (z + allowed).argmax(axis=1)
        label = np.where(z[rows, best] - z[rows, own] < OVERRULE, own, best)
        model = Model(subjects, *_fit_all(spark, idx, n, label, weight, k))
    doc = np.repeat(np.arange(len(held)), [len(x[3]) for x in held])
    z = model.scores(np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held]))
    _calibrate(model, model.counts(z, doc, len(held)), np.array([[s in x[0] for s in subjects] for x in held]))
    return model


_FEATURES = "doc_id long, section boolean, heads array<string>, idx array<int>, sizes array<int>"


def _headings(text: str) -> list[tuple[int, list[str]]]:
    return [(m.start(), _WORD.findall((m[1] or m[2] or "").lower())) for m in _HEADING.finditer(text)]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of hand-labelled documents the whole, with the words of the first heading; of the others the first sentences
    of each section, with its heading's words."""
    ints = pa.list_(pa.int32())
    for batch in batches:
        rows = []
        for i, text, hand in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "hand")), strict=True):
            heads = _headings(text)
            if hand:
                rows.append((i, False, heads[0][1] if heads else [], *features(text)))
                continue
            heads = heads or [(0, [])]
            for (at, words), (end, _) in zip(heads, [*heads[1:], (len(text), [])], strict=True):
                idx, n = features(text[at:end])
                n = n[:SECTION]
                rows.append((i, True, words, idx[: n.sum()], n))
        if rows:
            cols = list(zip(*rows, strict=True))
            types = (pa.int64(), pa.bool_(), pa.list_(pa.string()), ints, ints)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                names=["doc_id", "section", "heads", "idx", "sizes"],
            )


def _place() -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30))


def _share(ids: DataFrame, n: int) -> Column:
    """A condition that about n of the ids meet, the same at every run; all where there are fewer."""
    return _place() < int((1 << 30) * min(1.0, n / max(1, ids.count())))


def train_on(docs: DataFrame, labels: DataFrame, hand_bound: int = HAND, weak_bound: int = WEAK) -> Model | None:
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") > 0)
    given = labels.dropna(subset=["doc_id", "subject"]).select(F.col("doc_id").cast("long").alias("doc_id"), "subject")
    by_doc = given.groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("subjects"))
    chosen = {r.doc_id: tuple(r.subjects) for r in by_doc.where(_share(by_doc, hand_bound)).collect()}
    if not chosen:
        return None
    some = texts.where(_share(docs, 2 * weak_bound)).select("doc_id", _place().alias("place"))
    others = [r.doc_id for r in some.orderBy("place", "doc_id").limit(weak_bound).collect()]
    ids = spark.createDataFrame([(i, True) for i in chosen] + [(i, False) for i in others if i not in chosen], "doc_id long, hand boolean")
    # hand_bound and weak_bound rows
    found = sorted(texts.join(F.broadcast(ids.distinct()), "doc_id").mapInArrow(_extract, _FEATURES).collect(), key=lambda r: r.doc_id)
    arrays = lambda r: (np.array(r.idx, np.int64), np.array(r.sizes, np.int64))
    hand = [(chosen[r.doc_id], r.heads, *arrays(r)) for r in found if not r.section]
    if not any(len(x[3]) for x in hand):
        return None
    return train(spark, hand, [(r.heads, *arrays(r)) for r in found if r.section], sorted({s for x in hand for s in x[0]}))


def classify(docs: DataFrame, model: Model | None, most: int = 2) -> DataFrame:
    """doc_id, subject, share (of the document's clear sentences), rank (1 to `most`)."""
    spark = docs.sparkSession
    schema = "doc_id long, subject string, share double, rank int"
    if model is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(model)  # DIMENSIONS x subjects floats: a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array(m.subjects, object)
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                ids, found = [], []
                for i, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                    f = features(text)
                    if len(f[1]):
                        ids.append(i)
                        found.append(f)
                if not ids:
                    continue
                doc = np.repeat(np.arange(len(ids)), [len(f[1]) for f in found])
                counts = m.counts(m.scores(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])), doc, len(ids))
                subject = m.decide(counts, most=most)
                row, rank = np.nonzero(subject >= 0)
                subject = subject[row, rank]
                shares = counts / counts.sum(axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.array(ids, np.int64)[row]), pa.array(names[subject], pa.string()),
                        pa.array(shares[row, subject]), pa.array((rank + 1).astype(np.int32)),
                    ],
                    names=["doc_id", "subject", "share", "rank"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") > 0).mapInArrow(run, schema)
