"""Near-duplicate texts by multi-index hashing.

Texts of equal words form a class, and one text of each class goes on. Its distinct runs of words
are condensed into a fingerprint of 32 minima, each a symbol that two texts share with a probability
of their similarity. The fingerprint is cut into segments of four symbols; within a segment the ball
of Hamming radius one (over symbols) is enumerated by leaving out each symbol in turn, so a ball is a
band with one wild card, and texts that meet in any ball of any segment are candidates. At a similarity
of 0.6 a pair is missed with a probability of 0.006, at 0.7 of 0.0002. Candidates are verified on their
whole texts by the exact similarity of their sets of runs.

A ball that more than CROWD texts share (boilerplate) is not paired out. Its texts are compared by an
exact rule instead. Two sets with a similarity of t share a run among the first n - ceil(t n) + 1 of
either, in any common order; the order is rarest first, so what meets there are texts with their own
words in common. Runs that more than CROWD of these texts have are left out of the first list. Pairs
that need them hold so many of them that boilerplate alone may link the two, and only rows with that
many are joined on them. So the work grows with the rows, and with the number of links where boilerplate
alone makes links.

Results: links between classes, and membership of classes; copies are not expanded unless asked.
Defined results: null, empty and short texts (below `least_words`) take no part; an id delivered
twice counts once; the order of words counts through the runs only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.bitfilter import bits_of, marked
from tessera.plans.lineage import discard, shuffle_width, written

SYMBOLS, SEGMENT = 32, 4
#: Texts in a ball, or with a run, that are paired at once.
CROWD = 64
_TOKEN = re.compile(r"[^\W_]+")
_WORDS: dict[str, int] = {}
_rng = np.random.default_rng(20)
_MUL = _rng.integers(0, 1 << 32, SYMBOLS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_XOR = _rng.integers(0, 1 << 32, SYMBOLS, dtype=np.uint64).astype(np.uint32)


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def _number(word: str) -> int:
    h = _WORDS.get(word)
    if h is None:
        if len(_WORDS) > 500_000:
            _WORDS.clear()
        h = _WORDS[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "ignore"))
    return h


def runs(lists: list[list[str]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words, text by text, and where each text's runs begin. Texts have `width` words at least."""
    n = np.array([len(w) for w in lists], np.int64)
    flat = np.fromiter((_number(w) for ws in lists for w in ws), np.uint64, int(n.sum()))
    with np.errstate(over="ignore"):
        total = len(flat) - width + 1
        h = np.zeros(total, np.uint64)
        for k in range(width):
            h = (h ^ flat[k : k + total]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    ends = np.cumsum(n)
    keep = np.ones(len(flat), bool)
    for k in range(1, width):
        keep[ends - k] = False
    return h[keep[:total]], np.cumsum(n - width + 1) - (n - width + 1)


def fingerprints(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """SYMBOLS minima of each text as uint16."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), SYMBOLS), np.uint16)
    for k in range(SYMBOLS):
        low = np.minimum.reduceat((x ^ _XOR[k]) * _MUL[k], starts)
        out[:, k] = ((low * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.uint16)
    return out


def balls(fps: np.ndarray) -> np.ndarray:
    """The keys of all balls: for each segment, one for each symbol left out."""
    n, out = len(fps), []
    with np.errstate(over="ignore"):
        for s in range(SYMBOLS // SEGMENT):
            part = fps[:, s * SEGMENT : (s + 1) * SEGMENT].astype(np.uint64)
            for left_out in range(SEGMENT):
                h = np.full(n, s * SEGMENT + left_out + 1, np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
                for k in range(SEGMENT):
                    if k != left_out:
                        h = (h ^ part[:, k]) * np.uint64(0x9E3779B97F4A7C15)
                        h ^= h >> np.uint64(31)
                out.append(h)
    return np.stack(out, 1)


def _describe(width: int, least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                lists = [tokens(t) for t in batch["text"].to_pylist()]
                long = [i for i, w in enumerate(lists) if len(w) >= least_words]
                if not long:
                    continue
                lists = [lists[i] for i in long]
                fps = fingerprints(*runs(lists, width))
                sums = np.frombuffer(
                    b"".join(xxhash.xxh3_128_digest(" ".join(w).encode("utf-8", "ignore")) for w in lists), ">i8",
                ).reshape(-1, 2).astype(np.int64)
                take = pa.array(long)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["collection"].take(take), batch["id"].take(take), pa.array(sums[:, 0]),
                        pa.array(sums[:, 1]), pa.array([r.tobytes() for r in fps], pa.binary()),
                    ],
                    names=["collection", "id", "h1", "h2", "fp"],
                )

    return run


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (rid, salt, fp) to (key, rid) of all balls; salt keeps collections apart."""
    for whole in batches:
        for at in range(0, len(whole), 1024):
            batch = whole.slice(at, 1024)
            if not len(batch):
                continue
            fps = np.frombuffer(b"".join(batch["fp"].to_pylist()), np.uint16).reshape(-1, SYMBOLS)
            with np.errstate(over="ignore"):
                keys = (balls(fps) ^ batch["salt"].to_numpy().view(np.uint64)[:, None]) * np.uint64(0xD6E8FEB86659FD93)
            rid = np.repeat(batch["rid"].to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(rid)], names=["key", "rid"])


def _meet(crowd: int):
    """Rows sorted by (key, rid) to pairs (a, b); rows of crowded keys as (rid, key, crowded)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k = held_r = np.zeros(0, np.int64)
        hot = None

        def rows(a: np.ndarray, b: np.ndarray, crowded: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), crowded))], names=["a", "b", "crowded"])

        def pair(k: np.ndarray, r: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(k):
                return
            first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            size = np.diff(np.append(first, len(k)))
            many = np.repeat(size > crowd, size)
            if many.any():
                yield rows(r[many], k[many], True)
                k, r = k[~many], r[~many]
            for d in range(1, crowd):
                same = np.flatnonzero(k[d:] == k[:-d])
                if not len(same):
                    break
                a, b = r[same], r[same + d]
                apart = a != b
                yield rows(np.minimum(a, b)[apart], np.maximum(a, b)[apart], False)

        for batch in batches:
            k, r = batch["key"].to_numpy(), batch["rid"].to_numpy()
            if hot is not None:
                more = int(np.searchsorted(k, hot, "right")) if len(k) and k[0] == hot else 0
                if more:
                    yield rows(r[:more], k[:more], True)
                    k, r = k[more:], r[more:]
                if len(k):
                    hot = None
            k, r = np.concatenate([held_k, k]), np.concatenate([held_r, r])
            if not len(k):
                continue
            last = int(np.searchsorted(k, k[-1]))
            yield from pair(k[:last], r[:last])
            held_k, held_r = k[last:], r[last:]
            if len(held_k) > crowd:
                yield rows(held_r, held_k, True)
                hot, held_k, held_r = held_k[-1], held_k[:0], held_r[:0]
        yield from pair(held_k, held_r)

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                if not len(batch):
                    continue
                h, starts = runs([tokens(t) for t in batch["text"].to_pylist()], width)
                parts = [np.unique(x) for x in np.split(h, starts[1:])]
                offsets = np.zeros(len(parts) + 1, np.int32)
                np.cumsum([len(x) for x in parts], out=offsets[1:])
                flat = np.concatenate(parts).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch["rid"], batch["collection"], pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                    names=["rid", "collection", "runs"],
                )

    return run


def _rid(seed: int) -> Column:
    return F.xxhash64("collection", "h1", "h2", F.lit(seed))


def _common_runs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, similarity of the pairs' sets of runs."""
    one, other = (sets.select(F.col("rid").alias(x), F.col("runs").alias(f"r{x}")) for x in "ab")
    both = pairs.join(one, "a").join(other, "b")
    scored = both.select("a", "b", F.size(F.array_intersect("ra", "rb")).alias("c"), (F.size("ra") + F.size("rb")).alias("s"))
    return scored.select("a", "b", (F.col("c") / (F.col("s") - F.col("c"))).alias("similarity"))


class NearDuplicates:
    """Classes of equal texts and links between them.

    classes: collection, rid, rep, n, fp; members: collection, id, rid; links: a, b (rids, a < b), similarity."""

    def __init__(self, texts: DataFrame, width: int, threshold: float, least_words: int) -> None:
        self.threshold = threshold
        self.width = shuffle_width(texts.sparkSession)
        texts = texts.select("collection", "id", "text").where(F.col("id").isNotNull() & (F.length("text") >= 2 * least_words - 1))
        described = written(texts.mapInArrow(_describe(width, least_words), "collection string, id string, h1 long, h2 long, fp binary"), "described")
        self.members, self.classes = self._classes(described)

        met = self._meeting(self.classes.select("rid", F.xxhash64("collection").alias("salt"), "fp").mapInArrow(_index, "key long, rid long"))
        crowded = written(met.where("crowded").select(F.col("a").alias("rid")).distinct(), "crowded")
        pairs = written(met.where("NOT crowded").select("a", "b").distinct(), "pairs")
        discard(met)

        wanted = reduce(DataFrame.unionByName, (pairs.select(F.col("a").alias("rid")), pairs.select(F.col("b").alias("rid")), crowded)).distinct()
        wanted = written(wanted.join(self.classes.select("rid", "collection", F.col("rep").alias("id")), "rid"), "wanted")
        # a filter of bounded size keeps texts that are in no pair out of the shuffle
        key = F.xxhash64("collection", "id")
        some = marked(texts, key, bits_of(wanted, key)).where("__maybe").select("collection", "id", "text")
        sets = some.join(wanted, ["collection", "id"]).dropDuplicates(["rid"]).select("rid", "collection", "text")
        sets = written(sets.mapInArrow(_sets(width), "rid long, collection string, runs array<long>"), "sets")
        links = _common_runs(pairs, sets).where(F.col("similarity") >= threshold)
        if not crowded.isEmpty():
            more = self._crowd_pairs(sets.join(crowded, "rid", "left_semi")).join(pairs, ["a", "b"], "left_anti")
            links = links.unionByName(_common_runs(written(more, "more"), sets).where(F.col("similarity") >= threshold))
        self.links = written(links, "links")
        discard(pairs, wanted, sets, crowded)

    @staticmethod
    def _classes(described: DataFrame) -> tuple[DataFrame, DataFrame]:
        """members and classes. Classes are texts of one collection and one checksum of 128 bits. They go by a number of 64 bits,
        and should two have the same, all take another."""
        whole = ("collection", "h1", "h2")
        seed = 0
        while True:
            members = described.select("collection", "id", _rid(seed).alias("rid"), "h1", "h2", "fp")
            ends = [f(c).alias(f"{c}_{n}") for c in whole for n, f in (("lo", F.min), ("hi", F.max))]
            rows = members.groupBy("rid").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("n"), F.min("fp").alias("fp"), *ends)
            classes = written(rows, "classes")
            if classes.where(" OR ".join(f"{c}_lo != {c}_hi" for c in whole)).isEmpty():
                return members.select("collection", "id", "rid"), classes.select(F.col("collection_lo").alias("collection"), "rid", "rep", "n", "fp")
            discard(classes)
            seed += 1

    def _meeting(self, keys: DataFrame, crowd: int = CROWD) -> DataFrame:
        ordered = keys.repartition(self.width, "key").sortWithinPartitions("key", "rid")
        return written(ordered.mapInArrow(_meet(crowd), "a long, b long, crowded boolean"), "met")

    def _crowd_pairs(self, sets: DataFrame) -> DataFrame:
        """a, b: all pairs of these sets that may have the similarity. Nothing is missed."""
        t, owner = self.threshold, F.xxhash64("collection").alias("salt")
        runs = written(sets.select("rid", owner, F.explode("runs").alias("run")), "runs")
        freq = runs.groupBy("salt", "run").agg(F.count("*").alias("freq"))
        placed = runs.join(freq, ["salt", "run"])
        by_row = Window.partitionBy("rid")
        n, frequent = F.count("*").over(by_row), F.count_if(F.col("freq") > CROWD).over(by_row)
        rank = F.row_number().over(by_row.orderBy("freq", "run"))
        first = placed.select("*", n.alias("n"), frequent.alias("f"), rank.alias("r")).where(
            F.col("r") <= F.col("n") - F.ceil(F.col("n") * t - 1e-9) + 1
        )
        first = written(first.select("rid", F.xxhash64("salt", "run").alias("key"), "freq", "n", "f"), "first")
        rare = self._meeting(first.where(F.col("freq") <= CROWD).select("key", "rid"), 4 * CROWD).where("NOT crowded")
        # two texts whose common runs are all frequent have at least t / (1 + t) of their joint size of them, and so
        # each has t of its own size
        heavy = first.where((F.col("freq") > CROWD) & (F.col("f") >= F.col("n") * t - 1e-9)).select("key", "rid", "n", "f")
        x, y = heavy.alias("x"), heavy.alias("y")
        enough = F.least("x.f", "y.f") >= (F.col("x.n") + F.col("y.n")) * (t / (1 + t)) - 1e-9
        alike = x.join(y, F.expr("x.key = y.key AND x.rid < y.rid") & enough).select(F.col("x.rid").alias("a"), F.col("y.rid").alias("b"))
        return rare.select("a", "b").unionByName(alike).distinct()

    def pairs(self) -> DataFrame:
        """collection, id_a, id_b: links expanded to all texts of both classes, and the copies within each class.

        The list of pairs grows with the square of a class; groups() says the same in one row a text."""
        copied = self.classes.where("n > 1").select("rid")
        linked = self.links.select(F.col("a").alias("rid")).unionByName(self.links.select(F.col("b").alias("rid")))
        members = written(self.members.join(linked.unionByName(copied).distinct(), "rid", "left_semi").distinct(), "members")
        x = members.select("rid", F.col("id").alias("p"))
        y = members.select("collection", F.col("rid").alias("rid2"), F.col("id").alias("q"))
        between = self.links.join(x, F.col("a") == F.col("rid")).join(y, F.col("b") == F.col("rid2")).select("collection", "p", "q")
        within = x.join(y, (F.col("rid") == F.col("rid2")) & (F.col("p") < F.col("q"))).select("collection", "p", "q")
        return between.unionByName(within).select("collection", F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b"))

    def groups(self) -> DataFrame:
        """collection, id, group_id (of the smallest class in it), class_id, n_links: one row a text that has a copy or a link."""
        from tessera.llm.components import components

        nodes = components(self.links, "a", "b")
        degree = self.links.select(F.col("a").alias("rid")).unionByName(self.links.select(F.col("b").alias("rid"))).groupBy("rid").agg(F.count("*").alias("n_links"))
        info = self.classes.select("rid", "rep", "n").join(nodes.withColumnRenamed("node", "rid"), "rid", "left").join(degree, "rid", "left")
        info = info.where((F.col("n") > 1) | F.col("component").isNotNull())
        named = info.select("rid", "rep", F.coalesce("component", "rid").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
        return self.members.distinct().join(named, "rid").select("collection", "id", "group_id", F.col("rep").alias("class_id"), "n_links")
