"""References to records that do not exist.

Keys are put into ranges of their 64-bit hash order, so ranges are even whatever the keys look
like. Each range is one cell of a shuffle; a range that holds far more references than the others
(one hot key is enough) is cut into salted cells, to each of which the range's few parents are
copied. Inside a cell the parents form sorted arrays, which batches of references probe by binary
search; hash ties are settled by comparing the keys themselves. Only misses leave a cell.

Defined results: null and blank keys refer to nothing and are no cases; a row delivered twice gives
one case; of repeated parents the earliest created_at counts; a null created_at on either side is
never late; empty tables of references give no rows, empty tables of parents make every key missing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.keys import code
from tessera.plans.lineage import shuffle_width

STATES = ("deleted", "missing", "late")
#: Parents of a range, on average.
PARENTS = 1 << 20
_PARENT, _GONE, _REF = 0, 1, 2
_OUT = "table_name string, record_id string, target string, key string, created_at timestamp_ntz, ref_state string"


def references(df: DataFrame, table_name: str, key: str, target, record_id: str = "id", created_at: str = "created_at") -> DataFrame:
    """The references of one table in the form find_orphans takes; target is a column."""
    return df.select(
        F.lit(table_name).alias("table_name"),
        F.col(record_id).cast("string").alias("record_id"),
        target.alias("target"),
        code(key).alias("key"),
        F.col(created_at).cast("timestamp_ntz").alias("created_at"),
    ).where(F.col("key").isNotNull() & F.col("target").isNotNull())


def parents(df: DataFrame, target: str, key: str = "id", created_at: str = "created_at") -> DataFrame:
    return df.select(F.lit(target).alias("target"), code(key).alias("key"), F.col(created_at).cast("timestamp_ntz").alias("created_at")).where(
        F.col("key").isNotNull()
    )


def tombstones(deletions: DataFrame) -> DataFrame:
    """Keys whose deletion stands: those without a restored_at."""
    return deletions.where(F.col("restored_at").isNull()).select(code("table_name").alias("target"), code("record_id").alias("key")).dropna()


class _Sorted:
    """Sorted hashes with their keys, filled in sort order and then probed."""

    def __init__(self) -> None:
        self.parts: list[pa.RecordBatch] = []
        self.h: np.ndarray | None = None

    def add(self, batch: pa.RecordBatch) -> None:
        self.parts.append(batch)

    def close(self) -> None:
        t = pa.Table.from_batches(self.parts) if self.parts else None
        # offsets of 64 bits, whatever the keys' joint length
        wide = lambda c: pa.array([], pa.large_string()) if t is None else t[c].cast(pa.large_string()).combine_chunks()
        self.h = np.zeros(0, np.int64) if t is None else t["h"].to_numpy()
        self.keys, self.targets = wide("key"), wide("target")
        self.at = None if t is None else t["created_at"].combine_chunks()
        self.parts = []

    def find(self, batch: pa.RecordBatch) -> np.ndarray:
        """The position of each reference's first equal key, -1 where there is none."""
        h = batch["h"].to_numpy()
        found = np.full(len(h), -1)
        if not len(self.h):
            return found
        at = np.searchsorted(self.h, h)
        open_ = np.arange(len(h))
        while len(open_):
            pos = at[open_]
            same = pos < len(self.h)
            same[same] = self.h[pos[same]] == h[open_[same]]
            open_, pos = open_[same], pos[same]
            if not len(open_):
                break
            take = pa.array(pos)
            asked = [batch[c].take(pa.array(open_)).cast(pa.large_string()) for c in ("key", "target")]
            equal = pc.and_(pc.equal(self.keys.take(take), asked[0]), pc.equal(self.targets.take(take), asked[1]))
            equal = equal.to_numpy(zero_copy_only=False).astype(bool)
            found[open_[equal]] = pos[equal]
            open_ = open_[~equal]
            at[open_] += 1
        return found


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    have, gone, closed = _Sorted(), _Sorted(), False
    for batch in batches:
        kind = batch["kind"].to_numpy()
        for k, into in ((_PARENT, have), (_GONE, gone)):
            lo, hi = np.searchsorted(kind, [k, k + 1])
            if hi > lo:
                into.add(batch.slice(lo, hi - lo))
        lo = np.searchsorted(kind, _REF)
        refs = batch.slice(lo)
        if not len(refs):
            continue
        if not closed:
            have.close()
            gone.close()
            closed = True
        deleted = gone.find(refs) >= 0
        at = have.find(refs)
        late = np.zeros(len(refs), bool)
        there = at >= 0
        if there.any():
            theirs = have.at.take(pa.array(at[there]))
            late[there] = pc.fill_null(pc.greater(theirs, refs["created_at"].filter(pa.array(there))), False).to_numpy(zero_copy_only=False)
        state = np.select([deleted, ~there, late], [0, 1, 2], -1)
        out = state >= 0
        if out.any():
            keep = refs.filter(pa.array(out))
            yield pa.RecordBatch.from_arrays(
                [*(keep[c] for c in ("table_name", "record_id", "target", "key", "created_at")), pa.array(STATES).take(pa.array(state[out]))],
                names=["table_name", "record_id", "target", "key", "created_at", "ref_state"],
            )


def find_orphans(refs: DataFrame, known: DataFrame, gone: DataFrame, ranges: int | None = None) -> DataFrame:
    """One row per reference without a good target: table_name, record_id, target, key, created_at, ref_state."""
    spark = refs.sparkSession
    # a range's parents are held in memory, so ranges follow from their number
    n = ranges or max(shuffle_width(spark), -(-known.count() // PARENTS))
    hashed = F.xxhash64("target", "key")
    rng = F.shiftright(F.shiftrightunsigned(F.col("h"), 40) * n, 24).cast("int")

    def shaped(df: DataFrame, kind: int) -> DataFrame:
        cols = {"table_name": "string", "record_id": "string", "created_at": "timestamp_ntz"}
        return df.select(
            F.lit(kind).alias("kind"), hashed.alias("h"), "target", "key", *((F.col(c) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in cols.items())
        ).withColumn("r", rng)

    asked = shaped(refs, _REF)
    # n rows at most: how many cells each range is cut into, so that no cell holds over twice its share
    sizes = asked.groupBy("r").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    cells = sizes.select("r", F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(n) / total / 2).cast("int")).alias("cells"))
    w = F.broadcast(cells)
    asked = asked.join(w, "r").withColumn("salt", F.pmod(F.xxhash64("record_id"), F.col("cells")).cast("int")).drop("cells")
    held = shaped(known, _PARENT).unionByName(shaped(gone, _GONE)).join(w, "r").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).drop("cells")
    placed = asked.unionByName(held).repartition(n, "r", "salt").sortWithinPartitions("kind", "h", "key", "created_at")
    misses = placed.drop("r", "salt").mapInArrow(_probe, _OUT)
    return misses.dropDuplicates(["table_name", "record_id", "ref_state"])


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts per table, kind and month of created_at ('' where it is null)."""
    month = F.coalesce(F.date_format("created_at", "yyyy-MM"), F.lit(""))
    return orphans.groupBy("table_name", "ref_state", month.alias("month")).agg(F.count("*").alias("n_refs"), F.count_distinct("key").alias("n_keys"))
