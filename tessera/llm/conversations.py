"""Rebuilding conversations from message rows.

Rows are range-partitioned and sorted by (thread, created_at, id), so a busy thread spreads over as
many partitions as its rows need. Each partition runs a finite-state automaton over its stretch of
every thread and leaves one row per stretch: the state the automaton reaches from each state it may
have started in. A thread's stretches, at most one per partition, are then composed in order.

States: before the first user or assistant row; waiting for a reply (the last such row is a user's);
answered (it is an assistant's); broken, which nothing leaves.

Defined results: rows without a thread belong to none; null and blank contents are ignored; a row
delivered twice counts once; order is created_at, then id; a conversation is dropped if it is empty,
a remaining row has no created_at or no known role, a user or assistant row is missing, it starts
with an assistant, or a user row has no reply.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.keys import code, is_blank
from tessera.plans.lineage import shuffle_width
from tessera.plans.ranking import numbered

#: Spellings of the speaker roles.
ROLES = {"user": "user", "human": "user", "assistant": "assistant", "ai": "assistant", "bot": "assistant", "system": "system", "tool": "tool"}
START, WAITING, ANSWERED, BROKEN = range(4)
USER, ASSISTANT, OTHER, UNKNOWN = range(4)
#: _NEXT[symbol][state]
_NEXT = np.array(
    [
        [WAITING, BROKEN, WAITING, BROKEN],
        [BROKEN, ANSWERED, ANSWERED, BROKEN],
        [START, WAITING, ANSWERED, BROKEN],
        [BROKEN, BROKEN, BROKEN, BROKEN],
    ],
    np.int8,
)
_STRETCH = "thread_id string, first_at timestamp_ntz, first_id string, to_start tinyint, to_waiting tinyint, to_answered tinyint"


def clean_role(col: Column | str) -> Column:
    """The role as one of ROLES' values; null for any other."""
    names = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    return F.try_element_at(names, F.coalesce(code(col), F.lit("")))


def spoken(messages: DataFrame) -> DataFrame:
    """The rows that take part, with clean roles."""
    return messages.where(F.col("thread_id").isNotNull() & ~is_blank("content")).withColumn("role", clean_role("role"))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_thread, open_row, last_id = None, None, None

    def out(rows: list) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(cols[0], pa.string()), pa.array(cols[1], pa.timestamp("us")), pa.array(cols[2], pa.string()),
                *(pa.array(c, pa.int8()) for c in cols[3:])
            ],
            names=["thread_id", "first_at", "first_id", "to_start", "to_waiting", "to_answered"],
        )

    for batch in batches:
        threads, ids, at, symbols = batch["thread_id"].to_pylist(), batch["id"].to_pylist(), batch["created_at"].cast(pa.int64()).to_pylist(), batch["symbol"].to_pylist()
        done = []
        for thread, id_, when, symbol in zip(threads, ids, at, symbols, strict=True):
            if thread != open_thread:
                if open_row is not None:
                    done.append(tuple(open_row))
                open_thread, open_row, last_id = thread, [thread, when, id_, START, WAITING, ANSWERED], None
            if id_ is not None and id_ == last_id:
                continue  # delivered twice: equal rows are neighbours in this order
            last_id = id_
            step = _NEXT[symbol]
            for k in (3, 4, 5):
                open_row[k] = int(step[open_row[k]])
        if done:
            yield out(done)
    if open_row is not None:
        yield out([tuple(open_row)])


def verdicts(messages: DataFrame, threads: DataFrame | None = None) -> DataFrame:
    """thread_id, kept: for all ids of threads and all non-null thread_ids of messages."""
    spark = messages.sparkSession
    role = F.col("role")
    symbol = F.when(F.col("created_at").isNull() | role.isNull(), UNKNOWN).when(role == "user", USER).when(role == "assistant", ASSISTANT).otherwise(OTHER)
    rows = spoken(messages).select("thread_id", "created_at", "id", symbol.cast("tinyint").alias("symbol"))
    ordered = rows.repartitionByRange(shuffle_width(spark), "thread_id", "created_at", "id").sortWithinPartitions("thread_id", "created_at", "id")
    stretches = ordered.mapInArrow(_stretches, _STRETCH)
    # at most one stretch of a thread in a partition, so the list is bounded by their number
    parts = F.array_sort(
        F.collect_list(
            F.struct(
                "first_at", "first_id",
                F.array(*(F.col(c).cast("int") for c in ("to_start", "to_waiting", "to_answered")), F.lit(BROKEN)).alias("to"),
            )
        )
    )
    ends = F.aggregate(parts, F.lit(START), lambda state, part: F.element_at(part["to"], state + 1))
    judged = stretches.groupBy("thread_id").agg((ends == ANSWERED).alias("kept"))
    everyone = messages.where(F.col("thread_id").isNotNull()).select("thread_id")
    if threads is not None:
        everyone = everyone.unionByName(threads.where(F.col("id").isNotNull()).select(F.col("id").alias("thread_id")))
    return everyone.distinct().join(judged, "thread_id", "left").select("thread_id", F.coalesce("kept", F.lit(False)).alias("kept"))


def conversations(messages: DataFrame, threads: DataFrame | None = None) -> DataFrame:
    """The turns of the kept conversations: thread_id, turn (from 1), id, role, content, created_at."""
    kept = verdicts(messages, threads).where("kept").select("thread_id")
    rows = spoken(messages).dropDuplicates(["id", "thread_id", "created_at"]).join(kept, "thread_id", "left_semi")
    turns = numbered(rows.select("thread_id", "id", "role", "content", "created_at"), ["thread_id"], ["created_at", "id"], "turn")
    return turns.select("thread_id", "turn", "id", "role", "content", "created_at")
