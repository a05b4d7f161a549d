"""Versioned key-value context: the history is the truth, the current state is derived from it."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.keys import code
from tessera.plans import ranking
from tessera.plans.lineage import shuffle_width

KEY = ("namespace", "run_id", "key")
ORDER = ("updated_at", "version", "id")
NUMBER = r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"


def history(log: DataFrame) -> DataFrame:
    """The log with run_id '' for the persistent scope and clean operations."""
    return log.withColumn("run_id", F.coalesce("run_id", F.lit(""))).withColumn("operation", code("operation"))


def latest(log: DataFrame) -> DataFrame:
    """The newest change of each key. max_by combines map-side, so a busy key is no bottleneck."""
    newest = F.max(F.struct(*ORDER, "operation", "value", "updated_by"))
    return history(log).groupBy(*KEY).agg(newest.alias("n")).select(*KEY, "n.*")


def current(log: DataFrame) -> DataFrame:
    return latest(log).where(F.col("operation") != "delete")


def numbered(log: DataFrame) -> DataFrame:
    """The log with seq (1, 2, ... in order of application) and the version and operation before. A busy key spreads over partitions."""
    return ranking.numbered(history(log), list(KEY), list(ORDER), "seq", ("version", "operation"))


def conflicts(log: DataFrame) -> DataFrame:
    """Changes that don't follow the version before: an optimistic writer would have been turned away."""
    before = F.when(F.col("previous_operation") == "delete", 0).otherwise(F.coalesce("previous_version", F.lit(0)))
    return numbered(log).withColumn("expected", before + 1).where(F.col("version") != F.col("expected"))


def expired(entries: DataFrame, ttl: Column, now: datetime) -> Column:
    return F.coalesce(ttl < F.lit(now).cast("timestamp_ntz"), F.lit(False))


def number(value: Column) -> Column:
    """A JSON number as double; null for anything else."""
    return F.when(F.trim(value).rlike(NUMBER), F.trim(value).cast("double"))


def merged_numbers(log: DataFrame, how: str) -> DataFrame:
    """sum, max or min of the numeric values of each key."""
    fold = {"sum": F.sum, "max": F.max, "min": F.min}[how]
    rows = history(log).where(F.col("operation") != "delete").withColumn("x", number(F.col("value"))).where(F.col("x").isNotNull())
    return rows.groupBy(*KEY).agg(fold("x").alias("merged"), F.count("*").alias("n_merged"))


# ---- general JSON merging ------------------------------------------------------------------------------------------


class InvalidMerge(ValueError):
    """max, min or sum of something that is no number."""


def _list(x) -> list:
    return [] if x is None else x if isinstance(x, list) else [x]


def _distinct(items: list) -> list:
    seen: dict[str, object] = {}
    for x in items:
        seen.setdefault(json.dumps(x, sort_keys=True), x)
    return list(seen.values())


def merge_values(existing, incoming, strategy: str = "deep_merge", arrays: str = "concat"):
    """One merge step. Numbers compare as floats; a tie keeps what is there. arrays: replace, concat_unique, or concat, which any other name is."""
    if strategy == "replace":
        return incoming
    if strategy == "append":
        return _list(existing) + _list(incoming)
    if strategy in ("max", "min", "sum"):
        if any(isinstance(x, bool) or not isinstance(x, int | float) for x in (existing, incoming)):
            raise InvalidMerge(strategy)
        if strategy == "sum":
            return float(existing) + float(incoming)
        better = incoming > existing if strategy == "max" else incoming < existing
        return incoming if better else existing
    if isinstance(existing, dict) and isinstance(incoming, dict):
        return existing | {k: merge_values(existing[k], v, "deep_merge", arrays) if k in existing else v for k, v in incoming.items()}
    if isinstance(existing, list) or isinstance(incoming, list):
        if arrays == "replace":
            return incoming
        both = _list(existing) + _list(incoming)
        return _distinct(both) if arrays == "concat_unique" else both
    return incoming


def folded(log: DataFrame, strategy: str, arrays: str = "concat") -> DataFrame:
    """KEY, value: all changes of each key merged in order; a delete starts anew, an invalid merge keeps what is there.

    Rows stream past in key order and one value is held at a time, however many changes a key has. Merging isn't
    associative (a scalar replaces a scalar but joins a list), so a key's changes can't be merged in parts."""
    keys = list(KEY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, value, there, out = None, None, False, []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=[*keys, "value"])

        for b in batches:
            for *key, op, text in zip(*(b[c].to_pylist() for c in [*keys, "operation", "value"]), strict=True):
                if key != at:
                    if there:
                        out.append((*at, json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)))
                    at, there, value = key, False, None
                if op == "delete":
                    there, value = False, None
                    continue
                try:
                    new = json.loads(text) if text is not None else None
                    value, there = (merge_values(value, new, strategy, arrays) if there else new), True
                except ValueError:
                    pass
            if out:
                yield batch()
                out = []
        if there:
            out.append((*at, json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)))
            yield batch()

    rows = history(log).select(*KEY, *ORDER, "operation", "value")
    ordered = rows.repartition(shuffle_width(log.sparkSession), *KEY).sortWithinPartitions(*KEY, *ORDER)
    return ordered.mapInArrow(run, "namespace string, run_id string, key string, value string")
