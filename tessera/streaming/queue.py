"""The extraction queue as a stream: micro-batches are filtered, extracted, resolved and written out."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.keys import strip
from tessera.operators import entities as ent
from tessera.operators import extraction as ex
from tessera.plans.shared import Folder

Extract = Callable[[str], str]
ITEM = "id long, namespace string, source_type string, source_id string, content string, attempts int"
_FOUND = "id long, ok boolean, name string, type string, aliases array<string>, attributes map<string,string>, confidence double"
_TYPES = (pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.list_(pa.string()), pa.map_(pa.string(), pa.string()), pa.float64())


def _strings(x) -> dict[str, str]:
    """A map of strings: values that are none are written as JSON."""
    return {str(k): v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in x.items()} if isinstance(x, dict) else {}


def extracted(items: DataFrame, extract: Extract) -> DataFrame:
    """id, ok, and name, type, aliases, attributes, confidence of each entity: `extract` turns a text into a model's answer.
    A failure is a row, not an error; an item without entities is a row without a name."""

    def rows(i: int, text: str) -> list[tuple]:
        try:
            found = ex.parse_response(extract(text))
            out = []
            for x in found:
                aliases = x.get("aliases") if isinstance(x.get("aliases"), list) else []
                out.append(
                    (
                        i, True, str(x.get("name") or ""), str(x.get("type") or ""), [str(a) for a in aliases],
                        _strings(x.get("attributes")), float(x.get("confidence") or 0),
                    )
                )
            return out or [(i, True, *[None] * 5)]
        except Exception:
            return [(i, False, *[None] * 5)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [r for i, text in zip(b["id"].to_pylist(), b["content"].to_pylist(), strict=True) for r in rows(i, text)]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)],
                    names=["id", "ok", "name", "type", "aliases", "attributes", "confidence"],
                )

    return items.select("id", "content").mapInArrow(run, _FOUND)


def _items(batch: DataFrame) -> DataFrame:
    """A batch as ITEM; columns it lacks are null, attempts 0."""
    fields = [f.strip().split(" ") for f in ITEM.split(",")]
    rows = batch.select(*((F.col(n) if n in batch.columns else F.lit(None)).cast(t).alias(n) for n, t in fields))
    return rows.withColumn("attempts", F.coalesce("attempts", F.lit(0))).withColumn("namespace", F.coalesce("namespace", F.lit("")))


class Processor:
    """What becomes of each micro-batch n, in folders batch=n below `out`; a batch that is run again overwrites itself.

    entities: found, with the id of the entity they resolve to or a new one, and match (exact, alias, fuzzy or new); mentions;
    relationships between entities of one item; states of all items, those that the mode passes over included; carried:
    items that failed and may be tried again, with the time from which. They join the next batch that starts after it.
    entities() gives the entities that are known (none if it is None)."""

    def __init__(
        self, spark: SparkSession, extract: Extract, out: str, mode: str = "full",
        entities: Callable[[], DataFrame] | None = None, max_attempts: int = 5,
        now: Callable[[], datetime] | None = None, **selection
    ) -> None:
        self.spark, self.extract, self.out, self.mode, self.entities, self.max_attempts, self.selection = spark, extract, out.rstrip("/"), mode, entities, max_attempts, selection
        self.now = now or (lambda: datetime.now(UTC).replace(tzinfo=None))
        self.files = Folder(spark, self.out)

    def _write(self, name: str, n: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.out}/{name}/batch={n}")

    def _carried(self, n: int) -> DataFrame:
        if f"batch={n - 1}" not in self.files.names("carried"):
            return self.spark.createDataFrame([], ITEM + ", not_before timestamp_ntz")
        return self.spark.read.parquet(f"{self.out}/carried/batch={n - 1}")

    def __call__(self, batch: DataFrame, n: int) -> None:
        now = F.lit(self.now()).cast("timestamp_ntz")
        carried = self._carried(n)
        due = F.col("not_before") <= now
        items = _items(batch).unionByName(carried.where(due).drop("not_before"))
        takes = F.coalesce(ex.selected(F.col("content"), F.col("source_id"), self.mode, **self.selection), F.lit(False))
        taken, passed = items.where(takes), items.where(~takes)
        self._write("found", n, extracted(taken, self.extract))  # the model is asked once
        found = self.spark.read.parquet(f"{self.out}/found/batch={n}")
        self._entities(n, found.where("ok AND name IS NOT NULL"), taken)
        ok = found.groupBy("id").agg(F.min("ok").alias("ok"))
        busy = taken.withColumn("status", F.lit("processing")).withColumn("attempts", F.col("attempts") + 1).join(ok, "id")
        after = ex.completed(busy, ~F.col("ok"), max_attempts=self.max_attempts)
        states = after.select("id", "new_status", "attempts", "wait_seconds")
        self._write(
            "states", n,
            states.unionByName(
                passed.select(
                    "id", F.lit("completed").alias("new_status"), "attempts",
                    F.lit(None).cast(states.schema["wait_seconds"].dataType).alias("wait_seconds"),
                )
            ),
        )
        again = after.where("new_status = 'pending'").withColumn("not_before", now + F.make_dt_interval(secs=F.col("wait_seconds")))
        self._write("carried", n, again.select(*carried.columns).unionByName(carried.where(~due)))

    def _entities(self, n: int, found: DataFrame, items: DataFrame) -> None:
        of_item = found.join(items.select("id", "namespace", "source_type", "source_id"), "id").withColumn("name", strip("name")).where("name != ''")
        known = self.entities() if self.entities is not None else self.spark.createDataFrame(
            [], "id string, namespace string, name string, aliases array<string>, first_seen_at timestamp_ntz",
        )
        names = ent.resolved(of_item, known).select("namespace", "name", "entity_id", "match")
        own = F.concat(F.lit("ent-"), F.left(F.sha2(F.concat_ws("\x01", "namespace", F.lower("name")), 256), F.lit(32)))
        rows = of_item.join(names, ["namespace", "name"]).withColumn("entity_id", F.when(F.col("match") == "new", own).otherwise(F.col("entity_id")))
        confidence = F.greatest(F.least("confidence", F.lit(1.0)), F.lit(0.0)).alias("confidence")
        self._write(
            "entities", n,
            rows.select(
                "id", "entity_id", "namespace", "name", ex.entity_type(F.col("type")).alias("type"), "aliases",
                "attributes", confidence, "match",
            ),
        )
        seen = self.spark.read.parquet(f"{self.out}/entities/batch={n}").select("id", "entity_id").distinct().join(
            items.select("id", "namespace", "source_type", "source_id"), "id",
        )
        self._write("mentions", n, seen.select("entity_id", "namespace", "source_type", "source_id").distinct())
        self._write("relationships", n, ent.co_mentions(seen, ["namespace", "id"], "entity_id"))


def process(
    stream: DataFrame, extract: Extract, out: str, checkpoint: str, mode: str = "full", trigger: dict | None = None,
    **options
) -> StreamingQuery:
    """Run a Processor over a stream of items; the other options are the Processor's."""
    each = Processor(stream.sparkSession, extract, out, mode, **options)
    return stream.writeStream.foreachBatch(each.__call__).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "5 seconds"})).start()


def expiring(changes: DataFrame, ttl: timedelta, delay: str = "10 minutes") -> DataFrame:
    """key, value, expired: each change passes through unless a newer one has, and a key without a change for `ttl` of event
    time expires. Changes may be late by `delay`."""
    ms = int(ttl.total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            value = state.get[1]
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "value": [value], "expired": [True]})
            return
        at, value = state.get if state.exists else (-1, None)
        changed = False
        for f in frames:
            f = f.sort_values("ts", kind="stable")
            newest = int(f["ts"].iloc[-1].timestamp() * 1000)
            if newest >= at:
                at, value, changed = newest, f["value"].iloc[-1], True
        state.update((at, value))
        state.setTimeoutTimestamp(max(at + ms, state.getCurrentWatermarkMs() + 1))
        if changed:
            yield pd.DataFrame({"key": [key[0]], "value": [value], "expired": [False]})

    keyed = changes.select("key", "value", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", delay)
    return keyed.groupBy("key").applyInPandasWithState(
        step, "key string, value string, expired boolean", "at long, value string", "append", "EventTimeTimeout",
    )
