"""The extraction queue and the cleaning of extracted entities."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.formatting import backoff_seconds, polynomial_hash
from tessera.functions.keys import strip

#: Entity types, queue states.
TYPES = ("person", "organization", "product", "location", "concept")
STATES = ("pending", "processing", "completed", "failed", "dead_letter")


def stats(queue: DataFrame) -> DataFrame:
    """One row: how many items are in each state, and how many still have to be done."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return queue.agg(
        n("pending").alias("pending"), n("processing").alias("processing"), n("failed").alias("failed"),
        n("dead_letter").alias("dead_letter"), n("pending", "processing").alias("open"),
    )


def dequeued(queue: DataFrame, n: int) -> DataFrame:
    """The n oldest pending items as they are handed out."""
    first = queue.where("status = 'pending'").orderBy("created_at", "id").limit(n)
    return first.withColumn("status", F.lit("processing")).withColumn("attempts", F.col("attempts") + 1)


def completed(queue: DataFrame, failed: Column, max_attempts: int = 3) -> DataFrame:
    """Processing items after an attempt: completed, back to pending with a delay, or dead_letter at the limit."""
    busy = F.col("status") == "processing"
    status = F.when(~busy, F.col("status")).when(~failed, "completed").when(F.col("attempts") >= max_attempts, "dead_letter").otherwise("pending")
    wait = F.when(busy & failed & (F.col("attempts") < max_attempts), backoff_seconds(F.col("attempts")))
    return queue.withColumn("new_status", status).withColumn("wait_seconds", wait)


def selected(content: Column, source_id: Column, mode: str, rate: float = 1.0, keywords: tuple[str, ...] = ()) -> Column:
    """Which items an extraction mode takes: full, off, whitelist (any keyword), sampled (hash below the rate)."""
    if mode == "off":
        return F.lit(False)
    if mode == "whitelist":
        low = F.lower(F.coalesce(content, F.lit("")))
        return F.exists(F.array(*(F.lit(k.lower()) for k in keywords)), lambda k: F.contains(low, k)) if keywords else F.lit(False)
    if mode == "sampled":
        return (polynomial_hash(source_id) % 100) / 100.0 < rate
    return F.lit(True)


def entity_type(kind: Column, unknown: str = "concept", event: str = "concept") -> Column:
    k = F.lower(strip(kind))
    return F.when(k.isin(*TYPES), k).when(k == "event", event).otherwise(unknown)


def normalized(rows: DataFrame) -> DataFrame:
    """Extracted entities with trimmed names, lower types, aliases without repeats, confidence in 0 to 1; invalid ones dropped."""
    name, kind = strip("name"), F.lower(strip("type"))
    none = F.array().cast("array<string>")
    tidy = F.filter(F.transform(F.coalesce("aliases", none), strip), lambda a: a != "")
    start = F.struct(none.alias("kept"), F.array(F.lower(name)).alias("seen"))
    step = lambda acc, x: F.when(F.array_contains(acc["seen"], F.lower(x)), acc).otherwise(
        F.struct(F.concat(acc["kept"], F.array(x)).alias("kept"), F.concat(acc["seen"], F.array(F.lower(x))).alias("seen"))
    )
    return rows.where((name != "") & kind.isin(*TYPES)).select(
        "id", "namespace", name.alias("name"), kind.alias("type"), F.aggregate(tidy, start, step, lambda acc: acc["kept"]).alias("aliases"), F.greatest(F.least("confidence", F.lit(1.0)), F.lit(0.0)).alias("confidence")
    )


def parse_response(text: str) -> list[dict]:
    """Entities of a model's answer: a JSON array or object, bare, in a code fence or amid prose; [] if there is none."""
    body = text.strip()
    if body.startswith("```"):
        body = body.split("\n", 1)[-1].rsplit("```", 1)[0]
    for left, right in ("[]", "{}"):
        at, end = body.find(left), body.rfind(right)
        if 0 <= at < end:
            try:
                got = json.loads(body[at : end + 1])
            except ValueError:
                continue
            return [x for x in (got if isinstance(got, list) else [got]) if isinstance(x, dict)]
    return []


def oldest_first(queue: DataFrame) -> DataFrame:
    """Position of each pending item; counted by day first, so no window spans the whole queue."""
    waiting = queue.where("status = 'pending'").withColumn("day", F.to_date("created_at"))
    days = waiting.groupBy("day").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("day").orderBy("created_at", "id"))
    return waiting.join(days.withColumn("before", before).drop("n"), "day").withColumn("position", F.col("before") + rank).drop("day", "before")
