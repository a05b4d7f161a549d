"""Conversation memory: appended messages, history pages, threads, summaries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(rows: DataFrame, order: str, id_col: str, limit: int, after: tuple | None = None, descending: bool = True) -> DataFrame:
    """Keyset pagination on (order, id): up to limit + 1 rows behind the cursor, the last a probe for the next page.

    The cursor holds both columns, so rows that share the order value are not skipped."""
    if after is not None:
        value, last = F.lit(after[0]), F.lit(after[1])
        beyond = F.col(order) < value if descending else F.col(order) > value
        rows = rows.where(beyond | ((F.col(order) == value) & (F.col(id_col) > last)))
    keys = (F.desc_nulls_last(order) if descending else F.asc_nulls_last(order), F.asc(id_col))
    return rows.orderBy(*keys).limit(limit + 1).withColumn("position", F.row_number().over(Window.orderBy(*keys)))


def reading_order(page: DataFrame, limit: int) -> DataFrame:
    """The rows of a page, without the probe, oldest first: position 1 is the first to read."""
    rows = page.where(F.col("position") <= limit)
    return rows.withColumn("position", F.row_number().over(Window.orderBy(F.desc("position")))).orderBy("position")


def recent(messages: DataFrame, n: int) -> DataFrame:
    """The last n messages of each thread with their recency (1 is the latest). Ranks are cut before the shuffle."""
    w = Window.partitionBy("namespace", "thread_id").orderBy(F.desc_nulls_last("created_at"), F.desc("id"))
    return messages.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= n)


def transcript(messages: DataFrame, n: int) -> DataFrame:
    """`[role]: content` of the last n messages of each thread, oldest first."""
    line = F.concat(F.lit("["), F.coalesce("role", F.lit("")), F.lit("]: "), F.coalesce("content", F.lit("")))
    parts = F.array_sort(F.collect_list(F.struct((-F.col("recency")).alias("o"), line.alias("line"))))
    return recent(messages, n).groupBy("namespace", "thread_id").agg(
        F.array_join(F.transform(parts, lambda p: p["line"]), "\n\n").alias("transcript")
    )


def summary_state(messages: DataFrame, threshold: int, keep: int) -> DataFrame:
    """Threads with their size, whether it passes the threshold, and how many rows a summary would take in or keep."""
    n = F.count("*")
    return messages.groupBy("namespace", "thread_id").agg(
        n.alias("n_messages"), (n > threshold).alias("should_summarize"), F.greatest(n - keep, F.lit(0)).alias("n_old"), F.least(n, F.lit(keep)).alias("n_kept")
    )


def mark_summarized(messages: DataFrame, before: datetime) -> DataFrame:
    return messages.withColumn(
        "summarized",
        F.coalesce("summarized", F.lit(False)) | F.coalesce(F.col("created_at") < F.lit(before).cast("timestamp_ntz"), F.lit(False)),
    )


def threads_of(messages: DataFrame) -> DataFrame:
    """Threads as the message log implies them."""
    return messages.groupBy("namespace", "thread_id").agg(
        F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"),
        F.count("*").alias("n_messages"),
    )


def upserted(threads: DataFrame, messages: DataFrame) -> DataFrame:
    """Threads after appending messages: missing ones are made, updated_at moves up."""
    log = messages.where(F.col("thread_id").isNotNull()).groupBy(F.col("thread_id").alias("id")).agg(
        F.min("namespace").alias("ns"), F.min("created_at").alias("first"), F.max("created_at").alias("last"),
    )
    both = threads.join(log, "id", "full")
    return both.select(
        "id", F.coalesce("namespace", "ns").alias("namespace"), "title",
        F.coalesce("created_at", "first").alias("created_at"), F.greatest("updated_at", "last").alias("updated_at"),
    )


def accepted(messages: DataFrame, max_length: int, role: Column) -> DataFrame:
    """What append lets in: content that isn't empty, a known role; content beyond the limit is cut and marked."""
    from tessera.functions.text import truncated

    ok = (F.length("content") > 0) & role.isin("user", "assistant", "system", "tool")
    return messages.where(F.coalesce(ok, F.lit(False))).withColumn("content", truncated(F.col("content"), max_length))
