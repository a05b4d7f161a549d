"""Conversation and context queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog.common import once
from tessera.functions.keys import code
from tessera.operators import context as ctx
from tessera.operators import conversation as conv
from tessera.plans.registry import Catalog
from tessera.sources.tables import table

C = Catalog()
_M = "m AS (SELECT DISTINCT ON (id) * FROM messages)"
HOT = "thr-000000007"


@C.query(
    f"WITH {_M} SELECT id, role, created_at, row_number() OVER (ORDER BY created_at DESC NULLS LAST, id) AS position FROM m WHERE thread_id = '{HOT}' AND created_at <= TIMESTAMP '2026-01-01' ORDER BY created_at DESC NULLS LAST, id LIMIT 21"
)
def thread_history_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of the busiest thread behind a cursor; its filters reach the scan."""
    rows = once(spark, d, "messages", f"thread_id = '{HOT}' AND created_at <= timestamp_ntz '2026-01-01'").select("id", "role", "created_at")
    got = conv.page(rows, "created_at", "id", 20, (datetime(2026, 1, 1), ""))
    return got.select("id", "role", "created_at", F.col("position").cast("long").alias("position"))


@C.query(
    f"WITH {_M}, p AS (SELECT * FROM m WHERE thread_id = '{HOT}' ORDER BY created_at DESC NULLS LAST, id LIMIT 20) SELECT id, role, content, row_number() OVER (ORDER BY created_at NULLS FIRST, id DESC) AS position FROM p"
)
def thread_reading_order(spark: SparkSession, d: str) -> DataFrame:
    """The latest page of the busiest thread, oldest first."""
    page = conv.page(once(spark, d, "messages", f"thread_id = '{HOT}'").select("id", "role", "content", "created_at"), "created_at", "id", 20)
    return conv.reading_order(page, 20).select("id", "role", "content", F.col("position").cast("long").alias("position"))


@C.query(
    f"WITH {_M}, r AS (SELECT *, row_number() OVER (PARTITION BY namespace, thread_id ORDER BY created_at DESC NULLS LAST, id DESC) AS recency FROM m WHERE thread_id IS NOT NULL) SELECT id, thread_id, recency FROM r WHERE recency <= 20"
)
def history_last_n(spark: SparkSession, d: str) -> DataFrame:
    rows = once(spark, d, "messages", "thread_id IS NOT NULL").select("id", "namespace", "thread_id", "created_at")
    return conv.recent(rows, 20).select("id", "thread_id", F.col("recency").cast("long").alias("recency"))


@C.query("SELECT id, title, updated_at, row_number() OVER (ORDER BY updated_at DESC NULLS LAST, id) AS position FROM threads WHERE namespace = 'atlas-00000' ORDER BY updated_at DESC NULLS LAST, id LIMIT 51")
def list_threads_page(spark: SparkSession, d: str) -> DataFrame:
    got = conv.page(table(spark, d, "threads").where("namespace = 'atlas-00000'").select("id", "title", "updated_at"), "updated_at", "id", 50)
    return got.withColumn("position", F.col("position").cast("long"))


@C.query("SELECT id, name, created_at, row_number() OVER (ORDER BY created_at DESC NULLS LAST, id) AS position FROM collections ORDER BY created_at DESC NULLS LAST, id LIMIT 26")
def list_collections_page(spark: SparkSession, d: str) -> DataFrame:
    got = conv.page(table(spark, d, "collections").select("id", "name", "created_at"), "created_at", "id", 25)
    return got.withColumn("position", F.col("position").cast("long"))


@C.query("SELECT id, namespace, title, created_at, updated_at FROM threads WHERE id = 'thr-000000348' AND namespace = 'birch-00001'")
def thread_by_id(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "threads").where("id = 'thr-000000348' AND namespace = 'birch-00001'")
    return rows.select("id", "namespace", "title", "created_at", "updated_at")


@C.query(f"WITH {_M} SELECT namespace, thread_id, count(*) AS n_messages, count(*) > 50 AS should_summarize, greatest(count(*) - 10, 0) AS n_old, least(count(*), 10) AS n_kept FROM m WHERE thread_id IS NOT NULL GROUP BY 1, 2")
def thread_summary_split(spark: SparkSession, d: str) -> DataFrame:
    return conv.summary_state(once(spark, d, "messages", "thread_id IS NOT NULL"), 50, 10)


@C.query(f"WITH {_M} SELECT namespace, thread_id, count(*) AS n_messages FROM m WHERE thread_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 50")
def should_summarize(spark: SparkSession, d: str) -> DataFrame:
    state = conv.summary_state(once(spark, d, "messages", "thread_id IS NOT NULL"), 50, 10)
    return state.where("should_summarize").select("namespace", "thread_id", "n_messages")


@C.query(f"WITH {_M} SELECT id, coalesce(summarized, false) OR coalesce(created_at < TIMESTAMP '2026-01-01', false) AS summarized FROM m")
def mark_summarized(spark: SparkSession, d: str) -> DataFrame:
    return conv.mark_summarized(once(spark, d, "messages").select("id", "summarized", "created_at"), datetime(2026, 1, 1)).select("id", "summarized")


@C.query(
    f"""WITH {_M}, r AS (SELECT *, row_number() OVER (PARTITION BY namespace, thread_id ORDER BY created_at DESC NULLS LAST, id DESC) AS n FROM m WHERE thread_id IS NOT NULL)
SELECT namespace, thread_id, string_agg('[' || coalesce(role, '') || ']: ' || coalesce(content, ''), chr(10) || chr(10) ORDER BY n DESC) AS transcript FROM r WHERE n <= 10 GROUP BY 1, 2"""
)
def transcript(spark: SparkSession, d: str) -> DataFrame:
    return conv.transcript(once(spark, d, "messages", "thread_id IS NOT NULL"), 10)


@C.query(
    f"""WITH {_M} SELECT id, CASE WHEN length(content) > 200 THEN left(content, 200) || chr(10) || '[truncated]' ELSE content END AS content
FROM m WHERE length(content) > 0 AND lower(trim(role)) IN ('user', 'assistant', 'system', 'tool')"""
)
def append_truncate(spark: SparkSession, d: str) -> DataFrame:
    return conv.accepted(once(spark, d, "messages").select("id", "role", "content"), 200, code("role")).select("id", "content")


@C.query(
    f"""WITH {_M}, l AS (SELECT thread_id AS id, min(namespace) AS ns, min(created_at) AS f, max(created_at) AS l FROM m WHERE thread_id IS NOT NULL GROUP BY 1)
SELECT id, coalesce(namespace, ns) AS namespace, title, coalesce(created_at, f) AS created_at, greatest(updated_at, l) AS updated_at FROM threads FULL JOIN l USING (id)"""
)
def thread_upsert(spark: SparkSession, d: str) -> DataFrame:
    return conv.upserted(table(spark, d, "threads").select("id", "namespace", "title", "created_at", "updated_at"), once(spark, d, "messages"))


@C.query(f"WITH {_M} SELECT namespace, thread_id, min(created_at) AS created_at, max(created_at) AS updated_at, count(*) AS n_messages FROM m GROUP BY 1, 2")
def threads_from_log(spark: SparkSession, d: str) -> DataFrame:
    return conv.threads_of(once(spark, d, "messages"))


@C.query(f"WITH {_M} SELECT t.id AS thread_id, count(m.id) AS n_messages FROM threads t LEFT JOIN m ON m.thread_id = t.id WHERE t.id <> '{HOT}' GROUP BY 1")
def delete_thread_survivors(spark: SparkSession, d: str) -> DataFrame:
    """What a deleted thread leaves behind: the other threads with their messages."""
    gone = F.col("thread_id") == HOT
    left = table(spark, d, "threads").select(F.col("id").alias("thread_id")).where(~gone)
    n = once(spark, d, "messages", f"thread_id != '{HOT}'").groupBy("thread_id").agg(F.count("*").alias("n"))
    return left.join(n, "thread_id", "left").select("thread_id", F.coalesce("n", F.lit(0)).alias("n_messages"))


# ---- context -------------------------------------------------------------------------------------------------------

_H = "h AS (SELECT id, namespace, coalesce(run_id, '') AS run_id, key, value, version, nullif(lower(trim(operation)), '') AS operation, updated_at, updated_by FROM context_history)"
_L = f"{_H}, l AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY namespace, run_id, key ORDER BY updated_at DESC, version DESC, id DESC) = 1)"


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "context_history")


@C.query(f"WITH {_L} SELECT namespace, run_id, key, version, operation, value, updated_at FROM l")
def context_latest(spark: SparkSession, d: str) -> DataFrame:
    return ctx.latest(_log(spark, d)).select(*ctx.KEY, "version", "operation", "value", "updated_at")


@C.query(f"WITH {_H} SELECT id, version, operation, value, row_number() OVER (ORDER BY version DESC, id) AS position FROM h WHERE namespace = 'comet-00002' AND key LIKE 'plan.%' ORDER BY version DESC, id LIMIT 21")
def context_history_page(spark: SparkSession, d: str) -> DataFrame:
    rows = ctx.history(_log(spark, d)).where((F.col("namespace") == "comet-00002") & F.col("key").startswith("plan."))
    return conv.page(rows.select("id", "version", "operation", "value"), "version", "id", 20).withColumn("position", F.col("position").cast("long"))


@C.query(f"WITH {_H} SELECT id, version, row_number() OVER w AS seq, coalesce(lag(version) OVER w, 0) AS previous_version FROM h WINDOW w AS (PARTITION BY namespace, run_id, key ORDER BY updated_at, version, id)")
def context_versions_lag(spark: SparkSession, d: str) -> DataFrame:
    return ctx.numbered(_log(spark, d)).select("id", "version", F.col("seq").cast("long").alias("seq"), F.coalesce("previous_version", F.lit(0)).alias("previous_version"))


@C.query(
    f"""WITH {_H}, n AS (SELECT *, lag(version) OVER w AS pv, lag(operation) OVER w AS po FROM h WINDOW w AS (PARTITION BY namespace, run_id, key ORDER BY updated_at, version, id)),
e AS (SELECT id, version, CASE WHEN po = 'delete' THEN 0 ELSE coalesce(pv, 0) END + 1 AS expected FROM n) SELECT * FROM e WHERE version <> expected"""
)
def context_optimistic_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return ctx.conflicts(_log(spark, d)).select("id", "version", "expected")


@C.query(f"WITH {_L} SELECT key, version, row_number() OVER (ORDER BY key, id) AS position FROM l WHERE operation <> 'delete' AND namespace = 'comet-00002' AND run_id = '' AND starts_with(key, 'a') ORDER BY key, id LIMIT 51")
def context_list_prefix_page(spark: SparkSession, d: str) -> DataFrame:
    rows = ctx.current(_log(spark, d).where("namespace = 'comet-00002'")).where((F.col("run_id") == "") & F.col("key").startswith("a"))
    return conv.page(rows.select("key", "version", "id"), "key", "id", 50, descending=False).select("key", "version", F.col("position").cast("long").alias("position"))


@C.query(
    f"WITH {_L}, t AS (SELECT *, CASE WHEN length(key) % 2 = 0 THEN updated_at + INTERVAL 30 DAY END AS ttl FROM l WHERE operation <> 'delete') SELECT namespace, run_id, key, coalesce(ttl < TIMESTAMP '2026-04-01', false) AS expired FROM t"
)
def context_ttl_split(spark: SparkSession, d: str) -> DataFrame:
    """Entries with a time to live of thirty days (keys of even length), split into kept and expired."""
    entries = ctx.current(_log(spark, d)).withColumn("ttl", F.when(F.length("key") % 2 == 0, F.expr("updated_at + INTERVAL 30 DAY")))
    return entries.select(*ctx.KEY, ctx.expired(entries, F.col("ttl"), datetime(2026, 4, 1)).alias("expired"))


@C.query(f"WITH {_L} SELECT namespace, run_id, key, version, value FROM l WHERE operation = 'delete'")
def context_delete_tombstone(spark: SparkSession, d: str) -> DataFrame:
    return ctx.latest(_log(spark, d)).where("operation = 'delete'").select(*ctx.KEY, "version", "value")


@C.query(f"WITH {_L} SELECT namespace, run_id, key, version, value FROM l WHERE operation <> 'delete' AND namespace = 'comet-00002' AND run_id = ''")
def context_get_persistent(spark: SparkSession, d: str) -> DataFrame:
    return ctx.current(_log(spark, d).where("namespace = 'comet-00002'")).where("run_id = ''").select(*ctx.KEY, "version", "value")


@C.query(f"WITH {_L} SELECT namespace, run_id, key, version FROM l WHERE operation <> 'delete' AND run_id <> 'run-0034'")
def context_cleanup_run(spark: SparkSession, d: str) -> DataFrame:
    """Entries left when a run is cleaned up."""
    return ctx.current(_log(spark, d)).where("run_id != 'run-0034'").select(*ctx.KEY, "version")


def _numbers(how: str) -> str:
    return f"WITH {_H}, x AS (SELECT *, CAST(trim(value) AS DOUBLE) AS x FROM h WHERE operation <> 'delete' AND regexp_matches(trim(value), '{ctx.NUMBER}')) SELECT namespace, run_id, key, round({how}(x), 6) AS merged, count(*) AS n_merged FROM x GROUP BY 1, 2, 3"


def _merged(spark: SparkSession, d: str, how: str) -> DataFrame:
    return ctx.merged_numbers(_log(spark, d), how).withColumn("merged", F.round("merged", 6))


@C.query(_numbers("sum"))
def context_merge_sum(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d, "sum")


@C.query(_numbers("max"))
def context_merge_max(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d, "max")


@C.query(_numbers("min"))
def context_merge_min(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d, "min")


@C.query(f"WITH {_L} SELECT namespace, run_id, key, value FROM l WHERE operation <> 'delete'")
def context_merge_replace(spark: SparkSession, d: str) -> DataFrame:
    return ctx.current(_log(spark, d)).select(*ctx.KEY, "value")


@C.query(
    f"""WITH {_H}, o AS (SELECT *, count(*) FILTER (operation = 'delete') OVER (PARTITION BY namespace, run_id, key ORDER BY updated_at DESC, version DESC, id DESC) AS later FROM h),
e AS (SELECT *, CASE WHEN starts_with(value, '[') THEN trim(value[2:-2]) WHEN value = 'null' THEN '' ELSE value END AS item FROM o WHERE later = 0)
SELECT namespace, run_id, key, CASE WHEN count(*) = 1 THEN any_value(value) ELSE '[' || coalesce(string_agg(item, ',' ORDER BY updated_at, version, id) FILTER (item <> ''), '') || ']' END AS value FROM e GROUP BY 1, 2, 3"""
)
def context_merge_append(spark: SparkSession, d: str) -> DataFrame:
    return ctx.folded(_log(spark, d), "append")


def _merged_sql(arrays: str) -> str:
    """A merge in order as a recursive query, one step a change. States and values are JSON texts; no state is null."""
    items = lambda x: f"CASE json_type({x}) WHEN 'ARRAY' THEN CAST(CAST({x} AS JSON) AS JSON[]) WHEN 'NULL' THEN CAST([] AS JSON[]) ELSE [CAST({x} AS JSON)] END"
    both = f"list_transform(list_concat({items('s')}, {items('value')}), lambda x: CAST(x AS VARCHAR))"
    kept = f"list_filter({both}, lambda x, i: list_position({both}, x) = i)" if arrays == "concat_unique" else both
    return f"""WITH RECURSIVE {_H}, o AS (SELECT namespace, run_id, key, coalesce(value, 'null') AS value, operation, row_number() OVER (PARTITION BY namespace, run_id, key ORDER BY updated_at, version, id) AS n FROM h),
f AS (SELECT DISTINCT namespace, run_id, key, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS s FROM o
  UNION ALL SELECT o.namespace, o.run_id, o.key, o.n, CASE WHEN operation = 'delete' THEN NULL WHEN s IS NULL THEN value
    WHEN json_type(s) = 'OBJECT' AND json_type(value) = 'OBJECT' THEN CAST(json_merge_patch(CAST(s AS JSON), CAST(value AS JSON)) AS VARCHAR)
    WHEN json_type(s) = 'ARRAY' OR json_type(value) = 'ARRAY' THEN '[' || array_to_string({kept}, ',') || ']' ELSE value END
  FROM f JOIN o ON o.namespace IS NOT DISTINCT FROM f.namespace AND o.run_id = f.run_id AND o.key IS NOT DISTINCT FROM f.key AND o.n = f.n + 1)
SELECT namespace, run_id, key, s AS value FROM (SELECT * FROM f QUALIFY n = max(n) OVER (PARTITION BY namespace, run_id, key)) WHERE s IS NOT NULL"""


@C.query(_merged_sql("concat_unique"))
def context_merge_concat_unique(spark: SparkSession, d: str) -> DataFrame:
    return ctx.folded(_log(spark, d), "deep_merge", "concat_unique")


@C.query(_merged_sql("concat"))
def context_deep_merge(spark: SparkSession, d: str) -> DataFrame:
    return ctx.folded(_log(spark, d), "deep_merge")


QUERIES, ORACLE = C.QUERIES, C.ORACLE
