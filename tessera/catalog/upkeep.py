"""Extraction queue, retention, statistics, export and streaming queries."""

from __future__ import annotations

import uuid
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog.common import NOW, once, sql_strip
from tessera.functions.formatting import backoff_seconds, byte_size, time_ago
from tessera.operators import context as ctx
from tessera.operators import entities as ent
from tessera.operators import extraction as ex
from tessera.operators import retention as ret
from tessera.plans.lineage import shared_dir
from tessera.plans.registry import Catalog
from tessera.sources import files
from tessera.sources.tables import table
from tessera.streaming import windows as win
from tessera.streaming.queue import Processor, extracted

C = Catalog()


def queue(spark: SparkSession, d: str) -> DataFrame:
    """The extraction queue as the event log stands for it."""
    e = table(spark, d, "events")
    state = F.create_map(*(F.lit(x) for p in (("signup", "pending"), ("view", "processing"), ("click", "completed"), ("error", "failed"), ("purchase", "dead_letter")) for x in p))
    return e.select(F.col("event_id").alias("id"), F.try_element_at(state, F.col("event_type")).alias("status"), (F.col("event_id") % 5).cast("int").alias("attempts"), F.concat_ws(" ", "event_type", "props").alias("content"), F.concat(F.lit("msg-"), "event_id").alias("source_id"), F.col("ts").alias("created_at"))


_Q = "q AS (SELECT event_id AS id, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'dead_letter' END AS status, CAST(event_id % 5 AS INTEGER) AS attempts, event_type || ' ' || props AS content, 'msg-' || event_id AS source_id, ts AS created_at FROM events)"


@C.query(f"WITH {_Q} SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'dead_letter') AS dead_letter, count(*) FILTER (status IN ('pending', 'processing')) AS open FROM q")
def queue_stats(spark: SparkSession, d: str) -> DataFrame:
    return ex.stats(queue(spark, d))


@C.query(f"WITH {_Q} SELECT id, 'processing' AS status, attempts + 1 AS attempts FROM q WHERE status = 'pending' ORDER BY created_at, id LIMIT 10")
def queue_dequeue_batch(spark: SparkSession, d: str) -> DataFrame:
    return ex.dequeued(queue(spark, d), 10).select("id", "status", "attempts")


@C.query(f"WITH {_Q} SELECT id, row_number() OVER (ORDER BY created_at, id) AS position FROM q WHERE status = 'pending'")
def queue_positions(spark: SparkSession, d: str) -> DataFrame:
    return ex.oldest_first(queue(spark, d)).select("id", F.col("position").cast("long").alias("position"))


@C.query(
    f"""WITH {_Q}, c AS (SELECT id, attempts, status, id % 2 = 0 AS failed FROM q)
SELECT id, CASE WHEN status <> 'processing' THEN status WHEN NOT failed THEN 'completed' WHEN attempts >= 3 THEN 'dead_letter' ELSE 'pending' END AS new_status,
CASE WHEN status = 'processing' AND failed AND attempts < 3 THEN least(pow(2.0, attempts), 300.0) ELSE 0.0 END AS wait_seconds FROM c"""
)
def queue_complete_deadletter(spark: SparkSession, d: str) -> DataFrame:
    done = ex.completed(queue(spark, d), F.col("id") % 2 == 0)
    return done.select("id", "new_status", F.coalesce("wait_seconds", F.lit(0.0)).alias("wait_seconds"))


@C.query(f"WITH {_Q} SELECT DISTINCT attempts, least(pow(2.0, attempts), 300.0) AS exponential, CAST(5.0 AS DOUBLE) AS fixed FROM (SELECT attempts * 3 AS attempts FROM q)")
def queue_backoff(spark: SparkSession, d: str) -> DataFrame:
    rows = queue(spark, d).select((F.col("attempts") * 3).alias("attempts")).distinct()
    return rows.select("attempts", backoff_seconds(F.col("attempts")).alias("exponential"), backoff_seconds(F.col("attempts"), "fixed").alias("fixed"))


@C.query("SELECT DISTINCT id FROM messages WHERE contains(lower(content), 'compiler') OR contains(lower(content), 'mutex')")
def queue_whitelist_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = once(spark, d, "messages").select("id", "content")
    return rows.where(ex.selected(F.col("content"), F.col("id"), "whitelist", keywords=("Compiler", "mutex"))).select("id")


_HASH = "list_reduce(list_prepend(CAST(0 AS HUGEINT), list_transform(string_split(source_id, ''), lambda c: CAST(ascii(c) AS HUGEINT))), lambda a, c: (a * 31 + c) % CAST('18446744073709551616' AS HUGEINT))"


@C.query(
    f"""WITH s AS (SELECT DISTINCT id, id || '/' || thread_id AS source_id FROM messages WHERE thread_id IS NOT NULL), h AS (SELECT id, {_HASH} AS h FROM s), w AS (SELECT id, CASE WHEN h >= CAST('9223372036854775808' AS HUGEINT) THEN h - CAST('18446744073709551616' AS HUGEINT) ELSE h END AS h FROM h)
SELECT id FROM w WHERE CAST(h % 100 AS DOUBLE) / 100.0 < 0.25"""
)
def queue_sampled_filter(spark: SparkSession, d: str) -> DataFrame:
    """The sampled mode is the feature: items whose hash falls below the rate."""
    rows = once(spark, d, "messages", "thread_id IS NOT NULL").select("id", F.concat_ws("/", "id", "thread_id").alias("source_id"))
    return rows.where(ex.selected(F.lit(""), F.col("source_id"), "sampled", 0.25)).select("id")


_X = "x AS (SELECT DISTINCT ON (id) * FROM extracted_entities)"


@C.query(f"WITH {_X} SELECT id, CASE WHEN lower({sql_strip('type')}) IN ('person', 'organization', 'product', 'location', 'concept') THEN lower({sql_strip('type')}) ELSE 'concept' END AS type FROM x")
def entity_type_map(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "extracted_entities").select("id", ex.entity_type(F.col("type")).alias("type"))


@C.query(
    f"""WITH {_X} SELECT id, namespace, {sql_strip('name')} AS name, lower({sql_strip('type')}) AS type, round(greatest(least(confidence, 1.0), 0.0), 6) AS confidence FROM x
WHERE {sql_strip('name')} <> '' AND lower({sql_strip('type')}) IN ('person', 'organization', 'product', 'location', 'concept')"""
)
def extraction_normalize(spark: SparkSession, d: str) -> DataFrame:
    return ex.normalized(once(spark, d, "extracted_entities")).drop("aliases").withColumn("confidence", F.round("confidence", 6))


@C.query(
    f"""WITH {_X}, t AS (SELECT id, {sql_strip('name')} AS name, list_filter(list_transform(coalesce(aliases, CAST([] AS VARCHAR[])), lambda a: {sql_strip('a')}), lambda a: a <> '') AS al FROM x
WHERE {sql_strip('name')} <> '' AND lower({sql_strip('type')}) IN ('person', 'organization', 'product', 'location', 'concept'))
SELECT id, array_to_string(list_filter(al, lambda x, i: lower(x) <> lower(name) AND list_position(list_transform(al, lambda y: lower(y)), lower(x)) = i), '|') AS aliases FROM t"""
)
def extraction_aliases(spark: SparkSession, d: str) -> DataFrame:
    return ex.normalized(once(spark, d, "extracted_entities")).select("id", F.array_join("aliases", "|").alias("aliases"))


# ---- retention -----------------------------------------------------------------------------------------------------

_AT = "TIMESTAMP '2026-07-01'"


@C.query(f"SELECT id FROM threads WHERE updated_at < {_AT} - INTERVAL 90 DAY")
def gc_old_conversations(spark: SparkSession, d: str) -> DataFrame:
    return ret.old_conversations(table(spark, d, "threads"), NOW, 90).select("id")


@C.query(f"WITH o AS (SELECT id FROM threads WHERE updated_at < {_AT} - INTERVAL 90 DAY) SELECT DISTINCT id FROM messages WHERE thread_id IS NULL OR thread_id NOT IN (SELECT id FROM o)")
def gc_message_survivors(spark: SparkSession, d: str) -> DataFrame:
    gone = ret.old_conversations(table(spark, d, "threads"), NOW, 90)
    return ret.without(once(spark, d, "messages").select("id", "thread_id"), gone, "thread_id").select("id")


@C.query(f"SELECT id FROM entities WHERE last_seen_at < {_AT} - INTERVAL 60 DAY AND mention_count < 3")
def gc_stale_entities(spark: SparkSession, d: str) -> DataFrame:
    return ret.stale_entities(table(spark, d, "entities"), NOW, 60, 3).select("id")


@C.query("SELECT DISTINCT c.id FROM chunks c WHERE document_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.id = c.document_id)")
def gc_orphan_chunks(spark: SparkSession, d: str) -> DataFrame:
    return ret.orphan_chunks(once(spark, d, "chunks").select("id", "document_id"), table(spark, d, "documents")).select("id")


@C.query(f"SELECT id FROM context_history WHERE updated_at < {_AT} - INTERVAL 180 DAY")
def gc_context_history(spark: SparkSession, d: str) -> DataFrame:
    return ret.old_history(table(spark, d, "context_history"), NOW, 180).select("id")


_CUR = "l AS (SELECT id, namespace, coalesce(run_id, '') AS run_id, key, updated_at, nullif(lower(trim(operation)), '') AS op FROM context_history QUALIFY row_number() OVER (PARTITION BY namespace, coalesce(run_id, ''), key ORDER BY updated_at DESC, version DESC, id DESC) = 1)"


@C.query(f"WITH {_CUR} SELECT namespace, run_id, key FROM l WHERE op <> 'delete' AND run_id <> '' AND updated_at < {_AT} - INTERVAL 90 DAY")
def gc_run_context(spark: SparkSession, d: str) -> DataFrame:
    return ret.old_runs(ctx.current(table(spark, d, "context_history")), NOW, 90).select("namespace", "run_id", "key")


@C.query(
    f"""WITH {_CUR} SELECT (SELECT count(*) FROM threads WHERE updated_at < {_AT} - INTERVAL 90 DAY) AS conversations, (SELECT count(*) FROM entities WHERE last_seen_at < {_AT} - INTERVAL 60 DAY AND mention_count < 3) AS entities,
(SELECT count(DISTINCT c.id) FROM chunks c WHERE document_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.id = c.document_id)) AS chunks, (SELECT count(*) FROM context_history WHERE updated_at < {_AT} - INTERVAL 180 DAY) AS history,
(SELECT count(*) FROM l WHERE op <> 'delete' AND run_id <> '' AND updated_at < {_AT} - INTERVAL 90 DAY) AS runs"""
)
def gc_counts(spark: SparkSession, d: str) -> DataFrame:
    """A dry run: what each rule would delete."""
    rules = {"conversations": gc_old_conversations, "entities": gc_stale_entities, "chunks": gc_orphan_chunks, "history": gc_context_history, "runs": gc_run_context}
    parts = [f(spark, d).agg(F.lit(name).alias("rule"), F.count("*").alias("n")) for name, f in rules.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.agg(*(F.sum(F.when(F.col("rule") == name, F.col("n"))).alias(name) for name in rules))


_T = {"threads": "threads", "documents": "documents", "entities": "entities", "collections": "collections"}
_COUNTS = " UNION ALL ".join(f"SELECT namespace, '{n}' AS t FROM {t}" for n, t in _T.items())


@C.query("SELECT namespace, " + ", ".join(f"count(*) FILTER (t = '{n}') AS n_{n}" for n in [*_T, "chunks", "messages"]) + f" FROM ({_COUNTS} UNION ALL SELECT namespace, 'chunks' FROM (SELECT DISTINCT id, namespace FROM chunks) UNION ALL SELECT namespace, 'messages' FROM (SELECT DISTINCT id, namespace FROM messages)) GROUP BY 1")
def namespace_stats(spark: SparkSession, d: str) -> DataFrame:
    tables = {n: table(spark, d, t) for n, t in _T.items()} | {n: once(spark, d, n) for n in ("chunks", "messages")}
    return ret.namespace_counts(tables)


@C.query("SELECT (SELECT count(*) FROM threads) AS threads, (SELECT count(DISTINCT id) FROM messages) AS messages, (SELECT count(*) FROM collections) AS collections, (SELECT count(*) FROM documents) AS documents, (SELECT count(DISTINCT id) FROM chunks) AS chunks, (SELECT count(*) FROM entities) AS entities")
def dashboard_stats(spark: SparkSession, d: str) -> DataFrame:
    names = ("threads", "messages", "collections", "documents", "chunks", "entities")
    parts = [table(spark, d, n).select("id").distinct().agg(F.lit(n).alias("t"), F.count("*").alias("n")) for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.agg(*(F.sum(F.when(F.col("t") == n, F.col("n"))).alias(n) for n in names))


_OWNED = ("threads", "messages", "collections", "documents", "chunks", "context_history", "entities", "entity_mentions")


@C.query(" UNION ALL ".join(f"SELECT '{t}' AS section, namespace, count(DISTINCT id) AS n FROM {t} WHERE namespace <> 'kb-harbor' AND namespace <> 'atlas-00000' GROUP BY 2" for t in _OWNED))
def namespace_delete_survivors(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each table by namespace when two namespaces, one of knowledge and one of conversations, have been deleted."""
    parts = [table(spark, d, t).where("namespace NOT IN ('kb-harbor', 'atlas-00000')").groupBy(F.lit(t).alias("section"), "namespace").agg(F.count_distinct("id").alias("n")) for t in _OWNED]
    return reduce(DataFrame.unionByName, parts)


def _exported(spark: SparkSession, d: str, namespace: str, embeddings: bool) -> dict[str, DataFrame]:
    """The eleven sections of a namespace. Vectors of messages and entities are those of `embeddings` with their number."""
    vectors = lambda key, form: table(spark, d, "embeddings").select(F.format_string(form, F.col("vec_id") + 1).alias(key), "embedding")
    made = {
        "context_history": lambda: table(spark, d, "context_history"),
        "entity_aliases": lambda: ent.alias_table(table(spark, d, "entities")),
        "entity_relationships": lambda: ent.co_mentions(_told(spark, d), ["namespace", "source_id"], "entity_id").withColumn("namespace", F.lit(namespace)),
        "message_embeddings": lambda: vectors("message_id", "msg-%010d"),
        "entity_embeddings": lambda: vectors("entity_id", "ent-%09d"),
    }
    return files.export_sections(lambda name: made[name]() if name in made else once(spark, d, name), namespace, embeddings)


def _told(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "entity_mentions").where(f"lower(trim(source_type)) = 'conversation' AND trim(source_id) <> '' AND namespace = '{_EXPORTED}'")


_EXPORTED = "atlas-00000"
_OF = f"namespace = '{_EXPORTED}'"
_EXPORT = f"""{_CUR}, mn AS (SELECT DISTINCT ON (id) * FROM entity_mentions WHERE {_OF}),
p AS (SELECT DISTINCT source_id, entity_id FROM mn WHERE lower(trim(source_type)) = 'conversation' AND trim(source_id) <> ''),
al AS (SELECT DISTINCT lower(unnest(list_concat([name], coalesce(aliases, CAST([] AS VARCHAR[]))))) AS alias FROM entities WHERE {_OF}),
x AS (SELECT 'threads' AS section, id FROM threads WHERE {_OF} UNION ALL SELECT DISTINCT 'messages', id FROM messages WHERE {_OF} UNION ALL SELECT 'collections', id FROM collections WHERE {_OF}
UNION ALL SELECT 'documents', id FROM documents WHERE {_OF} UNION ALL SELECT DISTINCT 'chunks', id FROM chunks WHERE {_OF} UNION ALL SELECT 'context', key FROM l WHERE op <> 'delete' AND {_OF}
UNION ALL SELECT 'context_history', CAST(id AS VARCHAR) FROM context_history WHERE {_OF} UNION ALL SELECT 'entities', id FROM entities WHERE {_OF} UNION ALL SELECT 'aliases', alias FROM al WHERE alias IS NOT NULL
UNION ALL SELECT 'mentions', id FROM mn UNION ALL SELECT DISTINCT 'relationships', a.entity_id || '>' || b.entity_id FROM p a JOIN p b ON a.source_id = b.source_id AND a.entity_id < b.entity_id)"""


@C.query(f"WITH {_EXPORT} SELECT section, count(*) AS n FROM x GROUP BY 1")
def export_sections(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each section of one namespace's export, those that hold any."""
    parts = [df.groupBy(F.lit(name).alias("section")).agg(F.count("*").alias("n")) for name, df in _exported(spark, d, _EXPORTED, False).items()]
    return reduce(DataFrame.unionByName, parts)


_NAMES_ROW = {"context": "key", "aliases": "alias"}


@C.query(f"WITH {_EXPORT} SELECT section, id, section IN ('messages', 'entities') AND EXISTS (SELECT 1 FROM embeddings e WHERE x.id IN (format('msg-{{:010d}}', e.vec_id + 1), format('ent-{{:09d}}', e.vec_id + 1))) AS has_vector FROM x")
def export_namespace_json(spark: SparkSession, d: str) -> DataFrame:
    """Every row of the eleven sections as a JSON object, read back: what names it, and whether a vector came with it."""
    parts = []
    for name, df in _exported(spark, d, _EXPORTED, True).items():
        df = df.drop("embedding") if name == "chunks" else df
        line = df.select(F.to_json(F.struct("*")).alias("json"))
        field = lambda c: F.get_json_object("json", f"$.{c}")
        row = F.concat(field("a"), F.lit(">"), field("b")) if name == "relationships" else field(_NAMES_ROW.get(name, "id"))
        parts.append(line.select(F.lit(name).alias("section"), row.alias("id"), field("embedding").isNotNull().alias("has_vector")))
    return reduce(DataFrame.unionByName, parts)


@C.query(
    """WITH s AS (SELECT event_id, ts, date_diff('second', ts, TIMESTAMP '2024-01-31') - CASE WHEN epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts) < date_diff('second', ts, TIMESTAMP '2024-01-31') * 1000000 THEN 1 ELSE 0 END AS n FROM events)
SELECT event_id, CASE WHEN n < 60 THEN 'just now' WHEN n < 3600 THEN CASE n // 60 WHEN 1 THEN '1 minute ago' ELSE (n // 60) || ' minutes ago' END WHEN n < 86400 THEN CASE n // 3600 WHEN 1 THEN '1 hour ago' ELSE (n // 3600) || ' hours ago' END
WHEN n < 604800 THEN CASE n // 86400 WHEN 1 THEN '1 day ago' ELSE (n // 86400) || ' days ago' END ELSE strftime(ts, '%b %-d, %Y') END AS age FROM s"""
)
def time_ago_buckets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", time_ago(F.col("ts"), datetime(2024, 1, 31)).alias("age"))


@C.query("SELECT doc_id, CASE WHEN n >= 1048576 THEN printf('%.2f MB', n / 1048576.0) WHEN n >= 1024 THEN printf('%.2f KB', n / 1024.0) ELSE n || ' bytes' END AS size FROM (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) * 700 AS n FROM documents)")
def format_bytes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", byte_size(F.octet_length(F.coalesce("text", F.lit(""))).cast("long") * 700).alias("size"))


def _odd_extractor(text: str) -> str:
    """Fails on errors, and finds an entity named after the event otherwise."""
    kind, props = text.split(" ", 1)
    if kind == "error":
        raise ValueError(text)
    return f'Here it is:\n```json\n[{{"name": "{kind}", "type": "Concept", "confidence": 0.5, "attributes": {props}}}]\n```'


@C.query(
    """WITH q AS (SELECT event_id AS id, event_type, CAST(event_id % 5 AS INTEGER) AS attempts FROM events)
SELECT id, CASE WHEN event_type IN ('click', 'error') THEN attempts + 1 ELSE attempts END AS attempts, CASE WHEN event_type <> 'error' THEN 'completed' WHEN attempts + 1 >= 5 THEN 'dead_letter' ELSE 'pending' END AS new_status,
CASE WHEN event_type = 'error' AND attempts + 1 < 5 THEN least(pow(2.0, attempts + 1), 300.0) ELSE 0.0 END AS wait_seconds, CASE WHEN event_type = 'click' THEN 'click' ELSE '' END AS entity FROM q"""
)
def queue_process_batch(spark: SparkSession, d: str) -> DataFrame:
    """One micro-batch of the queue processor over all events: a mode that takes clicks and errors, an extractor that fails on errors."""
    place = f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}/queue-{uuid.uuid4().hex}"
    run = Processor(spark, _odd_extractor, place, mode="whitelist", keywords=("CLICK", "error"), now=lambda: NOW)
    run(queue(spark, d).select("id", "source_id", "content", "attempts"), 0)
    states, found = (spark.read.parquet(f"{place}/{name}/batch=0") for name in ("states", "entities"))
    joined = states.join(found.select("id", F.col("name").alias("entity")), "id", "left")
    return joined.select("id", "attempts", "new_status", F.coalesce("wait_seconds", F.lit(0.0)).alias("wait_seconds"), F.coalesce("entity", F.lit("")).alias("entity"))


@C.query("SELECT CAST(regexp_extract(source_id, '(\\d+)$', 1) AS BIGINT) AS id, name, count(*) AS n FROM (SELECT DISTINCT ON (id) * FROM extracted_entities) WHERE name <> '' AND source_id IS NOT NULL GROUP BY 1, 2")
def extraction_parse(spark: SparkSession, d: str) -> DataFrame:
    """A model's answers, one a message with all its names in a fence, taken apart again."""
    rows = once(spark, d, "extracted_entities").where("source_id IS NOT NULL AND name != ''").select(F.regexp_extract("source_id", r"(\d+)$", 1).cast("long").alias("id"), F.struct("name", "type").alias("e"))
    fence = F.concat(F.lit("```json\n"), F.to_json(F.collect_list("e")), F.lit("\n```"))
    got = extracted(rows.groupBy("id").agg(fence.alias("content")), _as_it_is)
    return got.where("name IS NOT NULL").groupBy("id", "name").agg(F.count("*").alias("n"))


def _as_it_is(text: str) -> str:
    return text


# ---- streams -------------------------------------------------------------------------------------------------------


def _windowed(spark: SparkSession, d: str, how: str) -> DataFrame:
    events = table(spark, d, "events")
    return {"tumbling": win.tumbling, "sliding": win.sliding, "session": win.sessions}[how](events)


@C.query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling_events(spark: SparkSession, d: str) -> DataFrame:
    return _windowed(spark, d, "tumbling")


@C.query("WITH o AS (SELECT unnest([0, 15, 30, 45]) AS m) SELECT time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(m) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, o GROUP BY 1, 2")
def stream_sliding_events(spark: SparkSession, d: str) -> DataFrame:
    return _windowed(spark, d, "sliding")


@C.query(
    """WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 2 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k"""
)
def stream_session_events(spark: SparkSession, d: str) -> DataFrame:
    return _windowed(spark, d, "session")


@C.query(C.ORACLE["stream_tumbling_events"])
def stream_tumbling_run(spark: SparkSession, d: str) -> DataFrame:
    """The hourly totals again, this time by a stream that reads the table's files to their end."""
    import os

    path = f"{d}/events.parquet"
    source = path if os.path.isdir(path) else d
    events = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "*.parquet" if os.path.isdir(path) else "events.parquet").parquet(source)
    run = f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"
    query = (
        win.tumbling(events).writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{run}/checkpoint")
        .foreachBatch(lambda df, _n: df.write.mode("overwrite").parquet(f"{run}/out")).start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{run}/out").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


QUERIES, ORACLE = C.QUERIES, C.ORACLE
