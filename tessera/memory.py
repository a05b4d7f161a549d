"""The memory service's calls over a Store. Analytics go through the operators; this is a thin layer for one call at a time.

A call that depends on what it has read commits against the version it has read, and starts anew if another writer
was faster (TRIES times, then it is a VersionConflict)."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import chunking as ch
from tessera.operators import context as ctx
from tessera.operators import conversation as conv
from tessera.operators import entities as ent
from tessera.operators import retention as ret
from tessera.operators.extraction import TYPES
from tessera.operators.hybrid import hybrid_search
from tessera.operators.vectors import with_metadata
from tessera.sources.embedding import Embed, embedded, hash_embedder
from tessera.sources.files import SECTIONS, export_json
from tessera.store import AlreadyExists, NotFound, Store, VersionConflict

ROLES = ("user", "assistant", "system", "tool")
TRIES = 5
#: Messages of a thread beyond which reading its history summarises it, and those that stay as they are.
SUMMARIZE_BEYOND, KEEP = 50, 10
#: Rows that go with a row of a table when it is deleted: (table, column that names it).
DEPENDENTS = {
    "threads": (("messages", "thread_id"),),
    "messages": (("message_embeddings", "message_id"),),
    "collections": (("documents", "collection_id"), ("chunks", "collection_id")),
    "documents": (("chunks", "document_id"),),
    "entities": (
        ("entity_aliases", "entity_id"), ("entity_mentions", "entity_id"), ("entity_embeddings", "entity_id"),
        ("entity_relationships", "source_entity_id"), ("entity_relationships", "target_entity_id"),
    ),
}


class StaleEntry(VersionConflict):
    """The entry isn't at the version the caller expects; trying again would not help."""


def _now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


class Memory:
    def __init__(
        self, store: Store, namespace: str, embed: Embed | None = None, dim: int = 64, max_content: int = 100_000,
        allowed: str | None = None, summarize: Callable[[str], str] | None = None,
    ) -> None:
        if allowed is not None and namespace != allowed:
            raise PermissionError(namespace)
        self.store, self.namespace, self.dim, self.max_content, self.summarizer = store, namespace, dim, max_content, summarize
        self.spark, self.embed = store.spark, embed or hash_embedder(dim)

    def _rows(self, name: str, rows: list[dict]) -> DataFrame:
        from tessera.sources.schemas import SCHEMAS

        schema = self.spark.createDataFrame([], SCHEMAS[name]).schema
        return self.spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)

    def _mine(self, name: str) -> DataFrame:
        return self.store.read(name).where(F.col("namespace") == self.namespace)

    def _vector(self, text: str) -> list[float]:
        return np.asarray(self.embed([text]), np.float64)[0].tolist()

    def _change(self, name: str, change: Callable[[DataFrame], DataFrame]) -> None:
        """Replace a table by what `change` makes of it."""
        for left in reversed(range(TRIES)):
            version = self.store.version(name)
            try:
                self.store.replace(name, change(self.store.read(name, version)), version)
                return
            except VersionConflict:
                if not left:
                    raise

    def _one(self, name: str, key: str) -> dict:
        found = self._mine(name).where(F.col("id") == key).first()
        if found is None:
            raise NotFound(key)
        return found.asDict(recursive=True)

    def _delete(self, name: str, gone: DataFrame) -> None:
        """Rows of a table by id, and all that hangs on them. `gone` goes on reading the versions from before."""
        gone = gone.select("id").distinct()
        for child, column in DEPENDENTS.get(name, ()):
            if child in DEPENDENTS:
                rows = self.store.read(child)
                self._delete(child, rows.join(gone.select(F.col("id").alias(column)), column, "left_semi"))
            else:
                self._change(child, lambda rows, column=column: ret.without(rows, gone, column))
        self._change(name, lambda rows: ret.without(rows, gone, "id"))

    # -- conversations ------------------------------------------------------------------------------------------------

    def conversation_append(self, thread_id: str, role: str, content: str, metadata: dict | None = None, at: datetime | None = None) -> str:
        if not content or role not in ROLES:
            raise ValueError("content is empty or the role is unknown")
        at, key = at or _now(), f"msg-{uuid.uuid4().hex}"
        row = {
            "id": key, "namespace": self.namespace, "thread_id": thread_id, "role": role, "content": content,
            "metadata": metadata, "summarized": False, "created_at": at,
        }
        row_df = conv.accepted(self._rows("messages", [row]), self.max_content, F.col("role"))
        self.store.append("messages", row_df)
        self.store.append(
            "message_embeddings",
            row_df.select(F.col("id").alias("message_id"), F.lit(self._vector(content)).cast("array<float>").alias("embedding")),
        )
        if self.store.read("threads").where(F.col("id") == thread_id).isEmpty():
            self.store.append("threads", self._rows("threads", [{"id": thread_id, "namespace": self.namespace, "created_at": at, "updated_at": at}]))
        return key

    def embeddings_upsert(self, name: str, rows: DataFrame) -> None:
        """Vectors of messages (message_id, embedding) or entities (entity_id, embedding) in place of those there are."""
        self.store.upsert(name, rows, {"message_embeddings": "message_id", "entity_embeddings": "entity_id"}[name])

    def thread(self, thread_id: str) -> dict:
        return self._one("threads", thread_id)

    def threads(self, limit: int = 50, after: tuple | None = None) -> DataFrame:
        log = conv.threads_of(self._mine("messages")).select(F.col("thread_id").alias("id"), F.col("updated_at").alias("last"))
        rows = self._mine("threads").join(log, "id", "left").withColumn("updated_at", F.greatest("updated_at", "last")).drop("last")
        return conv.page(rows, "updated_at", "id", limit, after)

    def conversation_history(self, thread_id: str, limit: int = 20, after: tuple | None = None, reading_order: bool = False) -> DataFrame:
        """A page, newest first or in reading order. With a summariser, a thread that has grown long is summarised first."""
        mine = self._mine("messages").where(F.col("thread_id") == thread_id)
        if self.summarizer is not None and after is None and mine.where("NOT coalesce(summarized, false)").count() > SUMMARIZE_BEYOND:
            self.conversation_summarize(thread_id, self.summarizer, KEEP)
        page = conv.page(self._mine("messages").where(F.col("thread_id") == thread_id), "created_at", "id", limit, after)
        return conv.reading_order(page, limit) if reading_order else page

    def conversation_search(self, query: str, k: int = 10, mode: str = "hybrid", thread_id: str | None = None, min_score: float = 0.0) -> DataFrame:
        rows = self._mine("messages").join(self.store.read("message_embeddings").withColumnRenamed("message_id", "id"), "id")
        where = F.col("thread_id") == thread_id if thread_id else None
        rows = rows if where is None else rows.where(where)
        hits = hybrid_search(rows, "id", F.col("content"), query, self._vector(query), k, mode=mode, min_score=min_score)
        return hits.join(rows.select("id", "thread_id", "role", "content"), "id").orderBy("rank")

    def conversation_summarize(self, thread_id: str, summarize, keep: int = 10, block: int = 10_000) -> str | None:
        """`summarize` gets the transcript of all messages that aren't summarized yet but the last `keep`, oldest first,
        behind the summary so far. A longer transcript is handed over in blocks of `block` messages, each behind the summary of those before."""
        everything, threads = self.store.read("messages"), self.store.read("threads")
        mine = (F.col("namespace") == self.namespace) & (F.col("thread_id") == thread_id)
        here = (F.col("namespace") == self.namespace) & (F.col("id") == thread_id)
        at = F.coalesce("created_at", F.lit(datetime(1, 1, 1))).alias("at")
        place = F.struct(at, "id")
        kept = everything.where(mine).select(place.alias("p")).orderBy(F.desc("p")).limit(keep).agg(F.min("p")).first()[0]
        new = mine & ~F.coalesce("summarized", F.lit(False))
        if kept is not None:
            new &= place < F.struct(F.lit(kept.at).alias("at"), F.lit(kept.id).alias("id"))
        old = everything.where(new)
        found = threads.where(here).select("summary").first()
        summary, last = found.summary if found else None, None
        while True:
            rest = old if last is None else old.where(place > F.struct(F.lit(last.at).alias("at"), F.lit(last.id).alias("id")))
            rows = rest.select(at, "id", "role", "content").orderBy("at", "id").limit(block).collect()
            if not rows:
                break
            lines = [f"[system]: [Previous summary]: {summary}"] if summary else []
            summary = summarize("\n\n".join([*lines, *(f"[{r.role or ''}]: {r.content or ''}" for r in rows)]))
            last = rows[-1]
        if last is None:
            return None
        # only rows up to the last that was read: messages may have been appended since
        read = new & (place <= F.struct(F.lit(last.at).alias("at"), F.lit(last.id).alias("id")))
        self._change("messages", lambda rows: rows.withColumn("summarized", F.when(read, True).otherwise(F.col("summarized"))))
        self._change("threads", lambda rows: rows.withColumn("summary", F.when(here, F.lit(summary)).otherwise(F.col("summary"))))
        return summary

    def conversation_clear(self, thread_id: str) -> None:
        self._one("threads", thread_id)
        self._delete("threads", self._mine("threads").where(F.col("id") == thread_id))

    def conversation_update(
        self, thread_id: str, title: str | None = None, summary: str | None = None,
        metadata: dict[str, str] | None = None,
    ) -> None:
        """Set what is given; keys of `metadata` are added to those there are."""
        self._one("threads", thread_id)
        mine = (F.col("namespace") == self.namespace) & (F.col("id") == thread_id)

        def change(rows: DataFrame) -> DataFrame:
            for c, v in (("title", title), ("summary", summary), ("updated_at", _now())):
                if v is not None:
                    rows = rows.withColumn(c, F.when(mine, F.lit(v).cast(rows.schema[c].dataType)).otherwise(F.col(c)))
            if metadata:
                new = F.create_map(*(F.lit(x) for pair in metadata.items() for x in pair))
                rows = rows.withColumn("metadata", F.when(mine, ent.merged_attributes(F.col("metadata"), new)).otherwise(F.col("metadata")))
            return rows

        self._change("threads", change)

    # -- knowledge ----------------------------------------------------------------------------------------------------

    def knowledge_collection(self, name: str, strategy: str = "sentence", max_tokens: int = 512, overlap: int = 50) -> str:
        if not self._mine("collections").where(F.col("name") == name).isEmpty():
            raise AlreadyExists(name)
        key = f"col-{uuid.uuid4().hex}"
        config = {"strategy": strategy, "max_tokens": max_tokens, "overlap": overlap, "separator": None}
        self.store.append(
            "collections",
            self._rows("collections", [{"id": key, "namespace": self.namespace, "name": name, "chunk_config": config, "created_at": _now()}]),
        )
        return key

    def knowledge_collections(self, limit: int = 50, after: tuple | None = None) -> DataFrame:
        return conv.page(self._mine("collections"), "created_at", "id", limit, after)

    def collection(self, key: str) -> dict:
        return self._one("collections", key)

    def document(self, key: str) -> dict:
        return self._one("documents", key)

    def knowledge_collection_delete(self, key: str) -> None:
        """The collection with its documents and chunks."""
        self._one("collections", key)
        self._delete("collections", self._mine("collections").where(F.col("id") == key))

    def knowledge_document_delete(self, key: str) -> None:
        self._one("documents", key)
        self._delete("documents", self._mine("documents").where(F.col("id") == key))

    def knowledge_ingest(self, collection_id: str, content: str, title: str | None = None, **kw) -> DataFrame:
        return self.knowledge_bulk_ingest(collection_id, [{"title": title, "content": content, **kw}])

    def knowledge_bulk_ingest(self, collection_id: str, docs: list[dict], extract: bool = False) -> DataFrame:
        """One row a document: document_id, succeeded, n_chunks. Empty documents fail. `extract` puts the chunks into the extraction queue."""
        at = _now()
        config = self.collection(collection_id)["chunk_config"] or {}
        fixed = {"namespace": self.namespace, "collection_id": collection_id, "content_type": "text", "created_at": at, "updated_at": at}
        rows = [{"id": f"doc-{uuid.uuid4().hex}"} | fixed | {k: v for k, v in d.items() if v is not None} for d in docs]
        frame = self._rows("documents", rows)
        self.store.append("documents", frame.where(F.length("content") > 0))
        settings = F.struct(*(F.lit(config.get(c)).cast(t).alias(c) for c, t in (("strategy", "string"), ("max_tokens", "int"), ("overlap", "int"))))
        chunks = ch.collection_chunks(
            frame.withColumn("config", settings), "id", "content", "config", self.embed,
        ).withColumnRenamed("id", "document_id")
        parents = frame.select(F.col("id").alias("document_id"), "namespace", "collection_id", "metadata", "created_at")
        named = F.concat_ws("-", F.lit("chk"), F.substring("document_id", 5, 32), "chunk_index")
        made = embedded(chunks, "content", self.embed, self.dim).join(parents, "document_id").withColumn("id", named)
        self.store.append("chunks", made)
        mine = self.store.read("chunks").where(F.col("document_id").isin([r["id"] for r in rows]))
        if extract:
            ids = F.pmod(F.xxhash64("id"), F.lit(1 << 62))
            queued = mine.select(
                ids.alias("id"), "namespace", F.lit("knowledge").alias("source_type"), F.col("id").alias("source_id"),
                "content", F.lit("pending").alias("status"), F.lit(0).alias("attempts"), "created_at",
            )
            self.store.append("extraction_queue", queued)
        n = mine.groupBy("document_id").agg(F.count("*").alias("n"))
        both = frame.select(F.col("id").alias("document_id")).join(n, "document_id", "left")
        return both.select("document_id", F.col("n").isNotNull().alias("succeeded"), F.coalesce("n", F.lit(0)).alias("n_chunks"))

    def knowledge_search(
        self, query: str, k: int = 10, mode: str = "hybrid", collection_id: str | None = None,
        filters: dict | None = None, window: int = 1, min_score: float = 0.0,
    ) -> DataFrame:
        all_chunks = self._mine("chunks")
        rows = all_chunks if collection_id is None else all_chunks.where(F.col("collection_id") == collection_id)
        rows = with_metadata(rows, filters or {})
        hits = hybrid_search(rows, "id", F.col("content"), query, self._vector(query), k, mode=mode, min_score=min_score)
        hits = hits.join(rows.select("id", "document_id", "chunk_index", "content"), "id")
        titles = self._mine("documents").select(F.col("id").alias("document_id"), "title", "source")
        return ch.with_neighbours(hits.join(titles, "document_id", "left"), all_chunks, "document_id", window, window).orderBy("rank")

    # -- context ------------------------------------------------------------------------------------------------------

    def _entry(self, key: str, run_id: str | None):
        return ctx.current(self._mine("context_history")).where((F.col("key") == key) & (F.col("run_id") == (run_id or ""))).first()

    def context_get(self, key: str, run_id: str | None = None):
        entry = self._entry(key, run_id)
        if entry is None:
            raise NotFound(key)
        return json.loads(entry.value)

    def _write(self, key: str, run_id: str | None, step: Callable, by: str | None, ttl: datetime | None = None) -> int:
        """Log what `step` makes of the current entry: (value, version, operation). Another writer in between means another look."""
        for left in reversed(range(TRIES)):
            at = self.store.version("context_history")
            log = self.store.read("context_history", at)
            entry = ctx.current(log.where(F.col("namespace") == self.namespace)).where((F.col("key") == key) & (F.col("run_id") == (run_id or ""))).first()
            value, version, operation = step(entry)
            row = {
                "id": at + 1, "namespace": self.namespace, "run_id": run_id or "", "key": key, "value": json.dumps(value), "version": version,
                "operation": operation, "updated_at": _now(), "updated_by": by, "ttl_expires_at": ttl,
            }
            try:
                # every write is a commit, so the commit's number orders the log
                self.store.append("context_history", self._rows("context_history", [row]), at)
                return version
            except VersionConflict:
                if not left:
                    raise

    @staticmethod
    def _follows(key: str, entry, expected: int | None) -> int:
        version = entry.version if entry else 0
        if expected is not None and expected != version:
            raise StaleEntry(f"{key}: expected {expected}, found {version}")
        return version

    def context_set(
        self, key: str, value, run_id: str | None = None, expected_version: int | None = None, by: str | None = None,
        ttl: datetime | None = None,
    ) -> int:
        def step(entry):
            return value, self._follows(key, entry, expected_version) + 1, "set"

        return self._write(key, run_id, step, by, ttl)

    def context_merge(
        self, key: str, value, strategy: str = "deep_merge", arrays: str = "concat", run_id: str | None = None,
        by: str | None = None, expected_version: int | None = None,
    ) -> int:
        def step(entry):
            version = self._follows(key, entry, expected_version) + 1
            return ctx.merge_values(json.loads(entry.value), value, strategy, arrays) if entry else value, version, "merge"

        return self._write(key, run_id, step, by)

    def context_delete(self, key: str, run_id: str | None = None, by: str | None = None) -> None:
        def step(entry):
            if entry is None:
                raise NotFound(key)
            return json.loads(entry.value), entry.version + 1, "delete"

        self._write(key, run_id, step, by)

    def context_list(self, prefix: str = "", run_id: str | None = None, limit: int = 50, after: tuple | None = None) -> DataFrame:
        rows = ctx.current(self._mine("context_history")).where((F.col("run_id") == (run_id or "")) & F.col("key").startswith(prefix))
        return conv.page(rows, "key", "id", limit, after, descending=False)

    def context_history(self, key: str, run_id: str | None = None, limit: int = 20, after: tuple | None = None) -> DataFrame:
        rows = ctx.history(self._mine("context_history")).where((F.col("key") == key) & (F.col("run_id") == (run_id or "")))
        return conv.page(rows, "version", "id", limit, after)

    def context_cleanup(self, now: datetime | None = None, run_id: str | None = None) -> int:
        """Drop the keys whose newest entry has expired, or all of a run; how many there were."""
        log = ctx.history(self.store.read("context_history"))
        newest = log.groupBy(*ctx.KEY).agg(F.max_by("ttl_expires_at", F.struct(*ctx.ORDER)).alias("ttl"))
        gone = newest.where(F.col("run_id") == run_id) if run_id else newest.where(ctx.expired(newest, F.col("ttl"), now or _now()))
        gone = gone.where(F.col("namespace") == self.namespace).select(*ctx.KEY)
        n = gone.count()
        if n:
            self._change("context_history", lambda rows: ctx.history(rows).join(gone, list(ctx.KEY), "left_anti"))
        return n

    # -- upkeep -------------------------------------------------------------------------------------------------------

    def gc(
        self, now: datetime | None = None, conversation_days: int = 0, entity_days: int = 0, least_mentions: int = 1,
        history_days: int = 0, run_days: int = 0, dry_run: bool = False,
    ) -> dict[str, int]:
        """The six retention rules; a rule of no days is off, and expired entries always go. A dry run counts and deletes nothing.

        history: changes that a later one has replaced; runs: entries of runs; expired: entries whose time has passed."""
        now = now or _now()
        log = ctx.history(self._mine("context_history"))
        newest = log.groupBy(*ctx.KEY).agg(F.max_by("ttl_expires_at", F.struct(*ctx.ORDER)).alias("ttl"), F.max("id").alias("newest"))
        expired = newest.where(ctx.expired(newest, F.col("ttl"), now)).select(*ctx.KEY)
        runs = ret.old_runs(ctx.current(self._mine("context_history")), now, run_days).select(*ctx.KEY)
        old = ret.old_history(log, now, history_days).join(newest.select(F.col("newest").alias("id")), "id", "left_anti")
        rows = {
            "threads": ret.old_conversations(self._mine("threads"), now, conversation_days),
            "entities": ret.stale_entities(self._mine("entities"), now, entity_days, least_mentions),
            "chunks": ret.orphan_chunks(self._mine("chunks"), self._mine("documents")),
        }
        counts = {name: df.select("id").distinct().count() for name, df in rows.items()} | {
            "history": old.count(), "runs": runs.count(), "expired": expired.count(),
        }
        if dry_run:
            return counts
        for name, df in rows.items():
            if counts[name]:
                self._delete(name, df)
        if counts["history"]:
            self._change("context_history", lambda rows: ret.without(rows, old, "id"))
        if counts["runs"] or counts["expired"]:
            gone = runs.unionByName(expired).distinct()
            self._change("context_history", lambda rows: ctx.history(rows).join(gone, list(ctx.KEY), "left_anti"))
        return counts

    def namespace_stats(self) -> dict[str, int]:
        return {t: self._mine(t).count() for t in ("threads", "messages", "collections", "documents", "chunks", "entities")}

    def namespace_delete(self) -> None:
        """Everything of the namespace, vectors and queue included."""
        for name in ("threads", "collections", "entities"):
            self._delete(name, self._mine(name))
        self._delete("messages", self._mine("messages"))
        for name in ("documents", "chunks", "context_history", "entity_aliases", "entity_mentions", "entity_relationships", "extraction_queue"):
            self._change(name, lambda rows: rows.where(F.col("namespace") != self.namespace))

    def export(self, path: str, embeddings: bool = False, sections: tuple[str, ...] = SECTIONS) -> dict[str, str]:
        """The chosen sections of the namespace as folders of JSON lines, with vectors joined to their rows if asked."""
        return export_json(self.sections(embeddings, sections), path)

    def sections(self, embeddings: bool = False, sections: tuple[str, ...] = SECTIONS) -> dict[str, DataFrame]:
        from tessera.sources.files import export_sections

        return export_sections(self.store.read, self.namespace, embeddings, sections)

    # -- entities -----------------------------------------------------------------------------------------------------

    def entity_create(self, name: str, kind: str, aliases: list[str] | None = None, **kw) -> str:
        """An entity of this name: the one there is, with new aliases added, or a new one."""
        name = name.strip()
        if not name or kind not in TYPES:
            raise ValueError("the name is empty or the type is unknown")
        have = self._mine("entities").where(F.lower("name") == name.lower()).first()
        if have is not None:
            if aliases:
                self.entity_update(have.id, aliases=aliases)
            return have.id
        key, at = f"ent-{uuid.uuid4().hex}", _now()
        row = {
            "id": key, "namespace": self.namespace, "name": name, "type": kind, "aliases": aliases or [],
            "mention_count": 0, "first_seen_at": at, "last_seen_at": at,
        } | kw
        self.store.append("entities", self._rows("entities", [row]))
        self._embed_entities([row])
        self._own_aliases(key, [name, *(aliases or [])])
        return key

    def _embed_entities(self, rows: list[dict]) -> None:
        """Store the vectors of entities that are new or changed, so that a search embeds only its query."""
        vectors = [(r["id"], self._vector(" ".join(x for x in (r["name"], r.get("summary")) if x))) for r in rows]
        self.embeddings_upsert("entity_embeddings", self.spark.createDataFrame(vectors, "entity_id string, embedding array<float>"))

    def _own_aliases(self, key: str, aliases: list[str]) -> None:
        """The latest registration owns an alias."""
        at = _now()
        rows = [(self.namespace, a.strip().lower(), key, at, str(i)) for i, a in enumerate(aliases) if a and a.strip()]
        if rows:
            new = self.spark.createDataFrame(rows, "namespace string, alias string, entity_id string, at timestamp, id string")
            self._change("entity_aliases", lambda have: ent.registered(have, new))

    def entity_add_alias(self, key: str, alias: str) -> None:
        self.entity_update(key, aliases=[alias])

    def entity_delete(self, key: str) -> None:
        self._entity(key)
        self._delete("entities", self._mine("entities").where(F.col("id") == key))

    def _entity(self, key: str) -> dict:
        return self._one("entities", key)

    def entity_mention(self, key: str, source_type: str, source_id: str, context: str | None = None, at: datetime | None = None) -> None:
        self._entity(key)
        row = {
            "id": f"men-{uuid.uuid4().hex}", "entity_id": key, "namespace": self.namespace,
            "source_type": source_type, "source_id": source_id, "context": context, "created_at": at or _now(),
        }
        self.store.append("entity_mentions", self._rows("entity_mentions", [row]))

    def entity_relate(self, source: str, target: str, kind: str, description: str | None = None, confidence: float = 1.0) -> None:
        at = _now()
        row = {
            "id": f"rel-{uuid.uuid4().hex}", "namespace": self.namespace, "source_entity_id": source,
            "target_entity_id": target, "relation_type": kind, "description": description,
            "confidence": confidence or 1.0, "mention_count": 1, "first_seen_at": at, "last_seen_at": at,
        }
        self.store.append("entity_relationships", self._rows("entity_relationships", [row]))

    def _edges(self) -> DataFrame:
        seen = self._mine("entity_relationships").select("*", F.col("last_seen_at").alias("seen_at"), F.col("id").alias("seen_id"))
        return ent.relationships(seen)

    def entity_query(self, name: str, mentions: int = 10) -> dict:
        got = ent.resolved(self.spark.createDataFrame([(self.namespace, name)], "namespace string, name string"), self._mine("entities")).first()
        if got is None or got.match == "new":
            raise NotFound(name)
        own = self._mine("entity_mentions").where(F.col("entity_id") == got.entity_id)
        return {
            "entity": self._entity(got.entity_id), "confidence": got.confidence, "match": got.match,
            "mentions": [r.asDict() for r in ent.recent_mentions(own, mentions).orderBy("rank").collect()],
            "relationships": [r.asDict() for r in self.entity_relationships(got.entity_id).collect()],
        }

    def entity_search(self, query: str, k: int = 10, mode: str = "hybrid", kind: str | None = None) -> DataFrame:
        rows = self._mine("entities") if kind is None else self._mine("entities").where(F.col("type") == kind)
        text = F.concat_ws(" ", "name", "summary")
        rows = rows.join(self.store.read("entity_embeddings").withColumnRenamed("entity_id", "id"), "id", "left")
        hits = hybrid_search(rows, "id", text, query, self._vector(query), k, mode=mode)
        return hits.join(rows.select("id", "name", "type"), "id").orderBy("rank")

    def entity_relationships(self, key: str, direction: str = "both") -> DataFrame:
        return ent.edges_of(self._edges(), key, direction).orderBy(F.desc("mention_count"), F.desc("last_seen_at"))

    def _save(self, rows: list[dict], gone: list[str]) -> None:
        self._change("entities", lambda have: have.where(~F.col("id").isin(*gone)).unionByName(self._rows("entities", rows)))
        self._embed_entities(rows)

    def entity_update(
        self, key: str, aliases: list[str] | None = None, attributes: dict | None = None,
        metadata: dict | None = None, summary: str | None = None,
    ) -> None:
        row = self._entity(key)
        row["aliases"] = list(dict.fromkeys([*(row["aliases"] or []), *(aliases or [])]))
        row["attributes"] = (row["attributes"] or {}) | (attributes or {})
        row["metadata"] = (row["metadata"] or {}) | (metadata or {})
        row["summary"] = summary if summary is not None else row["summary"]
        self._save([row], [key])
        self._own_aliases(key, aliases or [])

    def entity_merge(self, source: str, target: str) -> dict:
        if source == target:
            raise ValueError("an entity can't be merged with itself")
        s, t = self._entity(source), self._entity(target)
        seen, aliases = {t["name"].lower()}, []
        for a in [*(t["aliases"] or []), s["name"], *(s["aliases"] or [])]:
            if a.lower() not in seen:
                seen.add(a.lower())
                aliases.append(a)
        t |= {
            "aliases": aliases, "attributes": (s["attributes"] or {}) | (t["attributes"] or {}),
            "first_seen_at": min(s["first_seen_at"], t["first_seen_at"]),
            "last_seen_at": max(s["last_seen_at"], t["last_seen_at"]),
        }
        moved = lambda c: F.when(F.col(c) == source, F.lit(target)).otherwise(F.col(c))
        self._change("entity_mentions", lambda rows: rows.withColumn("entity_id", moved("entity_id")))
        t["mention_count"] = self._mine("entity_mentions").where(F.col("entity_id") == target).count()
        loop = (F.col("namespace") == self.namespace) & (F.col("source_entity_id") == F.col("target_entity_id"))
        both = lambda rows: rows.withColumn("source_entity_id", moved("source_entity_id")).withColumn("target_entity_id", moved("target_entity_id"))
        self._change("entity_relationships", lambda rows: both(rows).where(~loop))
        self._change("entity_aliases", lambda rows: rows.withColumn("entity_id", moved("entity_id")))
        self._change("entity_embeddings", lambda rows: rows.where(F.col("entity_id") != source))
        self._save([t], [source, target])
        return {"entity_id": target, "mention_count": t["mention_count"]}

    def entity_list(self, sort: str = "name", kind: str | None = None, limit: int = 50, after: tuple | None = None) -> DataFrame:
        column, down = {"name": ("name", False), "mention_count": ("mention_count", True), "last_seen": ("last_seen_at", True)}[sort]
        counts = ent.mention_counters(self._mine("entity_mentions")).select(F.col("entity_id").alias("id"), F.col("mention_count").alias("n"))
        rows = self._mine("entities").join(counts, "id", "left").withColumn(
            "mention_count", F.greatest("mention_count", F.coalesce("n", F.lit(0))),
        ).drop("n")
        return conv.page(rows if kind is None else rows.where(F.col("type") == kind), column, "id", limit, after, descending=down)
