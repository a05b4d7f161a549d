"""Calls of the engine from a shell: named queries, and a store's search, statistics, retention, export and backup."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera import queries_core
from tessera.catalog import graph, knowledge, memory, search, upkeep
from tessera.memory import Memory
from tessera.plans.ship import ship
from tessera.store import open_store

QUERIES = {k: f for m in (queries_core, search, knowledge, memory, graph, upkeep) for k, f in m.QUERIES.items()}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    sub = p.add_subparsers(dest="call", required=True)
    sub.add_parser("queries", help="names of all queries")
    run = sub.add_parser("run", help="one query on a folder of tables")
    run.add_argument("name", choices=sorted(QUERIES))
    run.add_argument("folder")
    run.add_argument("--limit", type=int, default=20, help="rows to show")
    run.add_argument("--out", help="write the whole result there as Parquet instead")
    for name, text in (
        ("search", "chunks for a question"), ("stats", "rows by table"), ("gc", "retention"),
        ("export", "JSON lines"), ("backup", "a copy of all tables"), ("ingest", "text files into a collection"),
    ):
        c = sub.add_parser(name, help=text)
        c.add_argument("store")
        c.add_argument("namespace")
        if name == "search":
            c.add_argument("question")
            c.add_argument("-k", type=int, default=10)
            c.add_argument("--mode", choices=("hybrid", "vector", "text"), default="hybrid")
        if name in ("export", "backup"):
            c.add_argument("to")
        if name == "export":
            c.add_argument("--embeddings", action="store_true")
        if name == "gc":
            for rule in ("conversation", "entity", "history", "run"):
                c.add_argument(f"--{rule}-days", type=int, default=0)
            c.add_argument("--dry-run", action="store_true")
        if name == "ingest":
            c.add_argument("collection")
            c.add_argument("path")
            c.add_argument("--glob")
            c.add_argument("--recursive", action="store_true")
    return p


def shown(df: DataFrame, limit: int, tell: Callable[[str], None]) -> None:
    for row in df.limit(limit).toJSON().collect():
        tell(row)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, tell: Callable[[str], None] = print) -> None:
    a = parser().parse_args(argv)
    if a.call == "queries":
        tell("\n".join(sorted(QUERIES)))
        return
    spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
    ship(spark)
    if a.call == "run":
        result = QUERIES[a.name](spark, a.folder)
        if a.out:
            result.write.mode("overwrite").parquet(a.out)
        else:
            shown(result, a.limit, tell)
        return
    store = open_store(spark, {"root": a.store})
    service = Memory(store, a.namespace)
    if a.call == "search":
        shown(service.knowledge_search(a.question, a.k, a.mode), a.k, tell)
    elif a.call == "stats":
        tell(json.dumps(service.namespace_stats()))
    elif a.call == "gc":
        tell(
            json.dumps(
                service.gc(
                    conversation_days=a.conversation_days, entity_days=a.entity_days, history_days=a.history_days,
                    run_days=a.run_days, dry_run=a.dry_run,
                )
            )
        )
    elif a.call == "export":
        tell(json.dumps(service.export(a.to, a.embeddings)))
    elif a.call == "backup":
        store.backup(a.to, lambda name, n: tell(f"{name}: {n}"))
    else:
        from tessera.sources.files import text_files

        files = text_files(spark, a.path, a.glob, a.recursive)
        good = [{"title": r.title, "source": r.source, "content": r.content} for r in files.where("error IS NULL").toLocalIterator()]
        done = service.knowledge_bulk_ingest(a.collection, good).groupBy("succeeded").count().collect()
        bad = [r.source for r in files.where("error IS NOT NULL").select("source").collect()]
        tell(
            json.dumps(
                {"ingested": sum(r["count"] for r in done if r.succeeded), "empty": sum(r["count"] for r in done if not r.succeeded), "failed": bad}
            )
        )


if __name__ == "__main__":
    main()
