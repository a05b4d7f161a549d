"""Named tables as versioned Parquet snapshots below one folder.

`<root>/<table>/_commits/N.json` lists the folders that version N is made of. A write makes a folder of its
own and then creates the next commit file, which fails if another writer has created it: an append then
looks at the new version and tries again, anything that depends on what it has read is turned away with a
VersionConflict. Readers see a whole version. Files are reached through Hadoop's FileSystem, so the root
may lie on shared storage, given that it creates a file only where there is none."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.shared import Folder
from tessera.sources.schemas import SCHEMA_VERSION, SCHEMAS, migrated


class NotFound(LookupError):
    pass


class AlreadyExists(ValueError):
    pass


class VersionConflict(ValueError):
    pass


class Store:
    def __init__(self, spark: SparkSession, root: str, keep: int = 3) -> None:
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep
        self.files = Folder(spark, self.root)

    def version(self, name: str) -> int:
        """The number of the table's newest commit; 0 where there is none."""
        commits = self.files.names(f"{name}/_commits")
        return int(commits[-1].split(".")[0]) if commits else 0

    def _state(self, name: str, version: int) -> dict:
        return json.loads(self.files.read(f"{name}/_commits/{version:010d}.json")) if version else {"parts": [], "schema": SCHEMA_VERSION}

    def schema_version(self) -> int:
        return SCHEMA_VERSION

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The newest version of a table, or an older one that is still kept."""
        state = self._state(name, self.version(name) if version is None else version)
        if not state["parts"]:
            return self.spark.createDataFrame([], SCHEMAS[name])
        out, by_schema = None, {}
        for part, schema in state["parts"]:
            by_schema.setdefault(schema, []).append(f"{self.root}/{name}/{part}")
        for schema, paths in sorted(by_schema.items()):
            rows = migrated(
                self.spark.read.parquet(*paths) if schema != SCHEMA_VERSION else self.spark.read.schema(SCHEMAS[name]).parquet(*paths),
                name, schema,
            )
            out = rows if out is None else out.unionByName(rows)
        return out

    def _write(self, name: str, df: DataFrame) -> str:
        part = f"part-{uuid.uuid4().hex}"
        target = self.spark.createDataFrame([], SCHEMAS[name]).schema
        shaped = df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in target))
        shaped.write.parquet(f"{self.root}/{name}/{part}")
        return part

    def _commit(self, name: str, version: int, parts: list) -> bool:
        return self.files.create(f"{name}/_commits/{version:010d}.json", json.dumps({"parts": parts, "schema": SCHEMA_VERSION}))

    def append(self, name: str, df: DataFrame, expected: int | None = None) -> int:
        """Add rows and return the new version. With `expected`, only if that is the version still."""
        part = self._write(name, df)
        while True:
            base = self.version(name) if expected is None else expected
            if self._commit(name, base + 1, [*self._state(name, base)["parts"], [part, SCHEMA_VERSION]]):
                return base + 1
            if expected is not None:
                self.files.delete(f"{name}/{part}")
                raise VersionConflict(f"{name}: version {expected} is not the newest")

    def replace(self, name: str, df: DataFrame, expected: int | None = None) -> int:
        """Put df, which was made from version `expected`, in the table's place; without it, from the version that is newest now."""
        base = self.version(name) if expected is None else expected
        part = self._write(name, df)
        if not self._commit(name, base + 1, [[part, SCHEMA_VERSION]]):
            self.files.delete(f"{name}/{part}")
            raise VersionConflict(f"{name}: version {base} is not the newest")
        self._forget(name, base + 1 - self.keep)
        return base + 1

    def _forget(self, name: str, upto: int) -> None:
        """Delete the folders that only versions before `upto` hold, and their commits."""
        commits = [int(c.split(".")[0]) for c in self.files.names(f"{name}/_commits")]
        kept = {part for v in commits if v >= upto for part, _ in self._state(name, v)["parts"]}
        for v in (v for v in commits if v < upto):
            for part, _ in self._state(name, v)["parts"]:
                if part not in kept:
                    self.files.delete(f"{name}/{part}")
            self.files.delete(f"{name}/_commits/{v:010d}.json")

    def upsert(self, name: str, df: DataFrame, key: str) -> int:
        """Rows of df in place of those with the same key; the last row of a key in df counts."""
        base = self.version(name)
        new = df.groupBy(key).agg(*(F.last(c).alias(c) for c in df.columns if c != key))
        old = self.read(name, base).join(new.select(key), key, "left_anti")
        return self.replace(name, old.unionByName(new, allowMissingColumns=True), base)

    def backup(self, dest: str, tell=None) -> None:
        """A copy of every table; `tell` hears the name and rows of each that is done."""
        for name in SCHEMAS:
            if self._state(name, self.version(name))["parts"]:
                self.read(name).write.mode("overwrite").parquet(f"{dest}/{name}.parquet")
                if tell is not None:
                    tell(name, self.spark.read.parquet(f"{dest}/{name}.parquet").count())


def open_store(spark: SparkSession, config: dict) -> Store:
    """The store that a configuration names: {"backend": "parquet", "root": ...}, or "jdbc" with url and properties, whose
    tables are copied into the root once, so that every call reads columns from Parquet."""
    kind = config.get("backend", "parquet")
    if kind not in ("parquet", "jdbc"):
        raise ValueError(f"unknown backend: {kind}")
    store = Store(spark, config["root"], config.get("keep", 3))
    if kind == "jdbc":
        from tessera.sources.jdbc import jdbc_table

        for name in config.get("tables", SCHEMAS):
            if not store.version(name):
                store.append(name, jdbc_table(spark, config["url"], name, config.get("properties")))
    return store
