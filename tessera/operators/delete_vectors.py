"""Applying a feed of inserts, updates and deletes through delete vectors.

The files of the feed hold the row images and are never rewritten. An index maps each key to the
file position of its newest image; every other position, and that of a key whose newest change is
a delete, is superseded. Superseded positions become bits of per-file bitmaps, 32,768 rows to a
bitmap, and a read filters positions against them. New changes are new files: their images are
appended, and only the keys they touch set further bits.

Changes of a key apply in order of updated_at, version and id, so repeated and out-of-order
deliveries end in the same state. Defined results: a null or empty run_id is the persistent scope
''; operations are compared trimmed and in lower case, and changes with any other operation are
superseded at once; nulls sort first; an empty feed has no entries.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.keys import code
from tessera.plans.shared import Folder

KEY = ("namespace", "run_id", "key")
ORDER = ("updated_at", "version", "id")
OPERATIONS = ("set", "merge", "delete")
ROWS_PER_BITMAP = 32_768  # of Spark's bitmap functions


def positioned(files: DataFrame) -> DataFrame:
    """Rows read from Parquet, with their file and position in it as __file and __pos."""
    return files.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__pos")).withColumn(
        "run_id", F.coalesce("run_id", F.lit(""))
    )


def key_index(rows: DataFrame, key: tuple[str, ...] = KEY, order: tuple[str, ...] = ORDER) -> DataFrame:
    """key -> position of the newest image. max() combines map-side, so a busy key costs one row a task."""
    newest = F.max(F.struct(*order, code("operation").alias("op"), "__file", "__pos"))
    return rows.where(code("operation").isin(*OPERATIONS)).groupBy(*key).agg(newest.alias("__at")).select(*key, "__at.*")


def delete_vectors(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Bitmaps of the superseded positions: __file, __bucket, __bits."""
    live = index.where(F.col("op") != "delete").select("__file", "__pos")
    dead = rows.select("__file", "__pos").join(live, ["__file", "__pos"], "left_anti")
    return (
        dead.withColumn("__bucket", F.floor(F.col("__pos") / ROWS_PER_BITMAP))
        .groupBy("__file", "__bucket")
        .agg(F.bitmap_construct_agg((F.col("__pos") % ROWS_PER_BITMAP).cast("long")).alias("__bits"))
    )


def merge_vectors(vectors: DataFrame) -> DataFrame:
    """The union of bitmaps written at different times."""
    return vectors.groupBy("__file", "__bucket").agg(F.bitmap_or_agg("__bits").alias("__bits"))


def read_live(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """The rows whose bit is not set."""
    at = f"(__pos % {ROWS_PER_BITMAP})"
    byte = f"cast(conv(hex(substring(__bits, cast({at} div 8 as int) + 1, 1)), 16, 10) as int)"
    dead = F.coalesce(F.expr(f"{byte} & shiftleft(1, cast({at} % 8 as int)) != 0"), F.lit(False))
    return rows.withColumn("__bucket", F.floor(F.col("__pos") / ROWS_PER_BITMAP)).join(vectors, ["__file", "__bucket"], "left").where(~dead).drop("__file", "__pos", "__bucket", "__bits")


def current_entries(files: DataFrame) -> DataFrame:
    """The current row of every key of a feed read from Parquet, without deleted ones."""
    rows = positioned(files)
    narrow = rows.select(*KEY, *ORDER, "operation", "__file", "__pos")
    return read_live(rows, delete_vectors(narrow, key_index(narrow)))


class DeleteVectorTable:
    """A table under `path`, which may exist: data/ holds images, index/ and dv/ what each batch superseded.

    A batch is there once its commit file is; of two writers of one batch, the later looks at the other's and tries again."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.files = Folder(spark, self.path)

    def parts(self) -> list[str]:
        """The folders of the committed batches, in order."""
        return [self.files.read(f"_commits/{name}") for name in self.files.names("_commits")]

    def _read(self, kind: str, parts: list[str]) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.path}/{kind}/{p}" for p in parts))

    def apply(self, changes: DataFrame) -> None:
        """Append the images of `changes` and mark what they supersede."""
        images = uuid.uuid4().hex
        changes.write.parquet(f"{self.path}/data/{images}")
        new = positioned(self._read("data", [images])).select(*KEY, *ORDER, "operation", "__file", "__pos")
        while True:
            before = self.parts()
            touched = new
            if before:
                old = self._read("index", before).withColumnRenamed("op", "operation")
                # older batches' newest images of the keys that are touched again; what came before those is superseded already
                keys = new.select(*(F.col(k).alias(f"__{k}") for k in KEY)).distinct()
                same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in KEY]
                touched = new.unionByName(old.join(keys, same, "left_semi").select(new.columns))
            key_index(touched).write.mode("overwrite").parquet(f"{self.path}/index/{images}")
            delete_vectors(touched, self._read("index", [images])).write.mode("overwrite").parquet(f"{self.path}/dv/{images}")
            if self.files.create(f"_commits/{len(before):010d}", images):
                return

    def read(self) -> DataFrame:
        parts = self.parts()
        return read_live(positioned(self._read("data", parts)), merge_vectors(self._read("dv", parts)))
