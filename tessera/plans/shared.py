"""Small files on whatever file system Spark writes to, through Hadoop's FileSystem."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Folder:
    """Files below one path, local or shared."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._jvm = spark._jvm
        self.path = path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, below: str = "") -> list[str]:
        """Names in a folder, in order; none where there is no folder."""
        at = self._at(below)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def create(self, name: str, text: str) -> bool:
        """Write a new file; False, and nothing written, if it is there already."""
        try:
            out = self._fs.create(self._at(name), False)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True

    def read(self, name: str) -> str:
        file = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
        finally:
            file.close()

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._at(name), True)


def write_parts(rows: DataFrame, folder: Folder, name: str, by: str) -> None:
    """Write rows in folders by a column, with their schema beside them, so that an empty table can be read as well."""
    rows.write.mode("overwrite").partitionBy(by).parquet(f"{folder.path}/{name}")
    folder.delete(f"{name}.schema")
    folder.create(f"{name}.schema", rows.schema.json())


def read_parts(spark: SparkSession, folder: Folder, name: str) -> DataFrame:
    schema = StructType.fromJson(json.loads(folder.read(f"{name}.schema")))
    return spark.read.schema(schema).parquet(f"{folder.path}/{name}")
