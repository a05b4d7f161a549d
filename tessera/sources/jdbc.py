"""Tables of a database as a second backend."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def jdbc_table(
    spark: SparkSession, url: str, name: str, properties: dict[str, str] | None = None, split_on: str | None = None,
    splits: int = 8,
) -> DataFrame:
    """A table of the database at `url`, filters and columns pushed down. `split_on`, a numeric column, is read in `splits`
    parallel ranges between its least and greatest value; column names come back in lower case."""
    options = {"url": url, "dbtable": name} | (properties or {})
    if split_on:
        column = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(split_on)
        bounds = spark.read.format("jdbc").options(
            **(options | {"dbtable": f"(SELECT MIN({column}) AS LO, MAX({column}) AS HI FROM {name}) b"})
        ).load().first()
        if bounds[0] is not None:
            options |= {
                "partitionColumn": split_on, "lowerBound": str(bounds[0]), "upperBound": str(int(bounds[1]) + 1),
                "numPartitions": str(splits),
            }
    rows = spark.read.format("jdbc").options(**options).load()
    return rows.toDF(*(c.lower() for c in rows.columns))


def jdbc_write(rows: DataFrame, url: str, name: str, properties: dict[str, str] | None = None, mode: str = "append") -> None:
    rows.write.format("jdbc").options(**({"url": url, "dbtable": name} | (properties or {}))).mode(mode).save()
