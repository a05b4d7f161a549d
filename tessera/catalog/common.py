"""Shared pieces of the queries: tables without rows delivered twice, and their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession


from tessera.sources.tables import table

NOW = datetime(2026, 7, 1)
DIM = 64


def once(spark: SparkSession, d: str, name: str, where: str | None = None) -> DataFrame:
    """Rows of a table, those delivered twice once. Both deliveries are alike, so `where` is applied before, at the scan."""
    rows = table(spark, d, name)
    return (rows if where is None else rows.where(where)).dropDuplicates(["id"])


def query_vector(spark: SparkSession, d: str) -> list[float]:
    """The vector asked for: that of embeddings.vec_id 0."""
    return list(table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0])


#: Conditions and expressions of the SQL twins.
GOOD = f"len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) > 0"
ASKED = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)"
COS = f"list_cosine_similarity(CAST(embedding AS DOUBLE[]), {ASKED})"
WS = r"[\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sql_terms(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


def sql_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"


def sql_bm25(source: str, text: str, wanted: list[str]) -> str:
    """CTEs b0, b1, b2: rows of `source` with score, for single-term phrases."""
    fs = ", ".join(f"len(list_filter(t, lambda w: w = '{w}')) AS f{i}" for i, w in enumerate(wanted))
    dfs = ", ".join(f"count(*) FILTER (f{i} > 0) AS df{i}" for i in range(len(wanted)))
    score = " + ".join(
        f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 0.000001) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(wanted))
    )
    return f"""b0 AS (SELECT *, {sql_terms(text)} AS t FROM {source}),
b1 AS (SELECT *, len(t) AS dl, {fs} FROM b0),
b2 AS (SELECT count(*) AS n, avg(dl) AS avgdl, {dfs} FROM b1),
bm AS (SELECT b1.*, {score} AS score FROM b1, b2 WHERE greatest({', '.join(f'f{i}' for i in range(len(wanted)))}) > 0)"""


