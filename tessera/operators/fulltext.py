"""BM25 full-text ranking with OR semantics, phrases for words with inner punctuation, and AND matching.

Only the query's terms are counted, so no table of postings is built: one pass gathers the number of
rows, their mean length and each term's row count (one row in all), a second scores the rows that match.
For many queries of one corpus, postings.TextIndex is built once.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import terms
from tessera.plans.lineage import written

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Words that a stemmed query leaves out.
STOP = frozenset("a an and are as at be by for from in is it of on or that the this to was were will with".split())


def prepare(query: str) -> str:
    """The match expression of a query: quoted words joined by OR, words of one byte dropped unless there are no others."""
    words = [w.replace('"', '""') for w in query.split()]
    long = [w for w in words if len(w.encode()) >= 2]
    if long:
        return " OR ".join(f'"{w}"' for w in long)
    return '"' + query.replace('"', '""') + '"'


def phrases(query: str) -> list[tuple[str, ...]]:
    """What prepare() matches: each quoted word as the terms it splits into."""
    parts = [w for w in query.split() if len(w.encode()) >= 2] or [query]
    split = [tuple(t for t in re.split(r"[\W_]+", p.lower()) if t) for p in parts]
    return list(dict.fromkeys(p for p in split if p))


def _frequency(tokens: Column, wanted: Column, phrase: tuple[str, ...]) -> Column:
    """Occurrences of a phrase; `wanted` holds those tokens that are a query term."""
    if len(phrase) == 1:
        return F.size(F.filter(wanted, lambda t: t == phrase[0]))
    # one string a row, in which a look-ahead counts overlapping occurrences too; terms hold letters and digits only
    line = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    return F.regexp_count(line, F.lit(f"(?= {' '.join(phrase)} )"))


def counted(rows: DataFrame, text: Column, query: str, repeated_by: str | None = None) -> tuple[DataFrame, list[str]]:
    """rows with __dl (length) and one __f column for each phrase. Rows delivered more than once, by the id
    `repeated_by`, count once; they are dropped behind the counting, so that numbers are shuffled and no texts."""
    wanted = phrases(query)
    names = [f"__f{i}" for i in range(len(wanted))]
    single = [p[0] for p in wanted if len(p) == 1]
    tokens = rows.withColumn("__t", terms(text)).withColumn("__w", F.filter("__t", lambda t: t.isin(*single)) if single else F.lit(None))
    counts = (_frequency(F.col("__t"), F.col("__w"), p).alias(n) for p, n in zip(wanted, names, strict=True))
    out = tokens.select("*", F.size("__t").alias("__dl"), *counts).drop("__t", "__w")
    return out if repeated_by is None else out.dropDuplicates([repeated_by]), names


def statistics(rows: DataFrame, names: list[str]) -> DataFrame:
    """One row: __n rows, __avg mean length, and rows that hold each phrase."""
    return rows.agg(F.count("*").alias("__n"), F.avg("__dl").alias("__avg"), *(F.count_if(F.col(n) > 0).alias(f"{n}_df") for n in names))


def _scored(with_counts: DataFrame, names: list[str]) -> DataFrame:
    """Rows that hold a phrase, with their score; the statistics are those of all rows."""
    stats = F.broadcast(statistics(with_counts, names))  # one row

    def part(n: str) -> Column:
        df, f = F.col(f"{n}_df"), F.col(n)
        idf = F.greatest(F.log((F.col("__n") - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))
        return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("__dl") / F.col("__avg")))

    score = sum((part(n) for n in names), F.lit(0.0))
    some = with_counts.where(F.greatest(*(F.col(n) for n in names), F.lit(0)) > 0)
    return some.join(stats).withColumn("score", score).drop("__n", "__avg", "__dl", *names, *(f"{n}_df" for n in names))


def bm25(rows: DataFrame, text: Column, query: str, where: Column | None = None, repeated_by: str | None = None) -> DataFrame:
    """Matching rows with their score. `where` chooses among them and leaves the statistics alone."""
    with_counts, names = counted(rows, text, query, repeated_by)
    if not names:
        return rows.withColumn("score", F.lit(0.0)).where(F.lit(False))
    scored = _scored(with_counts, names)
    return scored if where is None else scored.where(where)


def search(
    rows: DataFrame, text: Column, query: str, k: int, id_col: str, where: Column | None = None,
    repeated: bool = False, columns: bool = True,
) -> DataFrame:
    """The k best rows with score and rank; without `columns` only their ids.

    Texts are cut into terms once: a row's length and counts are written out, statistics and scores come from there, and
    the other columns are fetched for the k hits."""
    with_counts, names = counted(rows, text, query, id_col if repeated else None)
    if not names:
        return (rows if columns else rows.select(id_col)).withColumn("score", F.lit(0.0)).withColumn("rank", F.lit(0)).where(F.lit(False))
    ok = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    numbers = written(with_counts.select(F.col(id_col).alias("__id"), ok.alias("__ok"), "__dl", *names), "counts")
    hits = _scored(numbers, names).where("__ok").withColumn("__s", F.round("score", 12)).orderBy(F.desc("__s"), "__id").limit(k)
    hits = hits.select("__id", "score", F.row_number().over(Window.orderBy(F.desc("__s"), "__id")).alias("rank"))
    if not columns:
        return hits.withColumnRenamed("__id", id_col)
    found = rows.join(F.broadcast(hits), F.col(id_col).eqNullSafe(F.col("__id"))).drop("__id")  # k rows
    return found.dropDuplicates([id_col]) if repeated else found


def match_all(rows: DataFrame, text: Column, query: str) -> DataFrame:
    """Rows that hold every phrase."""
    with_counts, names = counted(rows, text, query)
    for n in names:
        with_counts = with_counts.where(F.col(n) > 0)
    return with_counts.drop("__dl", *names)


def stem(word: Column) -> Column:
    """A word without its plural ending."""
    return (
        F.when(word.rlike("[^ae]ies$"), F.regexp_replace(word, "ies$", "y"))
        .when(word.rlike("[^aeo]es$"), F.regexp_replace(word, "es$", "e"))
        .when(word.rlike("[^us]s$"), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )


def cover_density(tokens: Column, wanted: Column) -> Column:
    """The sum of 1 / length over the shortest stretches of `tokens` that hold all `wanted` terms; 0 if there is none."""

    @F.arrow_udf("double")
    def density(token_lists: pa.Array, wanted_lists: pa.Array) -> pa.Array:
        out = np.zeros(len(token_lists))
        for row, (words, terms_) in enumerate(zip(token_lists.to_pylist(), wanted_lists.to_pylist(), strict=True)):
            need, last, covered = set(terms_ or ()), {}, -1
            for i, w in enumerate(words or ()):
                if w in need:
                    last[w] = i
                    start = min(last.values())
                    # a stretch that begins where one before it began isn't shortest
                    if len(last) == len(need) and start > covered:
                        out[row] += 1 / (i - start + 1)
                        covered = start
        return pa.array(out)

    return density(tokens, wanted)


def match_stemmed(rows: DataFrame, text: Column, query: str) -> DataFrame:
    """Rows that hold every word of the query up to its plural, words of STOP aside, with the cover density as score."""
    words = [w for w in dict.fromkeys(t for p in phrases(query) for t in p) if w not in STOP]
    if not words:
        return rows.withColumn("score", F.lit(0.0)).where(F.lit(False))
    wanted = F.array_distinct(F.transform(F.array(*(F.lit(w) for w in words)), stem))
    found = rows.withColumn("__t", F.transform(terms(text), stem)).where(F.size(F.array_except(wanted, "__t")) == 0)
    return found.withColumn("score", cover_density(F.col("__t"), wanted)).drop("__t")
