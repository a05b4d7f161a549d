"""Word, sentence and paragraph splitting as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.keys import strip


def words(text: Column) -> Column:
    """Runs without Unicode white space."""
    return F.filter(F.split(text, r"(?U)\s+", -1), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def _stripped(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def sentences(text: Column) -> Column:
    """A sentence ends at . ! or ? before one white space and a capital."""
    return _stripped(F.split(text, r"(?U)(?<=[.!?])\s(?=\p{Lu})", -1))


def paragraphs(text: Column) -> Column:
    return _stripped(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"\n\n", -1))


def terms(text: Column) -> Column:
    """Search terms: runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\p{L}\p{N}]+", -1), lambda w: w != "")


def truncated(text: Column, limit: int, mark: str = "\n[truncated]") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(mark))).otherwise(text)


def preview(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit - 3)), F.lit("..."))).otherwise(text)
