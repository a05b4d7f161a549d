"""String and vector similarity as column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that initials skip.
SKIPPED = ("the", "of", "and", "a", "an")


def edit_distance(a: Column, b: Column, unit: str = "bytes") -> Column:
    """Levenshtein distance in bytes of UTF-8, or in characters."""
    if unit == "bytes":
        a, b = (F.decode(F.encode(x, "UTF-8"), "ISO-8859-1") for x in (a, b))
    return F.levenshtein(a, b)


def similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 for equal strings, 0 if one is empty."""
    longer = F.greatest(F.octet_length(a), F.octet_length(b))
    return F.when(a == b, 1.0).when((F.octet_length(a) == 0) | (F.octet_length(b) == 0), 0.0).otherwise(1.0 - edit_distance(a, b) / longer)


def initialism(name: Column) -> Column:
    """First letters of a name of two or more words, in capitals; '' for a single word."""
    from tessera.functions.text import words

    parts = words(name)
    kept = F.filter(parts, lambda w: ~F.lower(w).isin(*SKIPPED))
    return F.when(F.size(parts) <= 1, F.lit("")).otherwise(F.upper(F.array_join(F.transform(kept, lambda w: F.left(w, F.lit(1))), "")))


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vector columns; 0 if lengths differ or a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0) | norms.isNull() | F.isnan(norms), 0.0).otherwise(dot(a, b) / norms)


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of vectors of length `dim` that hold finite values and are not zero, and these as float64 rows."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(fits)
    x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return at[good], x[good]


def cosine_to(vector: Column, query: list[float]):
    """Cosine of a vector column to one vector, a matrix product per Arrow batch; null for unusable vectors."""
    q = np.asarray(query, np.float64)
    q = q / np.sqrt(q @ q)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        at, x = matrix(column, len(q))
        out = np.full(len(column), np.nan)
        # equal vectors must score alike wherever they stand in a batch, and sums may differ in the last bits there
        out[at] = np.round((x @ q) / np.sqrt((x * x).sum(axis=1)), 12)
        return pa.array(out, mask=np.isnan(out))

    return score(vector)
