"""A filter of bounded size that keeps most rows out of a shuffle.

The hashes of wanted keys set bits of bitmaps of 4 KB. There are sixteen bits a key, in powers of two between
LEAST and MOST, so the filter takes at most 32 MB and can be broadcast. A row whose bit is not set has no wanted
key; one whose bit is set may have one, 6 % of the others do up to MOST / 16 keys, more beyond: results don't
depend on it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, MOST = 1 << 20, 1 << 28
PER_KEY = 16
_BITMAP = 32_768  # bits of one of Spark's bitmaps


@dataclass(frozen=True)
class Bits:
    bitmaps: DataFrame
    size: int


def bits_of(keys: DataFrame, hashed: Column) -> Bits:
    """The filter of a table's keys; the table is counted first, so it should be one that is written."""
    size = min(MOST, max(LEAST, 1 << (PER_KEY * keys.count() - 1).bit_length()))
    bit = F.pmod(hashed, F.lit(size))
    bitmaps = keys.groupBy(F.floor(bit / _BITMAP).alias("__bucket")).agg(F.bitmap_construct_agg((bit % _BITMAP).cast("long")).alias("__bits"))
    return Bits(bitmaps, size)


def marked(rows: DataFrame, hashed: Column, bits: Bits, name: str = "__maybe") -> DataFrame:
    """rows with a boolean column: false only if no key of `bits` has this hash."""
    at = f"(__bit % {_BITMAP})"
    byte = f"cast(conv(hex(substring(__bits, cast({at} div 8 as int) + 1, 1)), 16, 10) as int)"
    isset = F.coalesce(F.expr(f"{byte} & shiftleft(1, cast({at} % 8 as int)) != 0"), F.lit(False))
    placed = rows.withColumn("__bit", F.pmod(hashed, F.lit(bits.size))).withColumn("__bucket", F.floor(F.col("__bit") / _BITMAP))
    return placed.join(F.broadcast(bits.bitmaps), "__bucket", "left").withColumn(name, isset).drop("__bit", "__bucket", "__bits")
