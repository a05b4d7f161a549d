"""Display forms: ages, sizes, backoff delays, hashes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ago(n: Column, unit: str) -> Column:
    return F.when(n == 1, F.lit(f"1 {unit} ago")).otherwise(F.concat(n.cast("string"), F.lit(f" {unit}s ago")))


def time_ago(ts: Column, now: datetime) -> Column:
    seconds = F.timestamp_diff("SECOND", ts, F.lit(now).cast("timestamp_ntz"))
    return (
        F.when(seconds < 60, F.lit("just now"))
        .when(seconds < 3600, _ago(F.floor(seconds / 60), "minute"))
        .when(seconds < 86400, _ago(F.floor(seconds / 3600), "hour"))
        .when(seconds < 7 * 86400, _ago(F.floor(seconds / 86400), "day"))
        .otherwise(F.date_format(ts, "MMM d, yyyy"))
    )


def byte_size(n: Column) -> Column:
    kb, mb, gb = 1024, 1024**2, 1024**3
    return (
        F.when(n >= gb, F.format_string("%.2f GB", F.bround(n / gb, 2)))
        .when(n >= mb, F.format_string("%.2f MB", F.bround(n / mb, 2)))
        .when(n >= kb, F.format_string("%.2f KB", F.bround(n / kb, 2)))
        .otherwise(F.format_string("%d bytes", n))
    )


def backoff_seconds(attempts: Column, mode: str = "exponential") -> Column:
    """Five seconds, or powers of two up to five minutes."""
    return F.lit(5.0) if mode == "fixed" else F.least(F.pow(F.lit(2.0), attempts), F.lit(300.0))


def polynomial_hash(text: Column) -> Column:
    """h = 31 h + code, in signed 64-bit arithmetic that wraps round; kept in decimals, as plain arithmetic would overflow."""
    span = F.lit("18446744073709551616").cast("decimal(20,0)")
    zero = F.lit(0).cast("decimal(38,0)")
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    h = F.aggregate(chars, zero, lambda acc, c: ((acc * 31 + F.ascii(c)) % span).cast("decimal(38,0)"))
    return F.when(h >= F.lit("9223372036854775808").cast("decimal(20,0)"), h - span).otherwise(h).cast("long")


def string_map(json: Column) -> Column:
    """A JSON object as map<string,string>; values that are no strings stay as their JSON text. Null for anything else."""
    kept = F.from_json(json, "map<string,string>")
    return F.when(F.substring(F.trim(json), 1, 1) == "{", kept)
