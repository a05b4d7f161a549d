"""Key and code normalisation shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points of the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(col: Column | str) -> Column:
    """`col` without white space at either end."""
    return F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(WHITE_SPACE))


def code(col: Column | str) -> Column:
    """A key or code as it is compared: stripped, in lower case; null where nothing is left."""
    return F.nullif(F.lower(strip(col)), F.lit(""))


def is_blank(col: Column | str) -> Column:
    """True for null, empty and white-space texts."""
    return F.coalesce(F.length(strip(col)), F.lit(0)) == 0
