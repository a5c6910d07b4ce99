"""Numeric conventions shared by every report.

Money and quantities are summed as the decimals they are stored as, so a sum does
not depend on how rows are spread over partitions and keeps every stored digit;
unit costs are doubles, as stored, and so is what is multiplied by them.  Ratios
are taken in double at the end and guarded (ANSI mode raises on a zero divisor,
the reference returns 0).  Nothing is rounded here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(c: Column | str) -> Column:
    return as_col(c).cast("double")


def out(c: Column | str) -> Column:
    """Report value: the double of an exact sum."""
    return dbl(c)


def out_product(c: Column) -> Column:
    """A product; ``+ 0.0`` turns IEEE -0.0 (0 x negative) into 0.0."""
    return c + F.lit(0.0)


def safe_ratio(num: Column | str, den: Column | str) -> Column:
    """``num / den`` when ``den > 0`` else 0, in double."""
    d = dbl(den)
    return F.when(d > 0, dbl(num) / d).otherwise(F.lit(0.0))


def nonzero_ratio(num: Column | str, den: Column | str) -> Column:
    """Python ``num / den if den else 0.0`` (negative denominators divide)."""
    d = dbl(den)
    return F.when(d != 0, dbl(num) / d).otherwise(F.lit(0.0))
