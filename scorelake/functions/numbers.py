"""Doubles that compare alike however they were summed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Moves exact ties of a decimal rounding aside, far above the noise of sums.
ASIDE = 1.3e-11


def settled(c: Column | str) -> Column:
    """Rounded to 9 places; means of decimal values can lie exactly between two, where noise would decide."""
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(ASIDE), 9)
