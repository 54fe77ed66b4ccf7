"""Canonical forms of loosely spelled ids, hashes, numbers and missing values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Blanks that surround a value, and the ways of writing "no value".
BLANKS = " \t\n\r\f\v\u0085             ​    　﻿"
NO_VALUE = ("", "-", "--", "?", "#n/a", "<na>", "\\n", "missing", "n.a.", "n/a", "na", "nan", "nil", "none", "not available", "null", "undefined", "unknown", "unspecified")


def trimmed(c: Column) -> Column:
    """The text without surrounding blanks."""
    return F.btrim(c.cast("string"), F.lit(BLANKS))


def folded(c: Column) -> Column:
    """Text compared without case and surrounding blanks; every way of writing 'no value' is null."""
    t = F.lower(trimmed(c))
    return F.when(~t.isin(*NO_VALUE), t)


def hex_digits(c: Column) -> Column:
    """Hash as lower-case hex digits, without an algorithm prefix such as ``sha256:``."""
    return F.nullif(F.regexp_replace(folded(c), r"^(?:[a-z]+-?[0-9]*\s*[:=]|0x)\s*", ""), F.lit(""))


def number(c: Column) -> Column:
    """Double of a number or of its text (decimal comma allowed); null for 'no value', NaN and other text."""
    t = folded(c)
    d = F.coalesce(t.try_cast("double"), F.when(~t.contains("."), F.replace(t, F.lit(","), F.lit("."))).try_cast("double"))
    return F.when(~F.isnan(d), d)
