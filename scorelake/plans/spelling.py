"""How the SQL counterparts spell values: the forms of ``functions.text``."""

from __future__ import annotations

from scorelake.functions.text import BLANKS, NO_VALUE

_BLANKS = "concat(" + ", ".join(f"chr({ord(c)})" for c in BLANKS) + ")"
NONE_SQL = ", ".join("'" + x + "'" for x in NO_VALUE)


def trim_sql(c: str) -> str:
    return f"trim(CAST({c} AS VARCHAR), {_BLANKS})"


def folded_sql(c: str) -> str:
    return f"CASE WHEN lower({trim_sql(c)}) NOT IN ({NONE_SQL}) THEN lower({trim_sql(c)}) END"
