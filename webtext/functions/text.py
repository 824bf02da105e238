"""Native string expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode-aware whitespace: (?U) makes \s the Unicode White_Space set, which
# includes the no-break space (plain \s and trim miss it).
_WS_RUN = r"(?U)\s+"
_WS_EDGES = r"(?U)^\s+|\s+$"


def collapse_ws(col: Column) -> Column:
    """Trim Unicode whitespace and collapse each run to one space."""
    return F.trim(F.regexp_replace(col, _WS_RUN, " "))


def strip_ws(col: Column) -> Column:
    """Remove leading and trailing Unicode whitespace only."""
    return F.regexp_replace(col, _WS_EDGES, "")


def word_count(col: Column) -> Column:
    """Number of pieces when splitting on a single space (empty text -> 1)."""
    return (F.octet_length(col) - F.octet_length(F.replace(col, F.lit(" "), F.lit(""))) + 1).cast("bigint")


def is_heading_tag(tag: Column) -> Column:
    """Tag name contains h1..h6."""
    return tag.rlike("h[1-6]")


def strip_fragment(url: Column) -> Column:
    """Drop a ``#...`` fragment."""
    return F.regexp_replace(url, "#.*$", "")


def md5_order(key: Column, seed: int) -> Column:
    """Reproducible pseudo-random order key: md5 of ``'<seed>|' || key``."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, also within a lambda."""
    return F.transform(F.array(value), use)[0]
