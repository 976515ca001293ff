"""String and array column helpers (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rx_first(col: Column, pattern: str, group: int = 1) -> Column:
    """First match of ``group``; '' when there is no match."""
    return F.regexp_extract(col, pattern, group)


def rx_all(col: Column, pattern: str, group: int = 1) -> Column:
    """All non-overlapping matches of ``group``, in text order."""
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(group))


def strip_ws(col: Column) -> Column:
    """Remove leading and trailing whitespace, newlines included."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def cap_ws_runs(col: Column) -> Column:
    """Shorten every whitespace run of 4+ characters to three blanks.

    The method / field patterns have nested whitespace quantifiers that are
    cubic on long blank runs in a backtracking engine. Three blanks keep every
    match (a match needs at most three separators) and make the scan linear.
    """
    return F.regexp_replace(col, r"\s\s\s\s++", "   ")


def str_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def pick(values, idx: Column) -> Column:
    """values[idx] for a 0-based integer column (literal lookup list)."""
    return F.element_at(str_array(values), (idx + F.lit(1)).cast("int"))


def last_segment(col: Column) -> Column:
    """'a.b.C' -> 'C' (text after the last dot; '' after a trailing dot)."""
    return F.substring_index(col, ".", -1)


def join_list(col: Column, sep: str = "|") -> Column:
    return F.array_join(col, sep)


def word_count(col: Column) -> Column:
    """Number of whitespace-separated words (like Python's str.split())."""
    return F.size(F.filter(F.split(col, r"\s+", -1), lambda w: w != F.lit("")))
