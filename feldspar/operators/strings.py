"""Text clean-up as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def replace(c: Column, pattern: str, replacement: str, every: bool = True) -> Column:
    """Literal; an empty pattern changes nothing."""
    if not pattern:
        return c
    if every:
        return F.replace(c, F.lit(pattern), F.lit(replacement))
    at = F.locate(pattern, c)
    return F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), F.lit(replacement), F.substring(c, at + len(pattern), F.length(c)))).otherwise(c)


def pad(c: Column, length: int, fill: str = " ", side: str = "left") -> Column:
    """Never shortens; both: the left side gets the smaller half."""
    if not fill:
        return c
    short = F.length(c) < length
    if side == "left":
        return F.when(short, F.lpad(c, length, fill)).otherwise(c)
    if side == "right":
        return F.when(short, F.rpad(c, length, fill)).otherwise(c)
    half = F.length(c) + F.floor((F.lit(length) - F.length(c)) / 2).cast("int")
    return F.when(short, F.rpad(F.lpad(c, half, F.lit(fill)), length, fill)).otherwise(c)


def substring(c: Column, start: int, length: int | None = None) -> Column:
    """From 0; to the end without a length."""
    start = max(0, start)
    return F.substring(c, F.lit(start + 1), F.length(c) if length is None else F.lit(max(0, length)))
