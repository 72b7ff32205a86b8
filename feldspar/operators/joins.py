"""Equi-joins and the cross join with the library's naming rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError, ErrorCode

HOW = {"inner": "inner", "left": "left", "right": "right", "semi": "left_semi", "anti": "left_anti", "full": "full"}


def _names(df: DataFrame, keys) -> list[str]:
    keys = [keys] if isinstance(keys, str) else list(keys)
    for k in keys:
        if k not in df.columns:
            raise EngineError(ErrorCode.UnknownColumn, k)
    if not keys:
        raise EngineError(ErrorCode.EmptySchema, "no join keys")
    return keys


def _suffixed(left: list[str], right: list[str], dropped: set[str], suffix: str) -> dict[str, str]:
    """New names of the right side's columns; a collision that the suffix doesn't end is an error."""
    taken, out = set(left), {}
    for c in right:
        if c in dropped:
            continue
        new = c + suffix if c in left else c
        if new in taken:
            raise EngineError(ErrorCode.DuplicateColumn, new)
        taken.add(new)
        out[c] = new
    return out


def equi_join(left: DataFrame, right: DataFrame, left_on, right_on=None, how: str = "left", suffix: str = "_right") -> DataFrame:
    """Null keys match nothing.  A key of the same name on both sides is kept once.  Keys of different types
    meet as strings.  The strategy is Spark's choice."""
    a = _names(left, left_on)
    b = _names(right, a if right_on is None else right_on)
    if len(a) != len(b):
        raise EngineError(ErrorCode.SchemaMismatch, "as many keys on both sides")
    if how == "cross":
        return cross_join(left, right, suffix)
    same = {y for x, y in zip(a, b) if x == y}
    r = right.select(*[F.col(f"`{c}`").alias(f"__r{i}") for i, c in enumerate(right.columns)])
    at = {c: f"__r{i}" for i, c in enumerate(right.columns)}
    on = []
    for x, y in zip(a, b):
        u, v = F.col(f"`{x}`"), F.col(at[y])
        tx, ty = left.schema[x].dataType, right.schema[y].dataType
        on.append(u == v if tx == ty else u.cast("string") == v.cast("string"))
    joined = left.join(r, reduce(lambda p, q: p & q, on), HOW.get(how, "left"))
    if how in ("semi", "anti"):
        return joined
    names = _suffixed(left.columns, right.columns, same, suffix)
    keys = {x: at[y] for x, y in zip(a, b) if x == y}
    own = [F.coalesce(F.col(f"`{c}`"), F.col(keys[c])).alias(c) if c in keys and how in ("right", "full") else F.col(f"`{c}`") for c in left.columns]
    return joined.select(*own, *[F.col(at[c]).alias(n) for c, n in names.items()])


def cross_join(left: DataFrame, right: DataFrame, suffix: str = "_right") -> DataFrame:
    """All pairs, as asked for by name."""
    names = _suffixed(left.columns, right.columns, set(), suffix)
    return left.crossJoin(right.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]))
