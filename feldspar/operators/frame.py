"""Frame and Grouped: every method checks its names and types at once and returns a new, lazy frame."""

from __future__ import annotations

import contextlib
import io
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError, ErrorCode
from ..functions import Expr, col
from ..plans.compiler import Compiler, cast
from ..schema import Schema
from ..types import DType, Kind, is_numeric, kind_of
from . import cleaning, strings
from .joins import cross_join, equi_join


@dataclass(frozen=True)
class SortKey:
    column: str
    descending: bool = False
    nulls_first: bool = False
    collation: str | None = None


def asc(column: str, nulls_first: bool = False, collation: str | None = None) -> SortKey:
    return SortKey(column, False, nulls_first, collation)


def desc(column: str, nulls_first: bool = False, collation: str | None = None) -> SortKey:
    return SortKey(column, True, nulls_first, collation)


def agg(name: str, expr: Expr) -> tuple[str, Expr]:
    return name, expr


def _pairs(specs) -> list[tuple[str, Expr]]:
    """Specs as a dict, as pairs or as {name, expr} records."""
    if isinstance(specs, dict):
        return list(specs.items())
    return [(s["name"], s["expr"]) if isinstance(s, dict) else tuple(s) for s in specs]


def _list(names) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


class Frame:
    def __init__(self, df: DataFrame):
        self.df = df

    # -- looking at it

    @property
    def schema(self) -> Schema:
        return Schema.of(self.df.schema)

    @property
    def column_names(self) -> list[str]:
        return self.df.columns

    def dtypes(self) -> dict[str, str]:
        return {f.name: k.value if (k := kind_of(f)) else f.dataType.simpleString() for f in self.df.schema.fields}

    def format_schema(self) -> str:
        return "\n".join(f"{n}: {t}{'?' if self.df.schema[n].nullable else ''}" for n, t in self.dtypes().items())

    def print_schema(self) -> None:
        print(self.format_schema())

    def explain(self, mode: str = "formatted") -> str:
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            self.df.explain(mode)
        return out.getvalue()

    def _known(self, *names: str) -> None:
        for n in names:
            if n not in self.df.columns:
                raise EngineError(ErrorCode.UnknownColumn, n)

    def _kind(self, name: str) -> Kind | None:
        self._known(name)
        return kind_of(self.df.schema[name])

    def _col(self, name: str) -> Column:
        return F.col(f"`{name}`")

    # -- actions

    def collect(self) -> Frame:
        """The same rows, computed once and kept (recomputed from the source where an executor is lost)."""
        df = self.df.cache()
        df.count()
        return Frame(df)

    def to_list(self) -> list[dict[str, Any]]:
        return [r.asDict() for r in self.df.collect()]

    def batches(self):
        """Arrow batches, on the driver."""
        return self.df.toArrow().to_batches()

    def rows(self):
        """An iterator that holds one partition at a time."""
        return (r.asDict() for r in self.df.toLocalIterator())

    def count(self) -> int:
        return self.df.count()

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def measured(self) -> dict[str, Any]:
        """Runs the plan: rows out and seconds."""
        t = time.time()
        n = self.df.count()
        return {"rows_out": n, "seconds": time.time() - t}

    def show_string(self, max_rows: int = 10) -> str:
        rows = self.df.limit(max_rows + 1).collect()
        if not rows:
            return "Empty frame"
        cells = [self.df.columns] + [["null" if v is None else str(v) for v in r] for r in rows[:max_rows]]
        wide = [max(len(r[i]) for r in cells) for i in range(len(self.df.columns))]
        line = lambda a, b, c: a + b.join("─" * (w + 2) for w in wide) + c
        text = ["│" + "│".join(f" {v.ljust(w)} " for v, w in zip(r, wide)) + "│" for r in cells]
        more = ["..."] if len(rows) > max_rows else []
        return "\n".join([line("┌", "┬", "┐"), text[0], line("├", "┼", "┤"), *text[1:], line("└", "┴", "┘"), *more])

    def show(self, max_rows: int = 10) -> None:
        print(self.show_string(max_rows))

    # -- projection

    def select(self, *names: str) -> Frame:
        if not names:
            raise EngineError(ErrorCode.EmptySchema)
        self._known(*names)
        if len(set(names)) < len(names):
            raise EngineError(ErrorCode.DuplicateColumn)
        return Frame(self.df.select(*[self._col(n) for n in names]))

    def select_as(self, specs: list) -> Frame:
        """(source, target) pairs or {source, target} records."""
        pairs = [(s["source"], s.get("target") or s["source"]) if isinstance(s, dict) else s for s in specs]
        if not pairs:
            raise EngineError(ErrorCode.EmptySchema)
        self._known(*[s for s, _ in pairs])
        if len({t for _, t in pairs}) < len(pairs):
            raise EngineError(ErrorCode.DuplicateColumn)
        return Frame(self.df.select(*[self._col(s).alias(t) for s, t in pairs]))

    def drop(self, *names: str) -> Frame:
        left = [c for c in self.df.columns if c not in names]
        if not left:
            raise EngineError(ErrorCode.EmptySchema)
        return self.select(*left)

    def rename(self, mapping: dict[str, str]) -> Frame:
        return self.select_as([(c, mapping.get(c, c)) for c in self.df.columns])

    def with_column(self, name: str, expr: Expr) -> Frame:
        return self.with_columns({name: expr})

    def with_columns(self, specs) -> Frame:
        """All expressions see the columns as they were."""
        pairs, c = _pairs(specs), Compiler(self.df)
        if len({n for n, _ in pairs}) < len(pairs):
            raise EngineError(ErrorCode.DuplicateColumn)
        new = {n: c.value(e) for n, e in pairs}
        own = [new.pop(n).alias(n) if n in new else self._col(n) for n in self.df.columns]
        return Frame(self.df.select(*own, *[v.alias(n) for n, v in new.items()]))

    def apply_value(self, expr: Expr, name: str = "value") -> Frame:
        """The expression alone, as doubles: booleans are 0 and 1; nulls, texts and dates are NaN."""
        c = Compiler(self.df)
        x, kind = c.value(expr), c.kind(expr)
        number = x.cast("double") if is_numeric(kind) else x.cast("int").cast("double") if kind is Kind.Boolean else F.lit(None).cast("double")
        return Frame(self.df.select(F.coalesce(number, F.lit(float("nan"))).alias(name)))

    def explode(self, name: str) -> Frame:
        self._known(name)
        if not isinstance(self.df.schema[name].dataType, T.ArrayType):
            raise EngineError(ErrorCode.TypeMismatch, f"{name} is no array")
        return Frame(self.df.select(*[F.explode(self._col(n)).alias(n) if n == name else self._col(n) for n in self.df.columns]))

    # -- rows

    def filter(self, expr: Expr) -> Frame:
        return Frame(self.df.where(Compiler(self.df).predicate(expr)))

    where = filter

    def filter_rows(self, test: Callable, *names: str) -> Frame:
        """Rows for which test, given pandas series of the named columns, is true; in Arrow batches."""
        self._known(*names)
        return Frame(self.df.where(F.pandas_udf(test, T.BooleanType())(*[self._col(n) for n in names])))

    def count_matching(self, expr: Expr) -> int:
        return self.filter(expr).count()

    def limit(self, n: int) -> Frame:
        if n < 0:
            raise EngineError(ErrorCode.InvalidPipeline, f"limit {n}")
        return Frame(self.df.limit(n))

    def head(self, n: int = 5) -> Frame:
        return self.limit(n)

    def slice(self, start: int, n: int) -> Frame:
        if start < 0:
            raise EngineError(ErrorCode.InvalidPipeline, f"slice from {start}")
        return Frame(self.df.offset(start).limit(n))

    def tail(self, n: int = 5, order_by: str | None = None) -> Frame:
        """The last n rows, in their order: by a column, or by their place in the scan.  A top-n, not a sort."""
        if order_by is not None:
            self._known(order_by)
            last = self.df.orderBy(F.desc_nulls_first(self._col(order_by))).limit(n)
            return Frame(last.orderBy(F.asc_nulls_last(self._col(order_by))))
        placed = self.df.withColumn("__place", F.monotonically_increasing_id())
        return Frame(placed.orderBy(F.desc("__place")).limit(n).orderBy("__place").drop("__place"))

    def sort(self, keys) -> Frame:
        keys = [k if isinstance(k, SortKey) else SortKey(k) for k in ([keys] if isinstance(keys, (str, SortKey)) else keys)]
        if not keys:
            raise EngineError(ErrorCode.InvalidExpression, "no sort keys")
        self._known(*[k.column for k in keys])
        out = []
        for k in keys:
            c = F.collate(self._col(k.column), k.collation) if k.collation else self._col(k.column)
            out.append({(0, 0): F.asc_nulls_last, (0, 1): F.asc_nulls_first, (1, 0): F.desc_nulls_last, (1, 1): F.desc_nulls_first}[k.descending, k.nulls_first](c))
        return Frame(self.df.orderBy(*out))

    order_by = sort

    # -- aggregation

    def agg(self, specs, order_by=None) -> Frame:
        """One row, also of no rows.  order_by: the columns that first and last go by."""
        return Frame(self.df.agg(*_aggregates(self.df, specs, order_by, [])))

    def group_by(self, keys, specs=None, order_by=None):
        keys = _list(keys)
        if not keys:
            raise EngineError(ErrorCode.EmptySchema, "no group keys")
        self._known(*keys)
        grouped = Grouped(self.df, keys)
        return grouped if specs is None else grouped.agg(specs, order_by)

    def min(self, name: str):
        return self._scalar("min", name)

    def max(self, name: str):
        return self._scalar("max", name)

    def mean(self, name: str):
        return self._scalar("avg", name)

    def _scalar(self, op: str, name: str):
        return self.df.agg(Compiler(self.df).aggregate(Expr(op, col(name)))).first()[0]

    def describe(self) -> dict[str, dict[str, float]]:
        """count, mean, std, min and max of every numeric column, in one pass."""
        names = [n for n in self.df.columns if is_numeric(self._kind(n))]
        if not names:
            return {}
        row = self.describe_frame().df.collect()
        return {r["column"]: {k: r[k] for k in ("count", "mean", "std", "min", "max")} for r in row}

    def describe_frame(self) -> Frame:
        names = [n for n in self.df.columns if is_numeric(self._kind(n))]
        if not names:
            raise EngineError(ErrorCode.EmptySchema, "no numeric columns")
        c = {n: self._col(n).cast("double") for n in names}
        each = [F.struct(F.lit(n).alias("column"), F.count(c[n]).alias("count"), F.avg(c[n]).alias("mean"), F.stddev(c[n]).alias("std"), F.min(c[n]).alias("min"), F.max(c[n]).alias("max")) for n in names]
        return Frame(self.df.agg(F.array(*each).alias("a")).select(F.explode("a").alias("r")).select("r.*"))

    # -- cleaning

    def cast(self, name: str, dtype: DType) -> Frame:
        return self._replace(name, cast(self._col(name), self._kind(name), dtype.kind), {"kind": dtype.kind.value})

    def _replace(self, name: str, value: Column, metadata: dict | None = None) -> Frame:
        return Frame(self.df.select(*[(value.alias(n, metadata=metadata) if metadata else value.alias(n)) if n == name else self._col(n) for n in self.df.columns]))

    def fill_null(self, name: str, value) -> Frame:
        kind = self._kind(name)
        fits = isinstance(value, str) if kind is Kind.String else isinstance(value, bool) if kind is Kind.Boolean else not isinstance(value, (str, bool)) if is_numeric(kind) else True
        if value is None or not fits:
            raise EngineError(ErrorCode.InvalidFillValue, f"{value!r} in {kind}")
        return self._replace(name, F.coalesce(self._col(name), F.lit(value).cast(self.df.schema[name].dataType)))

    def fill_null_forward(self, name: str, order_by: str, partition_by=None) -> Frame:
        self._known(name, order_by, *_list(partition_by or []))
        return Frame(cleaning.fill_along(self.df, name, order_by, _list(partition_by or []), False))

    def fill_null_backward(self, name: str, order_by: str, partition_by=None) -> Frame:
        self._known(name, order_by, *_list(partition_by or []))
        return Frame(cleaning.fill_along(self.df, name, order_by, _list(partition_by or []), True))

    def drop_null(self, names=None) -> Frame:
        names = self.df.columns if names is None else _list(names)
        self._known(*names)
        return Frame(cleaning.drop_null(self.df, names))

    def count_nulls(self) -> Frame:
        """One row: the nulls of every column."""
        return Frame(self.df.agg(*[F.count_if(self._col(n).isNull()).alias(n) for n in self.df.columns]))

    def has_any_null(self, names=None) -> bool:
        names = self.df.columns if names is None else _list(names)
        self._known(*names)
        test = F.lit(False)
        for n in names:
            test = test | self._col(n).isNull()
        return not self.df.where(test).isEmpty()

    def unique(self, names=None, keep_first: bool = True, order_by: str | None = None) -> Frame:
        """One row for each key (all columns: each distinct row); nulls are equal."""
        if names is None:
            return Frame(self.df.distinct())
        names = _list(names)
        self._known(*names, *([order_by] if order_by else []))
        return Frame(cleaning.keep_one(self.df, names, self._col(order_by) if order_by else None, not keep_first))

    drop_duplicates = unique
    distinct = unique

    def count_unique(self, name: str) -> int:
        self._known(name)
        return self.df.agg(cleaning.count_unique(name)).first()[0]

    # -- text

    def _text(self, name: str, f: Callable[[Column], Column]) -> Frame:
        if self._kind(name) is not Kind.String:
            raise EngineError(ErrorCode.TypeMismatch, name)
        return self._replace(name, f(self._col(name)))

    def trim(self, name: str) -> Frame:
        return self._text(name, strings.trim)

    def lower(self, name: str) -> Frame:
        return self._text(name, F.lower)

    def upper(self, name: str) -> Frame:
        return self._text(name, F.upper)

    def replace(self, name: str, pattern: str, replacement: str, every: bool = True) -> Frame:
        return self._text(name, lambda c: strings.replace(c, pattern, replacement, every))

    def pad(self, name: str, length: int, fill: str = " ", side: str = "left") -> Frame:
        return self._text(name, lambda c: strings.pad(c, length, fill, side))

    def substring(self, name: str, start: int, length: int | None = None) -> Frame:
        return self._text(name, lambda c: strings.substring(c, start, length))

    # -- joins and unions

    def join(self, other: Frame, left_on, right_on=None, how: str | None = None, suffix: str = "_right") -> Frame:
        return Frame(equi_join(self.df, other.df, left_on, right_on, how or "left", suffix))

    def inner_join(self, other: Frame, left_on, right_on=None, suffix: str = "_right") -> Frame:
        return self.join(other, left_on, right_on, "inner", suffix)

    def left_join(self, other: Frame, left_on, right_on=None, suffix: str = "_right") -> Frame:
        return self.join(other, left_on, right_on, "left", suffix)

    def right_join(self, other: Frame, left_on, right_on=None, suffix: str = "_right") -> Frame:
        return self.join(other, left_on, right_on, "right", suffix)

    def semi_join(self, other: Frame, on) -> Frame:
        return self.join(other, on, None, "semi")

    def anti_join(self, other: Frame, on) -> Frame:
        return self.join(other, on, None, "anti")

    def cross_join(self, other: Frame, suffix: str = "_right") -> Frame:
        return Frame(cross_join(self.df, other.df, suffix))

    def concat(self, other: Frame) -> Frame:
        """All rows of both; names and kinds must agree, nullability need not."""
        mine, theirs = ([(f.name, kind_of(f) or f.dataType) for f in x.df.schema.fields] for x in (self, other))
        if mine != theirs:
            raise EngineError(ErrorCode.SchemaMismatch, f"{mine} and {theirs}")
        return Frame(self.df.union(other.df))

    union = concat

    def pipe(self, f: Callable, *args, **more):
        return f(self, *args, **more)


class Grouped:
    def __init__(self, df: DataFrame, keys: list[str]):
        self.df, self.keys = df, keys

    def agg(self, specs, order_by=None) -> Frame:
        columns = _aggregates(self.df, specs, order_by, self.keys)
        return Frame(self.df.groupBy(*[F.col(f"`{k}`") for k in self.keys]).agg(*columns))

    def count(self) -> Frame:
        return self.agg([("count", Expr("count"))])

    def min(self, name: str) -> Frame:
        return self.agg([(f"min({name})", Expr("min", col(name)))])

    def max(self, name: str) -> Frame:
        return self.agg([(f"max({name})", Expr("max", col(name)))])

    def mean(self, name: str) -> Frame:
        return self.agg([(f"mean({name})", Expr("avg", col(name)))])

    def sum(self, name: str) -> Frame:
        return self.agg([(f"sum({name})", Expr("sum", col(name)))])


def _aggregates(df: DataFrame, specs, order_by, keys: list[str]) -> list[Column]:
    pairs, c = _pairs(specs), Compiler(df)
    if not pairs:
        raise EngineError(ErrorCode.InvalidAggregation, "nothing to aggregate")
    names = [*keys, *[n for n, _ in pairs]]
    if len(set(names)) < len(names):
        raise EngineError(ErrorCode.DuplicateColumn)
    order = [F.col(f"`{o}`") for o in _list(order_by)] if order_by else None
    return [c.aggregate(e, order).alias(n) for n, e in pairs]


def concat(a: Frame, b: Frame) -> Frame:
    return a.concat(b)


def inner_join(a: Frame, b: Frame, left_on, right_on=None, suffix: str = "_right") -> Frame:
    return a.inner_join(b, left_on, right_on, suffix)


def left_join(a: Frame, b: Frame, left_on, right_on=None, suffix: str = "_right") -> Frame:
    return a.left_join(b, left_on, right_on, suffix)


