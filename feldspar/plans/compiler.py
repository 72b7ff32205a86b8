"""From expression trees to Spark columns.

Predicates have two values.  In positive places a bare comparison does: SQL's unknown drops the row as false would, and
Parquet gets the filter.  Under a negation it goes down by De Morgan's rules, where a comparison's opposite also holds for
nulls.  Arithmetic works in the promoted kind and yields null instead of errors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError, ErrorCode
from ..functions import Expr, is_aggregate, is_predicate
from ..types import FLOAT64, FLOATS, INT32, INT64, DType, Kind, is_integer, is_numeric, kind_of, promote

_OPPOSITE = {"lt": "gte", "lte": "gt", "gt": "lte", "gte": "lt"}
_TRUE, _FALSE = ("true", "1", "yes", "y", "on"), ("false", "0", "no", "n", "off")


class Compiler:
    """Compiles against the columns of one DataFrame."""

    def __init__(self, df: DataFrame):
        self.kinds = {f.name: kind_of(f) for f in df.schema.fields}

    # -- kinds

    def kind(self, e: Expr) -> Kind | None:
        """The kind of the value; None beyond the fourteen kinds."""
        a = e.args
        if e.op == "col":
            if a[0] not in self.kinds:
                raise EngineError(ErrorCode.UnknownColumn, a[0])
            return self.kinds[a[0]]
        if e.op == "lit":
            return self.literal(a[0], a[1]).kind
        if e.op in ("add", "sub", "mul", "div", "mod"):
            return promote(self.kind(a[0]), self.kind(a[1]))
        if e.op == "neg":
            k = self.kind(a[0])
            if not is_numeric(k):
                raise EngineError(ErrorCode.TypeIncompatible, f"neg of {k}")
            return k
        if e.op == "cast":
            return a[1].kind
        if e.op in ("coalesce", "alias", "min", "max", "first", "last"):
            if not a:
                raise EngineError(ErrorCode.InvalidExpression, e.op)
            return self.kind(a[0])
        if e.op in ("sum", "avg"):
            k = self.kind(a[0])
            if not is_numeric(k):
                raise EngineError(ErrorCode.TypeIncompatible, f"{e.op} of {k}")
            return Kind.Float64
        if e.op == "count":
            for x in a:
                self.kind(x)
            return Kind.Int64
        for x in a:
            if isinstance(x, Expr):
                self.kind(x)
        return Kind.Boolean

    @staticmethod
    def literal(value, dtype: DType | None) -> DType:
        if dtype is not None:
            return dtype
        if isinstance(value, bool):
            return DType(Kind.Boolean)
        if isinstance(value, int):
            return INT32 if -(2**31) <= value < 2**31 else INT64
        if isinstance(value, float):
            return INT32 if value.is_integer() and abs(value) < 2**31 else FLOAT64
        if isinstance(value, str):
            return DType(Kind.String)
        if value is None:
            return INT32.to_nullable()
        import datetime

        if isinstance(value, datetime.datetime):
            return DType(Kind.Timestamp)
        if isinstance(value, datetime.date):
            return DType(Kind.Date)
        raise EngineError(ErrorCode.InvalidExpression, f"literal {value!r}")

    # -- values

    def value(self, e: Expr) -> Column:
        self.kind(e)
        return self._value(e)

    def _value(self, e: Expr) -> Column:
        a = e.args
        if e.op == "col":
            return F.col(f"`{a[0]}`")
        if e.op == "lit":
            t = self.literal(a[0], a[1])
            return F.lit(a[0]) if t.kind in (Kind.String, Kind.Boolean, Kind.Date, Kind.Timestamp) and a[0] is not None else F.lit(a[0]).cast(t.spark)
        if e.op == "alias":
            return self._value(a[0])
        if e.op == "coalesce":
            return F.coalesce(*[self._value(x) for x in a])
        if e.op == "cast":
            return cast(self._value(a[0]), self.kind(a[0]), a[1].kind)
        if e.op == "neg":
            x = self._value(a[0])
            return F.negative(x) if self.kind(a[0]) in FLOATS else F.try_subtract(F.lit(0).cast(DType(self.kind(a[0])).spark), x)
        if e.op in ("add", "sub", "mul", "div", "mod"):
            kind = self.kind(e)
            to = DType(kind).spark
            x, y = (self._value(v).cast(to) for v in a)
            if e.op == "div":
                if kind in FLOATS:
                    return F.try_divide(x, y).cast(to)
                return F.call_function("div", x, F.nullif(y, F.lit(0).cast(to))).try_cast(to)
            f = {"add": F.try_add, "sub": F.try_subtract, "mul": F.try_multiply, "mod": F.try_mod}[e.op]
            return f(x, y).try_cast(to)
        if is_predicate(e):
            return F.coalesce(self._predicate(e, False), F.lit(False))
        raise EngineError(ErrorCode.InvalidExpression, f"{e.op} as a value")

    # -- predicates

    def predicate(self, e: Expr) -> Column:
        """For a filter: true, or else false or unknown."""
        self.kind(e)
        return self._predicate(e, False)

    def _predicate(self, e: Expr, negated: bool) -> Column:
        a, op = e.args, e.op
        if op == "not":
            return self._predicate(a[0], not negated)
        if op in ("and", "or"):
            parts = [self._predicate(x, negated) for x in a]
            if (op == "and") != negated:
                return reduce(lambda x, y: x & y, parts, F.lit(True)) if not parts else reduce(lambda x, y: x & y, parts)
            return reduce(lambda x, y: x | y, parts) if parts else F.lit(False)
        if op == "alias":
            return self._predicate(a[0], negated)
        if op in ("eq", "neq"):
            same = self._value(a[0]).eqNullSafe(self._value(a[1]))
            return same if (op == "eq") != negated else ~same
        if op in _OPPOSITE:
            x, y = self._value(a[0]), self._value(a[1])
            if not negated:
                return _compare(op, x, y)
            return _compare(_OPPOSITE[op], x, y) | x.isNull() | y.isNull()
        if op == "between":
            x, low, high = (self._value(v) for v in a)
            if not negated:
                return x.between(low, high)
            return (x < low) | (x > high) | x.isNull() | low.isNull() | high.isNull()
        if op in ("is_null", "is_not_null"):
            x = self._value(a[0])
            return x.isNull() if (op == "is_null") != negated else x.isNotNull()
        if op in ("contains", "starts_with", "ends_with"):
            if self.kind(a[0]) is not Kind.String:
                raise EngineError(ErrorCode.TypeMismatch, f"{op} on {self.kind(a[0])}")
            x = self._value(a[0])
            p = {"contains": x.contains, "starts_with": x.startswith, "ends_with": x.endswith}[op](a[1])
            return ~F.coalesce(p, F.lit(False)) if negated else p
        if op == "lit":
            return F.lit(bool(a[0]) != negated)
        if self.kind(e) is not Kind.Boolean:
            raise EngineError(ErrorCode.InvalidExpression, f"{op} as a predicate")
        x = self._value(e)
        return ~F.coalesce(x, F.lit(False)) if negated else x

    # -- aggregates

    def aggregate(self, e: Expr, order: list[Column] | None = None) -> Column:
        """order: what first and last go by; without it, the order in which Spark happens to see the rows."""
        while e.op == "alias":
            e = e.args[0]
        if not is_aggregate(e):
            raise EngineError(ErrorCode.InvalidAggregation, e.op)
        kind = self.kind(e)
        if e.op == "count":
            return F.count(self._value(e.args[0]) if e.args else F.lit(1))
        x = self._value(e.args[0])
        if e.op == "sum":
            return F.sum(x.cast("double"))
        if e.op == "avg":
            return F.avg(x.cast("double"))
        if e.op in ("min", "max"):
            x = F.when(~F.isnan(x), x) if kind in FLOATS and self.kinds_are_float(e.args[0]) else x
            return F.min(x) if e.op == "min" else F.max(x)
        if order:
            by = F.when(x.isNotNull(), F.struct(*order))
            return F.min_by(x, by) if e.op == "first" else F.max_by(x, by)
        return F.first(x, ignorenulls=True) if e.op == "first" else F.last(x, ignorenulls=True)

    def kinds_are_float(self, e: Expr) -> bool:
        return self.kind(e) in FLOATS


def compile_predicate(e: Expr, df: DataFrame) -> Column:
    return Compiler(df).predicate(e)


def compile_value(e: Expr, df: DataFrame) -> Column:
    return Compiler(df).value(e)


def infer_expr_type(e: Expr, df: DataFrame) -> Kind | None:
    return Compiler(df).kind(e)


def validate_expr(e: Expr, df: DataFrame) -> EngineError | None:
    """What is wrong with the expression against these columns; None if nothing is."""
    try:
        Compiler(df).kind(e)
    except EngineError as found:
        return found
    return None


def _compare(op: str, x: Column, y: Column) -> Column:
    return {"lt": x < y, "lte": x <= y, "gt": x > y, "gte": x >= y}[op]


def cast(x: Column, source: Kind | None, target: Kind) -> Column:
    """Null where a value can't be had in the target kind; whole numbers from text and floats cut off towards zero."""
    to = DType(target).spark
    if source is target:
        return x
    if source is Kind.String:
        s = F.trim(x)
        if target is Kind.Boolean:
            low = F.lower(s)
            return F.when(low.isin(*_TRUE), True).when(low.isin(*_FALSE), False)
        if target is Kind.Timestamp:
            return F.try_to_timestamp(s)
        if is_integer(target):
            return F.coalesce(s.try_cast(to), _whole(s.try_cast("double"), to))
        return s.try_cast(to)
    if source in (Kind.Date, Kind.Timestamp) and is_numeric(target) or is_numeric(source) and target in (Kind.Date, Kind.Timestamp):
        if source is Kind.Timestamp:
            return F.unix_millis(x.cast("timestamp")).try_cast(to)
        if source is Kind.Date:
            return F.unix_date(x).try_cast(to)
        return F.timestamp_millis(x.try_cast("bigint")) if target is Kind.Timestamp else F.date_from_unix_date(x.try_cast("int"))
    if target is Kind.Boolean:
        if not is_numeric(source):
            raise EngineError(ErrorCode.CastNotSupported, f"{source} to {target}")
        return x != 0
    if target is Kind.String and source in FLOATS:
        whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
        return F.when(whole, x.try_cast("bigint").cast("string")).otherwise(x.cast("string"))
    if is_integer(target) and source in FLOATS:
        return _whole(x, to)
    return x.try_cast(to)


def _whole(x: Column, to) -> Column:
    return F.when(~F.isnan(x), x).try_cast(to)
