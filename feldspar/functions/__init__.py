"""Column expressions as a small tree, chainable and printable; compiled to Spark columns on use."""

from __future__ import annotations

from typing import Any

from ..types import DType

_COMPARE = {"eq": "=", "neq": "!=", "lt": "<", "lte": "<=", "gt": ">", "gte": ">="}
_ARITHMETIC = {"add": "+", "sub": "-", "mul": "*", "div": "/", "mod": "%"}
_STRING = ("contains", "starts_with", "ends_with")
_AGGREGATE = ("sum", "avg", "min", "max", "count", "first", "last")


class Expr:
    """A node: its operation and arguments (expressions or plain values)."""

    def __init__(self, op: str, *args: Any):
        self.op, self.args = op, args

    def __repr__(self) -> str:
        return format_expr(self)

    def __eq__(self, other):  # trees are compared as values; comparison in queries is eq()
        return isinstance(other, Expr) and (self.op, self.args) == (other.op, other.args)

    __hash__ = None

    def eq(self, other):
        return Expr("eq", self, lit_or(other))

    def neq(self, other):
        return Expr("neq", self, lit_or(other))

    def lt(self, other):
        return Expr("lt", self, lit_or(other))

    def lte(self, other):
        return Expr("lte", self, lit_or(other))

    def gt(self, other):
        return Expr("gt", self, lit_or(other))

    def gte(self, other):
        return Expr("gte", self, lit_or(other))

    def between(self, low, high):
        return Expr("between", self, lit_or(low), lit_or(high))

    def is_null(self):
        return Expr("is_null", self)

    def is_not_null(self):
        return Expr("is_not_null", self)

    def add(self, other):
        return Expr("add", self, lit_or(other))

    def sub(self, other):
        return Expr("sub", self, lit_or(other))

    def mul(self, other):
        return Expr("mul", self, lit_or(other))

    def div(self, other):
        return Expr("div", self, lit_or(other))

    def mod(self, other):
        return Expr("mod", self, lit_or(other))

    def neg(self):
        return Expr("neg", self)

    def contains(self, text: str):
        return Expr("contains", self, text)

    def starts_with(self, text: str):
        return Expr("starts_with", self, text)

    def ends_with(self, text: str):
        return Expr("ends_with", self, text)

    def cast(self, dtype: DType):
        return Expr("cast", self, dtype)

    def alias(self, name: str):
        """For reading only: the output's name is the one that the caller gives it."""
        return Expr("alias", self, name)

    __gt__, __ge__, __lt__, __le__ = gt, gte, lt, lte
    __add__, __sub__, __mul__, __truediv__, __mod__, __neg__ = add, sub, mul, div, mod, neg

    def __and__(self, other):
        return and_(self, other)

    def __or__(self, other):
        return or_(self, other)

    def __invert__(self):
        return not_(self)


def col(name: str) -> Expr:
    return Expr("col", name)


def lit(value: Any) -> Expr:
    return Expr("lit", value, None)


def typed_lit(value: Any, dtype: DType) -> Expr:
    return Expr("lit", value, dtype)


def lit_or(value: Any) -> Expr:
    return value if isinstance(value, Expr) else lit(value)


def col_or(value: Any) -> Expr:
    """Names stand for columns where a column is meant."""
    return value if isinstance(value, Expr) else col(value) if isinstance(value, str) else lit(value)


def and_(*parts: Expr) -> Expr:
    return Expr("and", *parts)


def or_(*parts: Expr) -> Expr:
    return Expr("or", *parts)


def not_(part: Expr) -> Expr:
    return Expr("not", part)


def add(a, b) -> Expr:
    return col_or(a).add(col_or(b))


def sub(a, b) -> Expr:
    return col_or(a).sub(col_or(b))


def mul(a, b) -> Expr:
    return col_or(a).mul(col_or(b))


def div(a, b) -> Expr:
    return col_or(a).div(col_or(b))


def mod(a, b) -> Expr:
    return col_or(a).mod(col_or(b))


def neg(a) -> Expr:
    return col_or(a).neg()


def coalesce(*parts) -> Expr:
    return Expr("coalesce", *[col_or(p) for p in parts])


def sum_(e) -> Expr:
    return Expr("sum", col_or(e))


def avg(e) -> Expr:
    return Expr("avg", col_or(e))


def min_(e) -> Expr:
    return Expr("min", col_or(e))


def max_(e) -> Expr:
    return Expr("max", col_or(e))


def first(e) -> Expr:
    return Expr("first", col_or(e))


def last(e) -> Expr:
    return Expr("last", col_or(e))


def count(e=None) -> Expr:
    """Rows, or rows where e is not null."""
    return Expr("count", *([] if e is None else [col_or(e)]))


def is_aggregate(e: Expr) -> bool:
    return e.op in _AGGREGATE


def is_column(e: Expr) -> bool:
    return e.op == "col"


def is_literal(e: Expr) -> bool:
    return e.op == "lit"


def is_comparison(e: Expr) -> bool:
    return e.op in _COMPARE


def is_arithmetic(e: Expr) -> bool:
    return e.op in _ARITHMETIC


def is_cast(e: Expr) -> bool:
    return e.op == "cast"


def is_predicate(e: Expr) -> bool:
    return e.op in (*_COMPARE, *_STRING, "between", "is_null", "is_not_null", "and", "or", "not")


def columns_of(e: Expr) -> set[str]:
    if e.op == "col":
        return {e.args[0]}
    return set().union(*(columns_of(a) for a in e.args if isinstance(a, Expr)), set())


def format_expr(e: Expr) -> str:
    a = [format_expr(x) if isinstance(x, Expr) else x for x in e.args]
    if e.op == "col":
        return f"col({a[0]})"
    if e.op == "lit":
        return repr(a[0])
    if e.op in _COMPARE or e.op in _ARITHMETIC:
        return f"({a[0]} {(_COMPARE | _ARITHMETIC)[e.op]} {a[1]})"
    if e.op in ("and", "or"):
        return "(" + f" {e.op.upper()} ".join(a) + ")"
    if e.op == "cast":
        return f"cast({a[0]} as {a[1].name})"
    if e.op == "count" and not a:
        return "count(*)"
    return f"{e.op}({', '.join(x if isinstance(e.args[i], Expr) else repr(x) for i, x in enumerate(a))})"
