"""Feldspar: a strictly validated DataFrame API that compiles to Spark SQL plans."""

from . import functions, types
from .errors import EngineError, ErrorCode, error_message
from .functions import (
    Expr,
    add,
    and_,
    avg,
    coalesce,
    col,
    count,
    div,
    first,
    format_expr,
    is_arithmetic,
    is_cast,
    is_column,
    is_comparison,
    is_literal,
    is_predicate,
    last,
    lit,
    max_,
    min_,
    mod,
    mul,
    neg,
    not_,
    or_,
    sub,
    sum_,
    typed_lit,
)
from .operators import Frame, Grouped, SortKey, agg, asc, concat, desc, inner_join, left_join
from .plans.compiler import Compiler, compile_predicate, compile_value, infer_expr_type, validate_expr
from .plans.pipeline import Pipeline, PipelineBuilder, from_schema
from .schema import Schema
from .sources import CsvParser, CsvSource, empty, from_batches, from_columns, from_csv_string, from_records, parquet_schema, read_csv, read_parquet
from .types import DType, Kind

__all__ = [n for n in dir() if not n.startswith("_")]
