"""The Frame: the fluent, validated interface over a Spark DataFrame."""

from .frame import Frame, Grouped, SortKey, agg, asc, concat, desc, inner_join, left_join

__all__ = ["Frame", "Grouped", "SortKey", "agg", "asc", "concat", "desc", "inner_join", "left_join"]
