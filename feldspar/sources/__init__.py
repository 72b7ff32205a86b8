"""Typed sources: CSV files and strings, records, columns, Parquet."""

from __future__ import annotations

import codecs
import csv
import io
import re
from collections.abc import Iterable
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError, ErrorCode
from ..operators import Frame
from ..plans.compiler import cast
from ..schema import Schema
from ..types import FLOATS, DType, Kind, is_integer


def _session(spark: SparkSession | None) -> SparkSession:
    return spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def _default(t: DType) -> Column | None:
    """What an empty cell of a column without nulls holds; dates have no such value."""
    if t.kind is Kind.String:
        return F.lit("")
    if t.kind is Kind.Timestamp:
        return F.timestamp_millis(F.lit(0).cast("long"))
    return None if t.kind is Kind.Date else F.lit(0).cast(t.spark)


def _parsed(c: Column, t: DType) -> Column:
    """A CSV cell: trimmed; empty is null, or the default of a column without nulls; whole numbers have digits only; true begins
    with 1, t or y.  What can't be read is null."""
    s = F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    s = F.nullif(s, F.lit(""))
    if t.kind is Kind.String:
        out = s
    elif t.kind is Kind.Boolean:
        out = F.when(s.isNotNull(), F.lower(F.substring(s, 1, 1)).isin("1", "t", "y"))
    elif is_integer(t.kind):
        out = F.when(s.rlike(r"^[+-]?[0-9]+$"), s).try_cast(t.spark)
    elif t.kind is Kind.Timestamp:
        out = F.try_to_timestamp(s)
    else:
        out = cast(s, Kind.String, t.kind)
    default = None if t.nullable else _default(t)
    return out if default is None else F.when(s.isNull(), default).otherwise(out)


def _typed(raw: DataFrame, schema: Schema, projection: list[int] | None) -> DataFrame:
    keep = range(len(schema.columns)) if projection is None else projection
    out = []
    for i in keep:
        name, t = schema.at(i)
        out.append(_parsed(F.col(raw.columns[i]), t).alias(name, metadata={"kind": t.kind.value}))
    return raw.select(*out)


def read_csv(path, schema: Schema | dict, delimiter: str = ",", quote: str = '"', has_header: bool = True, skip_rows: int = 0, max_rows: int | None = None, projection: list[int] | None = None, spark: SparkSession | None = None, multi_line: bool = False) -> Frame:
    """A lazy scan.  Columns map by position, the header's names don't matter; short rows end in nulls, what
    long rows have more is left out; blank lines are no rows.  skip_rows skips data rows of a single file.  Files split
    over tasks unless multi_line says that quoted cells hold line ends."""
    schema = schema if isinstance(schema, Schema) else Schema(schema)
    text = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(schema.columns))])
    reader = _session(spark).read.schema(text).option("sep", delimiter[:1]).option("quote", quote[:1]).option("escape", quote[:1]).option("header", has_header).option("enforceSchema", True).option("mode", "PERMISSIVE").option("multiLine", multi_line)
    raw = reader.csv(path)
    if skip_rows:
        raw = raw.offset(skip_rows)
    if max_rows is not None:
        raw = raw.limit(max_rows)
    return Frame(_typed(raw, schema, projection))


def from_csv_string(text: str, schema: Schema | dict, delimiter: str = ",", quote: str = '"', has_header: bool = True, skip_rows: int = 0, max_rows: int | None = None, projection: list[int] | None = None, spark: SparkSession | None = None) -> Frame:
    """The same of a string; quoted cells may hold line ends."""
    parser = CsvParser(schema, delimiter, quote, has_header, skip_rows, max_rows, projection, spark)
    parts = [f for f in (parser.parse(text), parser.finish()) if f is not None]
    return parts[0] if len(parts) == 1 else parts[0].concat(parts[1]) if parts else parser.frame([])


class CsvParser:
    """Text that comes in pieces, cut anywhere: parse() gives the rows that are complete so far, finish() a last one without a line
    end, None where there are none.  A line end inside quotes ends no row."""

    def __init__(self, schema: Schema | dict, delimiter: str = ",", quote: str = '"', has_header: bool = True, skip_rows: int = 0, max_rows: int | None = None, projection: list[int] | None = None, spark: SparkSession | None = None):
        self.schema = schema if isinstance(schema, Schema) else Schema(schema)
        self.delimiter, self.quote, self.skip, self.max_rows, self.projection, self.spark = delimiter[:1], quote[:1], int(has_header) + skip_rows, max_rows, projection, spark
        self.reset()

    def reset(self) -> None:
        """Forgets all text and starts anew, with the header."""
        self._left, self._skipped, self._given, self._decoder = "", 0, 0, codecs.getincrementaldecoder("utf-8")("replace")

    def parse(self, piece: str | bytes) -> Frame | None:
        self._left += piece if isinstance(piece, str) else self._decoder.decode(piece)
        end = quoted = 0
        for m in re.finditer(rf"{re.escape(self.quote)}|\n|\r(?!\n|\Z)" if self.quote else r"\n|\r(?!\n|\Z)", self._left):
            if m[0] == self.quote:
                quoted ^= 1
            elif not quoted:
                end = m.end()
        done, self._left = self._left[:end], self._left[end:]
        return self._rows(done)

    def finish(self) -> Frame | None:
        done, self._left = self._left + self._decoder.decode(b"", True), ""
        return self._rows(done)

    def _rows(self, text: str) -> Frame | None:
        rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=self.delimiter, quotechar=self.quote or None, quoting=csv.QUOTE_MINIMAL if self.quote else csv.QUOTE_NONE) if r]
        over = min(len(rows), self.skip - self._skipped)
        self._skipped += over
        rows = rows[over:]
        if self.max_rows is not None:
            rows = rows[: self.max_rows - self._given]
        self._given += len(rows)
        return self.frame(rows) if rows else None

    def frame(self, rows: list[list[str]]) -> Frame:
        n = len(self.schema.columns)
        cells = [tuple((r + [None] * n)[:n]) for r in rows]
        raw = _session(self.spark).createDataFrame(cells, T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(n)]))
        return Frame(_typed(raw, self.schema, self.projection))


class CsvSource:
    """A CSV file or text with its schema and options: as a lazy frame, as all rows at once, or as batches."""

    def __init__(self, make):
        self._make = make

    @staticmethod
    def from_file(path, schema: Schema | dict, **options) -> CsvSource:
        return CsvSource(lambda: read_csv(path, schema, **options))

    @staticmethod
    def from_string(text: str, schema: Schema | dict, **options) -> CsvSource:
        return CsvSource(lambda: from_csv_string(text, schema, **options))

    def frame(self) -> Frame:
        return self._make()

    def collect(self) -> Frame:
        return self._make().collect()

    def batches(self) -> list:
        return self._make().batches()

    def rows(self):
        return self._make().rows()


def _fit(value: Any, t: DType) -> Any:
    """Whole numbers as the column's type asks for them."""
    if isinstance(value, int) and not isinstance(value, bool):
        return float(value) if t.kind in FLOATS else Decimal(value) if t.kind is Kind.UInt64 else value
    return value


def from_records(records: Iterable[dict[str, Any]], schema: Schema | dict, spark: SparkSession | None = None) -> Frame:
    """Values as they are; what a record lacks is null."""
    schema = schema if isinstance(schema, Schema) else Schema(schema)
    rows = [tuple(_fit(r.get(n), t) for n, t in schema.columns) for r in records]
    return Frame(_session(spark).createDataFrame(rows, schema.spark()))


def from_columns(columns: dict[str, list], schema: Schema | dict, spark: SparkSession | None = None) -> Frame:
    """Lists of equal length."""
    schema = schema if isinstance(schema, Schema) else Schema(schema)
    if len({len(columns.get(n, ())) for n in schema.names}) > 1 or set(columns) != set(schema.names):
        raise EngineError(ErrorCode.SchemaMismatch, "columns of equal length, one for each name")
    return Frame(_session(spark).createDataFrame(list(zip(*[[_fit(v, t) for v in columns[n]] for n, t in schema.columns])), schema.spark()))


def from_batches(batches: list, spark: SparkSession | None = None) -> Frame:
    """Arrow batches of one schema."""
    import pyarrow as pa

    return Frame(_session(spark).createDataFrame(pa.Table.from_batches(batches)))


def empty(schema: Schema | dict, spark: SparkSession | None = None) -> Frame:
    schema = schema if isinstance(schema, Schema) else Schema(schema)
    return Frame(_session(spark).createDataFrame([], schema.spark()))


def read_parquet(path, spark: SparkSession | None = None) -> Frame:
    """A lazy scan of files or folders, with Spark's pruning and pushdown."""
    return Frame(_session(spark).read.parquet(path))


def parquet_schema(path, spark: SparkSession | None = None) -> T.StructType:
    return _session(spark).read.parquet(path).schema
