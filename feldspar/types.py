"""The fourteen column kinds, their Spark types and the promotion of numbers."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import types as T

from .errors import EngineError, ErrorCode


class Kind(Enum):
    Int8, Int16, Int32, Int64 = "int8", "int16", "int32", "int64"
    UInt8, UInt16, UInt32, UInt64 = "uint8", "uint16", "uint32", "uint64"
    Float32, Float64 = "float32", "float64"
    Boolean, String, Date, Timestamp = "boolean", "string", "date", "timestamp"


#: Unsigned kinds widen to the next Spark type that holds them; fields keep the kind in their metadata.
SPARK = {
    Kind.Int8: T.ByteType(), Kind.Int16: T.ShortType(), Kind.Int32: T.IntegerType(), Kind.Int64: T.LongType(),
    Kind.UInt8: T.ShortType(), Kind.UInt16: T.IntegerType(), Kind.UInt32: T.LongType(), Kind.UInt64: T.DecimalType(20, 0),
    Kind.Float32: T.FloatType(), Kind.Float64: T.DoubleType(),
    Kind.Boolean: T.BooleanType(), Kind.String: T.StringType(), Kind.Date: T.DateType(), Kind.Timestamp: T.TimestampType(),
}
SIZES = {Kind.Int8: 1, Kind.UInt8: 1, Kind.Boolean: 1, Kind.Int16: 2, Kind.UInt16: 2, Kind.Int32: 4, Kind.UInt32: 4, Kind.Float32: 4, Kind.String: 4, Kind.Date: 4}
INTEGERS = (Kind.Int8, Kind.Int16, Kind.Int32, Kind.Int64, Kind.UInt8, Kind.UInt16, Kind.UInt32, Kind.UInt64)
FLOATS = (Kind.Float32, Kind.Float64)
#: From the strongest; what is left over (8 bits on both sides) becomes Int16.
ORDER = (Kind.Float64, Kind.Float32, Kind.Int64, Kind.UInt64, Kind.Int32, Kind.UInt32, Kind.Int16, Kind.UInt16)


@dataclass(frozen=True)
class DType:
    kind: Kind
    nullable: bool = False

    def to_nullable(self) -> DType:
        return DType(self.kind, True)

    @property
    def spark(self) -> T.DataType:
        return SPARK[self.kind]

    @property
    def size(self) -> int:
        return SIZES.get(self.kind, 8)

    @property
    def name(self) -> str:
        return self.kind.value + ("?" if self.nullable else "")


def is_integer(kind: Kind | None) -> bool:
    return kind in INTEGERS


def is_numeric(kind: Kind | None) -> bool:
    return kind in INTEGERS or kind in FLOATS


def is_bigint(kind: Kind | None) -> bool:
    return kind in (Kind.Int64, Kind.UInt64, Kind.Timestamp)


def promote(a: Kind | None, b: Kind | None) -> Kind:
    """The kind of arithmetic on both."""
    if not is_numeric(a) or not is_numeric(b):
        raise EngineError(ErrorCode.TypeIncompatible, f"{a} and {b}")
    return next((k for k in ORDER if k in (a, b)), Kind.Int16)


_KINDS = {"tinyint": Kind.Int8, "smallint": Kind.Int16, "int": Kind.Int32, "bigint": Kind.Int64, "float": Kind.Float32, "double": Kind.Float64, "boolean": Kind.Boolean, "string": Kind.String, "date": Kind.Date, "timestamp": Kind.Timestamp, "timestamp_ntz": Kind.Timestamp}


def kind_of(field: T.StructField) -> Kind | None:
    """The kind of a Spark field; None for types beyond the fourteen (arrays, structs, binaries)."""
    if "kind" in (field.metadata or {}):
        return Kind(field.metadata["kind"])
    if isinstance(field.dataType, T.DecimalType):
        return Kind.Float64
    return _KINDS.get(field.dataType.simpleString())


INT8, INT16, INT32, INT64 = (DType(k) for k in (Kind.Int8, Kind.Int16, Kind.Int32, Kind.Int64))
UINT8, UINT16, UINT32, UINT64 = (DType(k) for k in (Kind.UInt8, Kind.UInt16, Kind.UInt32, Kind.UInt64))
FLOAT32, FLOAT64, BOOLEAN, STRING, DATE, TIMESTAMP = (DType(k) for k in (Kind.Float32, Kind.Float64, Kind.Boolean, Kind.String, Kind.Date, Kind.Timestamp))
