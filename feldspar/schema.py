"""Declared schemas: validated names, columns in order, and their Spark form."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from .errors import EngineError, ErrorCode
from .types import DType, kind_of

_NAME = re.compile(r"[a-zA-Z_][a-zA-Z0-9_]{0,255}\Z")


class Schema:
    """Ordered (name, DType) pairs; names are case-sensitive."""

    def __init__(self, columns: dict[str, DType] | list[tuple[str, DType]]):
        pairs = list(columns.items() if isinstance(columns, dict) else columns)
        if not pairs:
            raise EngineError(ErrorCode.EmptySchema)
        seen = set()
        for name, _ in pairs:
            if not _NAME.match(name):
                raise EngineError(ErrorCode.InvalidColumnName, name)
            if name in seen:
                raise EngineError(ErrorCode.DuplicateColumn, name)
            seen.add(name)
        self.columns = pairs

    def __eq__(self, other):
        return isinstance(other, Schema) and self.columns == other.columns

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.columns]

    def index(self, name: str) -> int:
        if name not in self.names:
            raise EngineError(ErrorCode.UnknownColumn, name)
        return self.names.index(name)

    def has(self, name: str) -> bool:
        return name in self.names

    def get(self, name: str) -> DType:
        return self.columns[self.index(name)][1]

    def at(self, index: int) -> tuple[str, DType]:
        if not 0 <= index < len(self.columns):
            raise EngineError(ErrorCode.UnknownColumn, str(index))
        return self.columns[index]

    def select(self, *names: str) -> Schema:
        return Schema([(n, self.get(n)) for n in names])

    def rename(self, old: str, new: str) -> Schema:
        self.index(old)
        return Schema([(new if n == old else n, t) for n, t in self.columns])

    def add(self, name: str, dtype: DType) -> Schema:
        return Schema([*self.columns, (name, dtype)])

    def drop(self, *names: str) -> Schema:
        for n in names:
            self.index(n)
        return Schema([(n, t) for n, t in self.columns if n not in names])

    @property
    def row_size(self) -> int:
        return sum(t.size for _, t in self.columns)

    def format(self) -> str:
        return "\n".join(f"{n}: {t.name}" for n, t in self.columns)

    def spark(self) -> T.StructType:
        return T.StructType([T.StructField(n, t.spark, True, {"kind": t.kind.value}) for n, t in self.columns])

    @staticmethod
    def of(struct: T.StructType) -> Schema:
        """The declared form of a Spark schema whose types are among the kinds."""
        pairs = []
        for f in struct.fields:
            kind = kind_of(f)
            if kind is None:
                raise EngineError(ErrorCode.TypeMismatch, f"{f.name}: {f.dataType.simpleString()}")
            pairs.append((f.name, DType(kind, f.nullable)))
        return Schema(pairs)
