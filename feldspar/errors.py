"""Error codes and the one exception that carries them."""

from __future__ import annotations

import re
from enum import IntEnum


class ErrorCode(IntEnum):
    """Fixed values, by bands: buffers, schemas, parsing, input and output, pipelines, expressions, casts."""

    None_ = 0
    BufferFull, BufferEmpty, BufferOverflow, InvalidOffset, InvalidCapacity, BufferUnderflow = range(1, 7)
    SchemaMismatch, UnknownColumn, TypeMismatch, DuplicateColumn, EmptySchema, InvalidColumnName = range(100, 106)
    MalformedData, InvalidUtf8, UnexpectedEof, InvalidNumber, InvalidBoolean, InvalidDate, UnterminatedQuote, TooManyColumns, TooFewColumns = range(200, 209)
    FileNotFound, ReadError, WriteError, PermissionDenied = range(300, 304)
    InvalidPipeline, ExecutionFailed, InvalidExpression, InvalidAggregation, EmptyInput = range(400, 405)
    DivisionByZero, ColumnNotFound, TypeIncompatible, InvalidOperand = range(500, 504)
    CastNotSupported, CastOverflow, InvalidFillValue = range(510, 513)


def error_message(code: int) -> str:
    """The code's name in words."""
    try:
        words = re.findall(r"[A-Z][a-z0-9]*", ErrorCode(code).name)
    except ValueError:
        return f"error {code}"
    return " ".join(words).capitalize() if code else "No error"


class EngineError(Exception):
    def __init__(self, code: ErrorCode, detail: str = ""):
        self.code = ErrorCode(code)
        super().__init__(f"{error_message(code)} ({int(code)})" + (f": {detail}" if detail else ""))
