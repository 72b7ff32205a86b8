"""Reusable pipelines: steps from frame to frame, checked against a schema when built."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession

from ..errors import EngineError, ErrorCode
from ..functions import Expr
from ..operators import Frame
from ..schema import Schema

Step = Callable[[Frame], Frame]


@dataclass
class Result:
    frame: Frame
    rows_in: int
    rows_out: int
    seconds: float


class Pipeline:
    def __init__(self, *steps: Step):
        if not steps:
            raise EngineError(ErrorCode.InvalidPipeline, "no steps")
        self.steps = steps

    def __call__(self, frame: Frame) -> Frame:
        for step in self.steps:
            frame = step(frame)
        return frame

    def execute(self, frame: Frame) -> Result:
        """Runs it, with counts and time."""
        t = time.time()
        out = self(frame).collect()
        return Result(out, frame.count(), out.count(), time.time() - t)


class PipelineBuilder:
    """The first error is kept, later calls do nothing, and build() raises it."""

    def __init__(self, schema: Schema, spark: SparkSession | None = None):
        session = spark or SparkSession.getActiveSession()
        self._frame = Frame(session.createDataFrame([], schema.spark()))
        self._steps: list[Step] = []
        self._error: EngineError | None = None

    def _add(self, step: Step) -> PipelineBuilder:
        if self._error is None:
            try:
                self._frame = step(self._frame)
                self._steps.append(step)
            except EngineError as e:
                self._error = e
        return self

    @property
    def columns(self) -> list[str]:
        return self._frame.column_names

    def filter(self, expr: Expr):
        return self._add(lambda f: f.filter(expr))

    def select(self, *names: str):
        return self._add(lambda f: f.select(*names))

    def select_as(self, specs: list):
        return self._add(lambda f: f.select_as(specs))

    def add_column(self, name: str, expr: Expr):
        return self._add(lambda f: f.with_column(name, expr))

    def with_columns(self, specs):
        return self._add(lambda f: f.with_columns(specs))

    def limit(self, n: int, offset: int = 0):
        return self._add(lambda f: f.slice(offset, n) if offset else f.limit(n))

    def aggregate(self, specs):
        return self._add(lambda f: f.agg(specs))

    def group_by(self, keys, specs):
        return self._add(lambda f: f.group_by(keys, specs))

    def sort(self, keys):
        return self._add(lambda f: f.sort(keys))

    def step(self, f: Step):
        return self._add(f)

    def build(self) -> Pipeline:
        if self._error is not None:
            raise self._error
        return Pipeline(*self._steps)

    def execute(self, frame: Frame) -> Result:
        return self.build().execute(frame)


def from_schema(schema: Schema, spark: SparkSession | None = None) -> PipelineBuilder:
    return PipelineBuilder(schema, spark)
