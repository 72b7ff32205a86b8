"""Bounded chunked reading is what a Spark scan does anyway; for files that keep arriving, the same frames over
Structured Streaming.  Stateless methods of a Frame (filters, projections, text, casts) work on both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import Frame
from ..plans.pipeline import Pipeline
from ..schema import Schema


def stream_parquet(path: str, schema: Schema | None = None, spark: SparkSession | None = None) -> Frame:
    """Files of a folder as they arrive."""
    session = spark or SparkSession.getActiveSession()
    struct = schema.spark() if schema else session.read.parquet(path).schema
    return Frame(session.readStream.schema(struct).parquet(path))


def run_to_end(frame: Frame, out: str, checkpoint: str, pipeline: Pipeline | None = None) -> StreamingQuery:
    """All files that are there now, exactly once, into Parquet; a later call goes on from the checkpoint."""
    df: DataFrame = (pipeline(frame) if pipeline else frame).df
    query = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
