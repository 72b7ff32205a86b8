"""Connected components of a distributed graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, written


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) with u > v, distinct.  Large: every node's larger neighbours link to the smallest of its
    neighbourhood.  Small: its smaller neighbours and itself do.  A hub's rows meet only in sums and in a
    join that adaptive execution can split."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Of edges (u, v) over orderable ids: (id, component) for every node that isn't its component's smallest.
    Loops and repeated edges don't matter; each round is written to the shared folder, the last one remains there."""
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges")
    state = _state(now)
    while state[0]:
        new = written(_star(_star(now, True), False), "edges")
        after = _state(new)
        remove(now)
        now = new
        if after == state:
            break
        state = after
    out = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    out._feldspar_path = now._feldspar_path
    return out
