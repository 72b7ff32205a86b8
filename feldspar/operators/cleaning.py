"""Nulls, duplicates and fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of the order column that a fill over a whole table is done in, at least and at most; between them two for
#: each shuffle partition.  BLOCK ranges are searched at once.
LEAST, MOST, BLOCK = 64, 4096, 64


def drop_null(df: DataFrame, names: list[str]) -> DataFrame:
    for n in names:
        df = df.where(F.col(f"`{n}`").isNotNull())
    return df


def keep_one(df: DataFrame, names: list[str], order: Column | None, last: bool) -> DataFrame:
    """One whole row for each key.  An aggregate, so that a key with very many rows is reduced before the
    shuffle; without an order the row's place in the scan decides."""
    if order is None:
        df = df.withColumn("__place", F.monotonically_increasing_id())
        order = F.col("__place")
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != "__place"])
    pick = (F.max_by if last else F.min_by)(row, order).alias("__row")
    keys = [F.col(f"`{n}`").alias(f"__k{i}") for i, n in enumerate(names)]
    return df.groupBy(*keys).agg(pick).select("__row.*")


def count_unique(name: str) -> Column:
    """Distinct values, null as one of them."""
    c = F.col(f"`{name}`")
    return (F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("int")), F.lit(0))).cast("bigint")


def _range_of(o: Column, cuts: list) -> Column:
    """How many cuts are below the value (-1 for null): first among every BLOCK-th cut, then in that block."""
    if not cuts:
        return F.lit(0)
    bounds = F.array(*[F.lit(c) for c in cuts])

    def below(a: Column) -> Column:
        return F.size(F.filter(a, lambda b: b < o))

    if len(cuts) <= BLOCK:
        found = below(bounds)
    else:
        block = below(F.array(*[F.lit(c) for c in cuts[BLOCK - 1 :: BLOCK]]))
        found = block * BLOCK + below(F.slice(bounds, block * BLOCK + 1, F.lit(BLOCK)))
    return F.when(o.isNotNull(), found).otherwise(-1)


def fill_along(df: DataFrame, name: str, order_by: str, partition_by: list[str] | None, backward: bool) -> DataFrame:
    """Each null takes the nearest earlier (or later) value in the order.

    With partition_by the fill is a window over each partition.  Over a whole table the order column is cut at
    quantiles: ranges are filled independently, and the value that enters a range comes from a table with a row for each
    range.  No window ever holds the whole table."""
    c, o = F.col(f"`{name}`"), F.col(f"`{order_by}`")

    def filled(part: list[Column]) -> Column:
        w = Window.partitionBy(*part).orderBy(o)
        if backward:
            return F.first(c, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
        return F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))

    if partition_by:
        return df.withColumn(name, filled([F.col(f"`{p}`") for p in partition_by]))
    ranges = min(MOST, max(LEAST, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    cuts = df.agg(F.percentile_approx(o, [i / ranges for i in range(1, ranges)])).first()[0] or []
    ranged = df.withColumn("__range", _range_of(o, sorted(set(cuts))))
    seen = F.when(c.isNotNull(), F.struct(o.alias("o")))
    edge = ranged.groupBy("__range").agg((F.min_by if backward else F.max_by)(c, seen).alias("__edge"))
    every = Window.orderBy("__range")  # over at most MOST + 1 rows
    if backward:
        entering = F.first("__edge", ignorenulls=True).over(every.rowsBetween(1, Window.unboundedFollowing))
    else:
        entering = F.last("__edge", ignorenulls=True).over(every.rowsBetween(Window.unboundedPreceding, -1))
    edge = edge.select(F.col("__range").alias("__r"), entering.alias("__edge"))
    out = ranged.join(F.broadcast(edge), F.col("__range") == F.col("__r"))  # MOST + 1 rows at most
    return out.withColumn(name, F.coalesce(filled([F.col("__range")]), F.col("__edge"))).select(*[F.col(f"`{x}`") for x in df.columns])
