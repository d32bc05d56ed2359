"""Places and running totals in a global order, without a window over all rows.

Rows are dealt into ranges of the order, sorted within each, and written down with their place there. How many rows each
range has is a number per task; added up, these say where a range begins. A row's place is its range's begin and its own
place in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rentloom.sources.staging import materialize

# monotonically_increasing_id has the task above these bits, and the row's place in it below.
_BITS = 33


def _ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """The rows written in order, with __range and __at, the place within it from 0."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    return materialize(dealt, "ordered").withColumns({"__range": F.shiftright("__id", _BITS), "__at": F.col("__id").bitwiseAND(F.lit((1 << _BITS) - 1))}).drop("__id")


def _begins(ranges: DataFrame, weight: Column) -> DataFrame:
    """(__of, __before): a row per range, so as many as tasks."""
    totals = ranges.groupBy(F.col("__range").alias("__of")).agg(F.sum(weight).alias("__total"))
    earlier = W.partitionBy(F.lit(1)).orderBy("__of").rowsBetween(W.unboundedPreceding, -1)
    return totals.select("__of", F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__before"))


def numbered(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """All rows with their place in the order, from 1 on. The order has to tell all rows apart for the places to be the
    same each time; equal rows are dealt into one range."""
    ranges = _ranges(df, order)
    begins = F.broadcast(_begins(ranges, F.lit(1)))
    return ranges.join(begins, F.col("__range") == F.col("__of")).select(*df.columns, (F.col("__before") + F.col("__at") + 1).alias(name))


def running_total(df: DataFrame, order: list[Column], weight: str, name: str = "upto") -> DataFrame:
    """All rows with the sum of a column over the rows up to theirs."""
    ranges = _ranges(df, order)
    begins = F.broadcast(_begins(ranges, F.col(weight)))
    own = W.partitionBy("__range").orderBy("__at")
    return ranges.withColumn("__own", F.sum(weight).over(own)).join(begins, F.col("__range") == F.col("__of")).select(*df.columns, (F.col("__before") + F.col("__own")).alias(name))
