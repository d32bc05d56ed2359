"""Exact order statistics by multi-way selection.

Nothing is sorted as a whole. Rows are counted in bins, first by magnitude, and of each key only the bins that hold a
wanted rank are followed up: they are cut into WIDTH equal parts between their least and greatest value, counted again,
and so on, until such a bin has one value or SMALL rows at most, which are then looked at. A scan narrows a bin to about a
thousandth, so two or three do. What is sent between tasks are counts per bin, added up before they move, and at the end
a few bins of at most SMALL values each.

The steps run when a function is called; the numbers that it returns are small and part of the plan from then on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rentloom.operators.ordering import running_total
from rentloom.sources.staging import kept_small

SMALL = 1 << 16
WIDTH = 1 << 10


def _magnitude(v: Column) -> Column:
    """A number that never falls as v grows: sixteen parts for each power of two."""
    x, endless = v.cast("double"), F.lit(float("inf"))
    part = F.signum(x) * F.floor(F.log2(1 + F.abs(x)) * 16)
    return F.when(F.isnan(x), 30_001).when(F.abs(x) == endless, F.signum(x) * 30_000).otherwise(part).cast("int")


def _part(v: Column, low: Column, high: Column, width: int) -> Column:
    """Which of ``width`` equal parts of [low, high] a value is in; low and high are in the first and the last."""
    share = (v - low).cast("double") / (high - low).cast("double")
    return F.least(F.floor(share * width), F.lit(width - 1)).cast("int")


def _followed(bins: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of counted bins those that hold a wanted rank, with the ranks counted from the bin's begin."""
    own = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))).orderBy(order)
    before = bins.withColumn("__before", F.sum("n").over(own) - F.col("n"))
    here = lambda x: (x["rank"] >= F.col("__before")) & (x["rank"] < F.col("__before") + F.col("n"))
    want = F.transform(F.filter("want", here), lambda x: F.struct(x["t"].alias("t"), (x["rank"] - F.col("__before")).alias("rank")))
    return before.withColumn("want", want).where(F.size("want") > 0).drop("__before", order)


def order_statistics(df: DataFrame, value: str, ranks: Callable[[Column], list[Column]], by: list[str] | None = None, others: bool = False, small: int = SMALL, width: int = WIDTH) -> DataFrame:
    """(by, n, at): how many values there are, and those at the ranks that ``ranks`` gives for that number, from 0 on.

    Nulls are left out. With ``others`` the rows of a key are those that have any other key, or none. Without ``by`` there
    is one row; n is then 0 and at is empty where there are no values.
    """
    by = by or []
    keys = [f"__k{k}" for k in range(len(by))]
    kind = dict(df.dtypes)[value]
    v = F.col(value).cast("long" if kind in ("tinyint", "smallint", "int") else "double" if kind == "float" else kind)
    rows = df.where(F.col(value).isNotNull()).select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], v.alias("v"))
    of = [f"__of{k}" for k in range(len(by))]
    bins = rows.groupBy(*[F.col(k).alias(o) for k, o in zip(keys, of, strict=True)], _magnitude(F.col("v")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    if others:
        bins = kept_small(bins, "bins")
        # A row for each key and bin: keys are meant to be few.
        names = bins.where(F.col(of[0]).isNotNull()).select(F.col(of[0]).alias("__name")).distinct()
        bins = bins.join(names, ~F.col(of[0]).eqNullSafe(F.col("__name"))).groupBy(F.col("__name").alias(of[0]), "bin").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    bins = bins.withColumn("total", F.sum("n").over(W.partitionBy(*(of or [F.lit(1)]))))
    want = F.array(*[F.struct(F.lit(t).alias("t"), r.cast("long").alias("rank")) for t, r in enumerate(ranks(F.col("total")))])
    state = kept_small(_followed(bins.withColumn("want", want), of, "bin"), "bins")

    def met(state: DataFrame) -> DataFrame:
        same = F.col("v").between(F.col("low"), F.col("high"))
        for k, o in zip(keys, of, strict=True):
            equal = F.col(k).eqNullSafe(F.col(o))
            same = same & (~equal if others else equal)
        return rows.join(state, same)

    large = (F.col("low") < F.col("high")) & (F.col("n") > small)
    while not (open_ := state.where(large)).isEmpty():
        found = met(open_.drop("n")).groupBy(*of, "low", "high", _part(F.col("v"), F.col("low"), F.col("high"), width).alias("part"))
        parts = found.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("__low"), F.max("v").alias("__high"), F.first("want").alias("want"), F.first("total").alias("total"))
        narrow = _followed(parts, [*of, "low", "high"], "part").drop("low", "high").withColumnsRenamed({"__low": "low", "__high": "high"})
        state = kept_small(state.where(~large).unionByName(narrow), "bins")

    at = F.explode("want").alias("x")
    single = state.where(F.col("low") == F.col("high")).select(*of, "total", F.col("low").alias("v"), at).select(*of, "total", "x.t", "v")
    several = met(state.where(F.col("low") < F.col("high"))).groupBy(*of, "low", "high").agg(F.sort_array(F.collect_list("v")).alias("all"), F.first("want").alias("want"), F.first("total").alias("total"))
    several = several.select(*of, "total", "all", at).select(*of, "total", "x.t", F.get("all", F.col("x.rank").cast("int")).alias("v"))
    one = single.unionByName(several).groupBy(*of).agg(F.coalesce(F.max("total"), F.lit(0)).alias("n"), F.sort_array(F.collect_list(F.struct("t", "v"))).alias("at"))
    return kept_small(one.select(*[F.col(o).alias(b) for o, b in zip(of, by, strict=True)], "n", F.transform("at", lambda x: x["v"]).alias("at")), "statistics")


def exact_quantiles(df: DataFrame, value: str, points: list[float], by: list[str] | None = None, others: bool = False) -> DataFrame:
    """(by, q): exact quantiles of a column as an array, interpolated between neighbours, of all rows or per key; one row
    with nulls for no rows. ``others`` as for ``order_statistics``."""
    place = lambda n, p: (n - 1) * F.lit(float(p))
    found = order_statistics(df, value, lambda n: [f(place(n, p)) for p in points for f in (F.floor, F.ceil)], by, others)
    low, high = (lambda k: F.get("at", F.lit(2 * k)).cast("double")), (lambda k: F.get("at", F.lit(2 * k + 1)).cast("double"))
    between = [low(k) + (high(k) - low(k)) * (place(F.col("n"), p) - F.floor(place(F.col("n"), p))) for k, p in enumerate(points)]
    return found.select(*(by or []), F.array(*between).alias("q"))


def running_counts(df: DataFrame, value: str) -> DataFrame:
    """(v, n, upto): how many rows have each value, and how many that or a smaller one. Nulls are left out."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return running_total(counts, [F.col("v")], "n")


def mean_ranks(df: DataFrame, value: str) -> DataFrame:
    """(v, rank): each value's rank, the mean of those that its rows share."""
    return running_counts(df, value).select("v", (F.col("upto") - F.col("n") / 2 + 0.5).alias("rank"))
