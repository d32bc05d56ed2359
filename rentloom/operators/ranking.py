"""Listings scored by component, weighted and ranked."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rentloom.functions import numbers as N
from rentloom.operators import modelling as M
from rentloom.operators.ordering import numbered
from rentloom.sources.staging import SMALL_ROWS, kept_small

COMPONENTS = ["safety", "walk", "transit"]
SKY_PARTS = 24
BLOCK = 1024


def normal_weights(weights: dict[str, float]) -> dict[str, float]:
    """Negative and missing weights are 0, all zero is uniform; they add up to 1."""
    w = {k: max(0.0, float(weights.get(k) or 0.0)) for k in COMPONENTS}
    total = sum(w.values())
    return {k: v / total for k, v in w.items()} if total > 0 else dict.fromkeys(COMPONENTS, 1 / len(COMPONENTS))


def normal_weight_columns(df: DataFrame) -> DataFrame:
    """The same for a table with a row of weights per user."""
    clean = {k: F.greatest(F.coalesce(F.col(k).cast("double"), F.lit(0.0)), F.lit(0.0)) for k in COMPONENTS}
    total = sum((clean[k] for k in COMPONENTS[1:]), clean[COMPONENTS[0]])
    return df.withColumns({k: F.when(total > 0, clean[k] / total).otherwise(1 / len(COMPONENTS)) for k in COMPONENTS})


def score_components(df: DataFrame, crime: str, walk: str, transit: str) -> DataFrame:
    """Adds the three components. Safety is the least crime of the batch; what is missing, NaN or infinite is one half."""
    usable = N.finite(crime)
    span = df.agg(F.min(usable).alias("__lo"), F.max(usable).alias("__hi"))
    lo, hi = F.col("__lo"), F.col("__hi")
    safety = F.when(usable.isNull(), 0.5).when(hi - lo < 1e-9, 1.0).otherwise(1.0 - (usable - lo) / (hi - lo))
    part = lambda c: F.coalesce(N.clip(N.finite(c) / 100.0, 0.0, 1.0), F.lit(0.5))
    return df.crossJoin(F.broadcast(span)).withColumns({"safety": safety, "walk": part(walk), "transit": part(transit)}).drop("__lo", "__hi")


def composite(weights: dict[str, float | Column]) -> Column:
    return sum((F.col(k) * weights[k] for k in COMPONENTS[1:]), F.col(COMPONENTS[0]) * weights[COMPONENTS[0]])


def rank_listings(df: DataFrame, weights: dict[str, float], crime: str, walk: str, transit: str, position: str, top_n: int | None = None) -> DataFrame:
    """Rows by composite score, ties by position, with rank and the numbers of rows that came in and went out: all of
    them, or the ``top_n`` first.

    All rows are numbered from a global order in ranges; of a number of them only these are, under one small window.
    """
    scored = score_components(df, crime, walk, transit).withColumn("composite", composite(normal_weights(weights)))
    order = [F.desc("composite"), F.asc(position)]
    if top_n is None:
        ranked, returned = numbered(scored, order).withColumn("rank", F.col("rank").cast("int")), F.col("n_input")
    else:
        top = scored.orderBy(*order).limit(top_n)
        ranked, returned = top.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*order))), F.least(F.col("n_input"), F.lit(top_n))
    counts = df.agg(F.count(F.lit(1)).alias("n_input")).withColumn("n_returned", returned)
    return ranked.crossJoin(F.broadcast(counts)).withColumns({c: F.round(c, 4) for c in [*COMPONENTS, "composite"]})


def _apart(edges: list[float] | None, least: float = 1e-9) -> list[float]:
    """Edges in order, without those so near the one before that rounding might undo who scores more."""
    out: list[float] = []
    for e in sorted(edges or []):
        if not out or e - out[-1] > least:
            out.append(e)
    return out


def skyband(scored: DataFrame, position: str, k: int, parts: int = SKY_PARTS) -> DataFrame:
    """The rows that some weights may put among the first k, and few others.

    A row that k others beat in every component is in nobody's list. Components are cut into ``parts`` ranges of about
    equal weight, and rows are counted by the cell they are in: those of cells that lie two ranges higher in each
    component beat a row for certain, by more than rounding can undo. Cells with k such rows above them go as a whole;
    there are parts^3 cells at most. Of rows that agree in all components the first k by position stay.
    """
    points = [i / parts for i in range(1, parts)]
    edges = scored.agg(*[F.percentile_approx(c, points, 1000).alias(c) for c in COMPONENTS]).first()
    # By an array of edges, as a comparison for each makes a method too long to be compiled.
    below = lambda c: F.size(F.filter(F.array(*[F.lit(e) for e in _apart(edges[c])]).cast("array<double>"), lambda e: e <= F.col(c)))
    cells = [below(c) for c in COMPONENTS]
    celled = scored.withColumn("__cell", (cells[0] * parts + cells[1]) * parts + cells[2])
    counts = celled.groupBy("__cell").agg(F.count(F.lit(1)).alias("n")).toArrow()
    grid = np.zeros(parts**3, np.int64)
    grid[counts.column("__cell").to_numpy()] = counts.column("n").to_numpy()
    above = np.zeros((parts + 2,) * 3, np.int64)
    above[:parts, :parts, :parts] = grid.reshape(parts, parts, parts)
    for axis in range(3):
        above = np.flip(np.cumsum(np.flip(above, axis), axis), axis)
    left = np.flatnonzero((grid > 0) & (above[2:, 2:, 2:].reshape(-1) < k))
    kept = scored.sparkSession.createDataFrame(pa.table({"__of": pa.array(left, pa.int32())}))
    near = celled.join(F.broadcast(kept), F.col("__cell") == F.col("__of"), "left_semi").drop("__cell")
    # Twice, so that many equal rows are not numbered in one task.
    for deal in (256, 1):
        own = W.partitionBy(*COMPONENTS, F.pmod(F.xxhash64(position), F.lit(deal))).orderBy(position)
        near = near.withColumn("__place", F.row_number().over(own)).where(F.col("__place") <= k).drop("__place")
    return near


def rank_for_users(df: DataFrame, users: DataFrame, user: str, crime: str, walk: str, transit: str, position: str, top_n: int) -> DataFrame:
    """The top_n listings of every user of a weights table (user, safety, walk, transit). Each listing is scored once, and
    only those that may be in somebody's list, see ``skyband``, are crossed with the users.

    These come as arrays of BLOCK at most, so a user's row meets an array, of which top_n go on: the pairs of users and
    listings are never rows, and none of them are sorted with other users' pairs.
    """
    w = normal_weight_columns(users).select(F.col(user).alias("__user"), *[F.col(k).alias(f"w_{k}") for k in COMPONENTS])
    near = kept_small(skyband(score_components(df, crime, walk, transit), position, top_n).withColumn("__n", F.monotonically_increasing_id()), "skyband")
    n = near.count()
    entry = F.struct(F.col(position).alias("position"), *COMPONENTS, "__n")
    blocks = near.groupBy((F.col("__n") % max(1, -(-n // BLOCK))).alias("__block")).agg(F.collect_list(entry).alias("__near")).select("__near")
    pairs = w.repartition("__user").crossJoin(F.broadcast(blocks) if n <= SMALL_ROWS else blocks)
    total = lambda x: sum((x[k] * F.col(f"w_{k}") for k in COMPONENTS[1:]), x[COMPONENTS[0]] * F.col(f"w_{COMPONENTS[0]}"))
    best = F.slice(F.sort_array(F.transform("__near", lambda x: F.struct((-total(x)).alias("less"), x["position"].alias("position"), x["__n"].alias("n")))), 1, top_n)
    picked = pairs.select("__user", F.inline(best))
    order = W.partitionBy("__user").orderBy("less", "position")
    ranked = picked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)
    found = ranked.join(F.broadcast(near) if n <= SMALL_ROWS else near, F.col("n") == F.col("__n"))
    return found.select(*[c for c in near.columns if c != "__n"], F.col("__user").alias(user), (-F.col("less")).alias("composite"), "rank")


def rank_flagged(df: DataFrame, weights: dict[str, float], actual: str, predicted: str, p75: str, crime: str, walk: str, transit: str, position: str, top_n: int | None = None) -> DataFrame:
    """The whole ranking job: listings are flagged against their price band, scored, weighted, put in order and, if asked
    for, cut."""
    return rank_listings(M.flag_overpriced(df, actual, predicted, p75), weights, crime, walk, transit, position, top_n)


def price_verdict(df: DataFrame, actual: str, predicted: str, p25: str, p75: str, flag: str) -> DataFrame:
    """Adds verdict (over, under, fair) and its label; without a band, a tenth either side of the prediction, marked so."""
    banded = F.col(p25).isNotNull() & F.col(p75).isNotNull()
    a, p = F.coalesce(F.col(actual), F.lit(0.0)), F.coalesce(F.col(predicted), F.lit(0.0))
    low, high = F.when(banded, F.col(p25)).otherwise(p * 0.9), F.when(banded, F.col(p75)).otherwise(p * 1.1)
    kind = F.when(F.coalesce(F.col(flag), F.lit(False)) | (a > high), "over").when(a < low, "under").otherwise("fair")
    label = F.when(kind == "over", "Overpriced").when(kind == "under", "Good deal").otherwise("Fair price")
    return df.withColumns({"verdict": kind, "verdict_label": F.when(banded, label).otherwise(F.concat(label, F.lit(" (est.)")))})
