"""Claim-once matching of an area that is too large for one task, by deferred acceptance.

All offers prefer the wanted row with the earlier position, so the stable matching is what rows get that choose in turn.
Each round every row that holds nothing goes on along its list to the best offer that a row behind it, or nobody, holds,
and asks for that; each offer keeps the earliest that has asked, and who is put off goes on. Whoever was turned down by an
offer once is so for ever, as offers only change to earlier rows.

A row's list has up to four parts, one after the other: offers with its label by the distance of their price, those with
its label and no price in order, and the same of all labels; without a price of its own all offers come in order. The
offers of each part stand in blocks of a global order. A row that looks for its offer is with one block at a time, first
the one where its price falls, and goes on to the next block on the nearer side while that may hold a better offer. A task
has one block and the rows that are with it, and lets them choose in turn, so near rows don't take a round each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentloom.operators.ordering import numbered, running_total
from rentloom.sources.staging import kept_small

BLOCK = 1024
DONE = 4
# In place of null where numbers go to Python, which would turn whole columns to floats.
NOBODY, UNHELD = -(1 << 63), (1 << 63) - 1
_LIST = ["area", "pool", "kind"]


def _priced(c: str) -> Column:
    return F.when(~F.isnan(c), F.col(c))


def _parts(wanted: DataFrame, offers: DataFrame, block: int) -> DataFrame:
    """(area, pool, kind, block, offer, price): every part of a list, its offers in order in blocks."""
    labels = wanted.where("label IS NOT NULL").select("area", F.col("label").alias("of")).distinct()
    own = offers.join(labels, "area").where(F.startswith(F.coalesce("label", F.lit("")), F.col("of")))
    pools = own.select("area", F.concat(F.lit("="), "of").alias("pool"), "offer", "price").unionByName(offers.select("area", F.lit("*").alias("pool"), "offer", "price"))
    kinds = pools.select("*", F.explode(F.array(F.when(F.col("price").isNull(), "u").otherwise("p"), F.lit("a"))).alias("kind"))
    order = [*[F.col(c) for c in _LIST], F.when(F.col("kind") == "p", F.col("price")), F.col("offer")]
    placed = numbered(kinds, order, "place")
    return kept_small(placed.select(*_LIST, F.floor((F.col("place") - 1) / block).alias("block"), "offer", "price"), "claim-lists")


def _starts(wanted: DataFrame, blocks: DataFrame, pool: Column) -> DataFrame:
    """(position, start): the block of a pool's priced offers in which a row's price falls, null if it is before all."""
    borders = blocks.where("kind = 'p'").select("area", "pool", F.col("low").alias("price"), F.lit(1).alias("border"), F.lit(None).cast("long").alias("position"), "block")
    rows = wanted.where("price IS NOT NULL").select("area", pool.alias("pool"), "price", F.lit(0).alias("border"), "position", F.lit(None).cast("long").alias("block")).where("pool IS NOT NULL")
    order = [F.col("area"), F.col("pool"), F.col("price"), F.desc("border"), F.col("block"), F.col("position")]
    counted = kept_small(running_total(borders.unionByName(rows), order, "border"), "claim-starts")
    at = counted.where("border = 1").select(F.col("area").alias("__a"), F.col("pool").alias("__p"), F.col("upto").alias("__n"), F.col("block").alias("start"))
    same = (F.col("upto") == F.col("__n")) & (F.col("area") == F.col("__a")) & (F.col("pool") == F.col("__p"))
    return counted.where("border = 0").join(at, same).select("position", "start")


def _base(wanted: DataFrame, blocks: DataFrame) -> DataFrame:
    """The rows with the first and the last block of each part of their list, null where there is none, and their starts."""
    spans = blocks.groupBy(*_LIST).agg(F.min("block").alias("first"), F.max("block").alias("last"))
    own, every = F.concat(F.lit("="), "label"), F.lit("*")
    out = wanted
    for k, (pool, priced, free) in enumerate([(own, "p", "a"), (own, "u", None), (every, "p", "a"), (every, "u", None)]):
        kind = F.when(F.col("price").isNotNull(), priced).otherwise(F.lit(free))
        part = spans.select(F.col("area").alias("__a"), F.col("pool").alias(f"pool{k}"), F.col("kind").alias(f"kind{k}"), F.col("first").alias(f"first{k}"), F.col("last").alias(f"last{k}"))
        out = out.join(part, (F.col("area") == F.col("__a")) & (pool == F.col(f"pool{k}")) & (kind == F.col(f"kind{k}")), "left").drop("__a")
    for k, pool in ((0, own), (2, every)):
        out = out.join(_starts(wanted, blocks, pool).withColumnRenamed("start", f"start{k}"), "position", "left")
    return kept_small(out.withColumns({"start1": F.lit(None).cast("long"), "start3": F.lit(None).cast("long")}), "claim-rows")


def _of_stage(name: str, stage: Column) -> Column:
    return F.coalesce(*[F.when(stage == k, F.col(f"{name}{k}")) for k in range(DONE)])


def _entered(rows: DataFrame, stage: Column) -> DataFrame:
    """Rows at the begin of the first part of their list from ``stage`` on that has offers; DONE if none has."""
    found = F.coalesce(*[F.when((stage <= k) & F.col(f"first{k}").isNotNull(), k) for k in range(DONE)], F.lit(DONE))
    at = F.coalesce(_of_stage("start", F.col("stage")), _of_stage("first", F.col("stage")))
    return rows.withColumn("stage", found).withColumns({"at": at, "lo": at, "hi": at, "best": F.lit(None).cast("long"), "gap": F.lit(None).cast("double")})


_STATE = ["stage", "at", "lo", "hi", "best", "gap"]


def _turns(mine: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
    """The rows that are with a block choose in turn: what each asks for, or where it goes on."""
    ids, prices = block["offer"].to_numpy(np.int64), block["price"].to_numpy(float)
    order = np.argsort(ids, kind="stable")
    ids, prices = ids[order], prices[order]
    held = block["held"].to_numpy(np.int64)[order]
    out = []
    for r in mine.sort_values("position").itertuples():
        free = held > r.position
        best, gap, own = (None, None, -1) if r.best == NOBODY else (int(r.best), r.gap, -1)
        two_sided = r.kind == "p"
        if free.any():
            gaps = np.where(free, np.abs(prices - r.price), np.inf) if two_sided else np.where(free, 0.0, np.inf)
            k = int(np.argmin(gaps))
            if best is None or (gaps[k], ids[k]) < (gap, best):
                best, gap, own = int(ids[k]), float(gaps[k]), k
        # What hasn't been looked at yet, and how near it may be.
        below = abs(r.price - r.below) if two_sided and not pd.isna(r.below) else None
        above = (abs(r.above - r.price) if two_sided else 0.0) if not pd.isna(r.above) else None
        sure = best is not None and (not two_sided or all(x is None or gap < x for x in (below, above)))
        if r.latest < r.position:
            out.append((r.position, None, r.stage + 1, -1, -1, -1, None, None))
        elif sure or (best is not None and below is None and above is None):
            if own >= 0:
                held[own] = r.position
            out.append((r.position, best, r.stage, r.at, r.lo, r.hi, None, None))
        elif below is None and above is None:
            out.append((r.position, None, r.stage + 1, -1, -1, -1, None, None))
        elif above is None or (below is not None and below <= above):
            out.append((r.position, None, r.stage, r.lo - 1, r.lo - 1, r.hi, best, gap))
        else:
            out.append((r.position, None, r.stage, r.hi + 1, r.lo, r.hi + 1, best, gap))
    found = pd.DataFrame(out, columns=["position", "asked", *_STATE])
    return found.astype({"asked": "Int64", "best": "Int64", "gap": "float64"})


def claim_in_rounds(wanted: DataFrame, offers: DataFrame, area: str, block: int = BLOCK) -> DataFrame:
    """(area, position, offer): as ``joins.claim_once`` gives it, for rows with an area. Positions are different, as are an
    area's offers."""
    w = kept_small(wanted.select(F.col(area).alias("area"), F.col("position").cast("long").alias("position"), "label", F.col("price").cast("double").alias("price")).withColumn("price", _priced("price")), "claim-wanted")
    o = offers.select(F.col(area).alias("area"), F.col("offer").cast("long").alias("offer"), "label", F.col("price").cast("double").alias("price")).withColumn("price", _priced("price"))
    lists = _parts(w, o, block)
    blocks = kept_small(lists.groupBy(*_LIST, "block").agg(F.min("price").alias("low"), F.max("price").alias("high")), "claim-blocks")
    base = _base(w, blocks)
    spark = wanted.sparkSession
    holds = spark.createDataFrame([], lists.select("area", "offer").schema.add("position", "long").add("stage", "integer"))
    states = kept_small(_entered(base, F.lit(0)), "claim-states")
    columns = "position long, asked long, stage int, at long, lo long, hi long, best long, gap double"
    while not states.where(F.col("stage") < DONE).isEmpty():
        stage = F.col("stage")
        rows = states.where(stage < DONE).select("position", "area", _of_stage("pool", stage).alias("pool"), _of_stage("kind", stage).alias("kind"), "price", *[F.coalesce("best", F.lit(NOBODY)).alias("best") if c == "best" else c for c in _STATE], _of_stage("first", stage).alias("first"), _of_stage("last", stage).alias("last"))
        side = lambda k, name, value: blocks.select(*[F.col(c).alias(f"__{c}") for c in _LIST], F.col("block").alias(name), (F.col(value) if value != "low" else F.coalesce("low", F.lit(0.0))).alias(k))
        for k, name, value, edge, first in (("below", "__b", "high", F.col("lo") - 1, "first"), ("above", "__c", "low", F.col("hi") + 1, "last")):
            here = F.col(name) == edge
            for c in _LIST:
                here = here & (F.col(c) == F.col(f"__{c}"))
            rows = rows.join(side(k, name, value), here, "left").drop(*[f"__{c}" for c in _LIST], name, first)
        current = lists.join(holds.select("area", "offer", F.col("position").alias("held")), ["area", "offer"], "left").withColumn("held", F.coalesce("held", F.lit(UNHELD)))
        # Where all offers of a part are held by rows before it, a row goes on to the next part at once.
        last = current.groupBy(*_LIST).agg(F.max("held").alias("latest"))
        rows = rows.join(last, _LIST, "left")
        key = [*_LIST, "block"]
        moved = rows.withColumn("block", F.col("at")).groupBy(*key).cogroup(current.groupBy(*key)).applyInPandas(_turns, columns)
        moved = kept_small(moved.join(states.select("position", "area"), "position"), "claim-round")
        asked = holds.unionByName(moved.where("asked IS NOT NULL").select("area", F.col("asked").alias("offer"), "position", "stage"))
        holds = kept_small(asked.groupBy("area", "offer").agg(F.min("position").alias("position"), F.min_by("stage", "position").alias("stage")), "claim-holds")
        going = moved.where("asked IS NULL").select("position", *_STATE)
        done = states.where(stage == DONE).select("position", *_STATE)
        # Who holds nothing goes on where it is, or, turned down or put off, begins its part of the list again.
        free = base.join(holds.select("position"), "position", "left_anti").join(going.unionByName(done), "position", "left")
        free = free.join(asked.select("position", F.col("stage").alias("__asked")), "position", "left")
        again, next_part, same = free.where("stage IS NULL"), free.where("at < 0"), free.where(f"at >= 0 OR (at IS NULL AND stage = {DONE})")
        names = [*base.columns, *_STATE]
        parts = [_entered(again.drop(*_STATE), F.coalesce("__asked", F.lit(0))), _entered(next_part.withColumnRenamed("stage", "__from").drop("at", "lo", "hi", "best", "gap"), F.col("__from")).drop("__from"), same]
        states = kept_small(parts[0].select(*names).unionByName(parts[1].select(*names)).unionByName(parts[2].select(*names)), "claim-states")
    return w.select("area", "position").join(holds.select("position", "offer"), "position", "left").select(F.col("area").alias(area), "position", "offer")
