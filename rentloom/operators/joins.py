"""Joins: keyed, point in time, spatial, claim once."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rentloom.operators.claims import claim_in_rounds
from rentloom.sources.staging import kept_small

# Rows of an area that one task matches, at most.
AREA_ROWS = 1_000_000


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Fails where a key stands twice: a left join with such a side would add rows."""
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not twice.isEmpty():
        raise ValueError(f"{keys} are not unique")
    return df


def once_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows, one a key; reading them fails where a key without nulls stands twice. The check is part of the plan, so it
    costs no job of its own, and no shuffle where the rows are dealt by their keys already."""
    rest = [c for c in df.columns if c not in keys]
    found = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct(*rest)).alias("__r"))
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    twice = F.raise_error(F.concat(F.lit(f"{keys} are not unique: "), F.to_json(F.struct(*keys))))
    checked = found.withColumn("__r", F.when(whole & (F.col("__n") > 1), twice).otherwise(F.col("__r")))
    return checked.select(*[F.col(c) if c in keys else F.col(f"__r.{c}").alias(c) for c in df.columns])


def left_features(left: DataFrame, right: DataFrame, keys: list[str], fills: dict[str, object], latest_by: list | None = None) -> DataFrame:
    """Left join with one row per key on the right; misses get their fill, as do columns that the left had before. A key
    that repeats on the right fails the job, as it would add rows; where keys may repeat, ``latest_by`` is the order whose
    last row counts."""
    kept = left.drop(*fills)
    one = once_per_key(right.select(*keys, *fills), keys) if latest_by is None else keep_first(right, keys, latest_by, last=True).select(*keys, *fills)
    return kept.join(one, keys, "left").fillna(fills)


def keep_first(df: DataFrame, keys: list[str], order: list, last: bool = False) -> DataFrame:
    """One row per key by an explicit order, through an aggregate that combines before it shuffles."""
    rest = [c for c in df.columns if c not in keys]
    sort_key = F.struct(*[F.col(o).alias(f"k{i}") if isinstance(o, str) else o.alias(f"k{i}") for i, o in enumerate(order)])
    pick = F.max_by if last else F.min_by
    out = df.groupBy(*keys).agg(pick(F.struct(*rest), sort_key).alias("__r"))
    return out.select(*[F.col(c) if c in keys else F.col(f"__r.{c}").alias(c) for c in df.columns])


def asof_join(left: DataFrame, panel: DataFrame, values: list[str], month: str = "month", key: str | None = None, fallback: str = "latest") -> DataFrame:
    """Point-in-time join: the panel row with the greatest month not after the left row's.

    Values that are null there come from the key's latest row (fallback "latest"), which may lie after the left row, or
    stay null ("none"). provenance says exact, asof, latest or none. Months are dates or times of a month's beginning, in
    the panel one per key at most.

    The panel is written out for every month between the first and the last that the left side asks for, and one entry
    for rows without a month, so the join is by equality of key and month, and a key's rows are spread over its months.
    """
    kind = left.schema[month].dataType.simpleString()
    none = F.lit("0001-01-01").cast(kind)
    keys = ["__pk"] if key else []
    spans = panel.where(F.col(month).isNotNull()).select(*[F.col(key).alias(k) for k in keys], F.col(month).cast(kind).alias("__pm"), *[F.col(v).alias(f"__{v}") for v in values])
    order = (W.partitionBy("__pk") if key else W.partitionBy(F.lit(1))).orderBy("__pm")
    latest = spans.groupBy(*keys).agg(F.min("__pm").alias("__first"), *[F.max_by(f"__{v}", "__pm").alias(f"__latest_{v}") for v in values])
    asked = left.agg(F.min(month).alias("__lo"), F.max(month).alias("__hi"))
    step = F.expr("INTERVAL 1 MONTH")
    series = lambda a, b: F.when(a <= b, F.sequence(a, b, step)).otherwise(F.array().cast(f"array<{kind}>"))
    one = latest.crossJoin(F.broadcast(asked))
    early = F.concat(F.array(none), F.coalesce(series(F.col("__lo"), F.col("__first") - step), F.array().cast(f"array<{kind}>")))
    before = one.select(*keys, F.explode(early).alias("__m"), *[F.lit(None).cast(spans.schema[f"__{v}"].dataType).alias(f"__{v}") for v in values], F.lit(None).cast(kind).alias("__pm"), *[f"__latest_{v}" for v in values])
    last = F.coalesce(F.lead("__pm").over(order) - step, F.greatest(F.col("__pm"), "__hi"))
    ended = spans.crossJoin(F.broadcast(asked)).withColumn("__end", last)
    filled = ended.join(latest, keys) if key else ended.crossJoin(F.broadcast(latest))
    after = filled.select(*keys, F.explode(series(F.col("__pm"), F.col("__end"))).alias("__m"), *[f"__{v}" for v in values], "__pm", *[f"__latest_{v}" for v in values])
    grid = before.unionByName(after)
    same = F.coalesce(F.col(month).cast(kind), none) == F.col("__m")
    out = left.join(grid, (F.col(key) == F.col("__pk")) & same if key else same, "left")
    take = lambda v: F.coalesce(f"__{v}", f"__latest_{v}") if fallback == "latest" else F.col(f"__{v}")
    found = F.coalesce(*[F.col(f"__{v}") for v in values]).isNotNull()
    late = F.coalesce(*[F.col(f"__latest_{v}") for v in values]).isNotNull() if fallback == "latest" else F.lit(False)
    how = F.when(found & (F.col("__pm") == F.col(month)), "exact").when(found, "asof").when(late, "latest").otherwise("none")
    return out.select(*[left[c] for c in left.columns], *[take(v).alias(v) for v in values], how.alias("provenance"))


def inside_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd rule over a closed ring of [lon, lat]."""
    n = F.size(ring) - 1

    def crossing(k: Column) -> Column:
        x1, y1, x2, y2 = ring[k][0], ring[k][1], ring[k + 1][0], ring[k + 1][1]
        return F.when(((y1 > lat) != (y2 > lat)) & (lon < (x2 - x1) * (lat - y1) / F.when(y2 != y1, y2 - y1).otherwise(1.0) + x1), 1).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, k: a + crossing(k.cast("int"))) % 2 == 1


def _first_hit(areas: Column, lon: Column, lat: Column) -> Column:
    """Of an array of (name, contour, position), the name of the first by position that holds a point."""
    hits = F.filter(areas, lambda a: inside_ring(lon, lat, a["contour"]))
    return F.array_min(F.transform(hits, lambda a: F.struct(a["position"].alias("position"), a["name"].alias("name"))))["name"]


def assign_area(points: DataFrame, areas: DataFrame, lat: str = "lat", lon: str = "lon", name: str = "zip_code", cell: float = 0.02, small: bool = False) -> DataFrame:
    """Adds the area that each point is in, null outside; of several the one with the least position. ``small`` says that
    the areas are known to be few, see ``assign_area_small``.

    Areas are cut into grid cells, and each cell has the list of its areas; a point meets that list by an equi-join on
    its cell, so no point is duplicated or grouped again.
    """
    box = areas.select(F.struct(F.col(name).alias("name"), "contour", "position").alias("area"), *[F.expr(f"array_{how}(transform(contour, p -> p[{k}]))").alias(f"{how}{k}") for how in ("min", "max") for k in (0, 1)])
    steps = lambda k: F.sequence(F.floor(F.col(f"min{k}") / cell), F.floor(F.col(f"max{k}") / cell))
    cells = box.withColumn("__cx", F.explode(steps(0))).withColumn("__cy", F.explode(steps(1))).groupBy("__cx", "__cy").agg(F.collect_list("area").alias("__areas"))
    tagged = points.drop(name).withColumns({"__cx": F.floor(F.col(lon) / cell), "__cy": F.floor(F.col(lat) / cell)})
    near = tagged.join(F.broadcast(cells) if small else cells, ["__cx", "__cy"], "left")
    return near.withColumn(name, _first_hit(F.col("__areas"), F.col(lon), F.col(lat))).drop("__cx", "__cy", "__areas")


def assign_area_small(points: DataFrame, areas: DataFrame, lat: str = "lat", lon: str = "lon", name: str = "zip_code", cell: float = 0.02, most: int = 100_000) -> DataFrame:
    """As ``assign_area``, where areas have at most ``most`` corners in all, which is checked: cells with their areas are
    broadcast, and points never move, however many are in one cell."""
    corners = areas.agg(F.sum(F.size("contour").cast("long"))).first()[0] or 0
    if corners > most:
        return assign_area(points, areas, lat, lon, name, cell)
    return assign_area(points, areas, lat, lon, name, cell, small=True)


def not_done(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return work.join(done.select(key).distinct(), key, "left_anti")


class _Offers:
    """Offers in order of (price, place), and which are taken. Free neighbours are found by pointers that skip taken ones,
    so a claim takes about logarithmic time."""

    def __init__(self, places: list[int], prices: dict[int, float]):
        self.priced = sorted((prices[p], p) for p in places if p in prices)
        self.values = [v for v, _ in self.priced]
        self.rank = {p: k for k, (_, p) in enumerate(self.priced)}
        self.right = list(range(len(self.priced) + 1))
        self.left = list(range(len(self.priced) + 1))
        self.places, self.at = sorted(places), 0
        self.loose, self.loose_at = [p for p in self.places if p not in prices], 0

    @staticmethod
    def _find(links: list[int], k: int) -> int:
        while links[k] != k:
            links[k] = links[links[k]]
            k = links[k]
        return k

    def drop(self, place: int) -> None:
        k = self.rank.get(place)
        if k is not None:
            self.right[k] = k + 1
            self.left[k + 1] = k

    def nearest(self, price: float) -> int | None:
        """The free offer with the nearest price; of equally near ones the one that comes first."""
        best = None
        k = self._find(self.right, bisect_left(self.values, price))
        if k < len(self.values):
            best = (abs(self.values[k] - price), self.priced[k][1])
        k = self._find(self.left, bisect_left(self.values, price))
        if k > 0:
            # Of equal prices below, the first by place.
            j = self._find(self.right, bisect_left(self.values, self.values[k - 1]))
            below = (abs(self.values[j] - price), self.priced[j][1])
            best = below if best is None else min(best, below)
        return None if best is None else best[1]

    def first(self, taken: set[int], loose: bool) -> int | None:
        own, name = (self.loose, "loose_at") if loose else (self.places, "at")
        k = getattr(self, name)
        while k < len(own) and own[k] in taken:
            k += 1
        setattr(self, name, k)
        return own[k] if k < len(own) else None


def claim_once(wanted: DataFrame, offers: DataFrame, area: str, schema: str, most: int = AREA_ROWS) -> DataFrame:
    """Each wanted row, in order of its position, takes one offer of its area that nobody has taken: of the same unit
    label first, the nearest price, then the first without a price; of any label if there is none of its own.

    wanted: area, position, label, price; offers: area, offer, label, price. Areas never share offers, so they are dealt
    out and matched apart. An area of ``most`` rows at most is matched in one task, in turn, in about n log n steps; the
    rows of a larger one are matched in rounds by many, see ``claims``, with the same result. Rows without an area get no
    offer. schema names the type of area.
    """

    def match(w: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        free = o.sort_values("offer").reset_index(drop=True)
        ids = free["offer"].tolist()
        prices = {k: float(p) for k, p in enumerate(free["price"]) if p == p and p is not None}
        labels = ["" if x is None or x != x else x for x in free["label"]]
        pools = {None: _Offers(list(range(len(free))), prices)}
        taken: set[int] = set()
        mine = w.sort_values("position")
        out = []
        for row in mine.itertuples():
            if len(taken) == len(ids):
                break
            named = row.label if isinstance(row.label, str) else None
            if named not in pools:
                pools[named] = _Offers([k for k, x in enumerate(labels) if x.startswith(named)], prices)
                for k in taken:
                    pools[named].drop(k)
            pick = None
            for name in dict.fromkeys([named, None]):
                pool = pools[name]
                priced = row.price is not None and row.price == row.price
                pick = pool.nearest(float(row.price)) if priced else pool.first(taken, loose=False)
                if pick is None and priced:
                    pick = pool.first(taken, loose=True)
                if pick is not None:
                    break
            if pick is not None:
                taken.add(pick)
                for pool in pools.values():
                    pool.drop(pick)
            out.append(ids[pick] if pick is not None else None)
        # Nothing is left for those after the last that was looked at.
        out += [None] * (len(mine) - len(out))
        return pd.DataFrame({area: mine[area], "position": mine["position"], "offer": pd.array(out, "Int64")})

    sizes = wanted.groupBy(area).agg(F.count(F.lit(1)).alias("__n")).unionByName(offers.groupBy(area).agg(F.count(F.lit(1)).alias("__n")))
    large = kept_small(sizes.where(F.col(area).isNotNull()).groupBy(area).agg(F.sum("__n").alias("__n")).where(F.col("__n") > most).select(area), "large-areas")
    small = lambda df: df.where(F.col(area).isNotNull()).join(large, area, "left_anti")
    matched = small(wanted).groupBy(area).cogroup(small(offers).groupBy(area)).applyInPandas(match, f"{area} {schema}, position long, offer long")
    if not large.isEmpty():
        matched = matched.unionByName(claim_in_rounds(wanted.join(large, area, "left_semi"), offers.join(large, area, "left_semi"), area))
    nowhere = wanted.where(F.col(area).isNull()).select(F.col(area).cast(schema).alias(area), F.col("position").cast("long").alias("position"), F.lit(None).cast("long").alias("offer"))
    return matched.unionByName(nowhere)


def with_scores(rows: DataFrame, cache: DataFrame, centroids: DataFrame, city: tuple[float, float]) -> DataFrame:
    """Scores by (address, lat, lon to six places); coordinates from the row, else the ZIP's centre, else the city's."""
    placed = rows.join(centroids.select(F.col("zip_code"), F.col("lat").alias("__zlat"), F.col("lon").alias("__zlon")), "zip_code", "left")
    source = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), "address").when(F.col("__zlat").isNotNull(), "zip_centroid").otherwise("city_centroid")
    placed = placed.withColumn("geo_source", source).withColumns({"lat": F.coalesce("lat", "__zlat", F.lit(city[0])), "lon": F.coalesce("lon", "__zlon", F.lit(city[1]))}).drop("__zlat", "__zlon")
    key = lambda df: df.withColumns({"__la": F.round(F.col("lat") * 1e6).cast("long"), "__lo": F.round(F.col("lon") * 1e6).cast("long")})
    scores = [c for c in cache.columns if c not in ("address", "lat", "lon")]
    once = key(cache).groupBy("address", "__la", "__lo").agg(*[F.first(c).alias(c) for c in scores])
    return key(placed).join(once, ["address", "__la", "__lo"], "left").drop("__la", "__lo")
