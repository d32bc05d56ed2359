"""Projections, filters and row expansion."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentloom.functions import constants as C
from rentloom.functions import text as X
from rentloom.functions.text import _col


def select_present(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])


def drop_and_rename(df: DataFrame, drop: list[str] = (), rename: dict[str, str] | None = None) -> DataFrame:
    """Columns that aren't there are no error."""
    return df.drop(*drop).withColumnsRenamed({a: b for a, b in (rename or {}).items() if a in df.columns})


def first_present(df: DataFrame, names: list[str]) -> str:
    for n in names:
        if n in df.columns:
            return n
    raise ValueError(f"none of {names} is there")


def month_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if re.match(C.MONTH_COLUMN, c)]


def unpivot_months(df: DataFrame, ids: list[str], value: str, start: str | None = C.START_DATE) -> DataFrame:
    """Wide months as rows (ids, date, value) from a start date on; null values stay. Columns before the start are not
    read at all."""
    months = [c for c in month_columns(df) if start is None or c >= start]
    wide = df.select(*ids, *[F.expr(f"try_cast(`{m}` AS DOUBLE)").alias(m) for m in months])
    return wide.unpivot([F.col(c) for c in ids], [F.col(f"`{m}`") for m in months], "date", value).withColumn("date", F.try_to_timestamp("date"))


def not_in(c: Column | str, values: list) -> Column:
    """Rows with a null stay."""
    return F.coalesce(~_col(c).isin(values), F.lit(True))


def since(df: DataFrame, c: str, start: str = C.START_DATE) -> DataFrame:
    return df.where(F.col(c) >= F.lit(start).cast("timestamp"))


def matching_or_all(df: DataFrame, c: str, text: str) -> DataFrame:
    """Rows that contain a text, or every row where none does. One aggregate row is joined back."""
    flagged = df.withColumn("__hit", F.coalesce(F.lower(F.col(c)).contains(text.lower()), F.lit(False)))
    found = flagged.agg(F.coalesce(F.max("__hit"), F.lit(False)).alias("__any"))
    return flagged.crossJoin(F.broadcast(found)).where(F.col("__hit") | ~F.col("__any")).drop("__hit", "__any")


def trailing_months(df: DataFrame, c: str, months: int = 12) -> DataFrame:
    """Rows in (latest - months, latest]."""
    latest = df.agg(F.max(c).alias("__latest"))
    return df.crossJoin(F.broadcast(latest)).where((F.col(c) <= F.col("__latest")) & (F.col(c) > F.col("__latest") - F.expr(f"INTERVAL {months} MONTH"))).drop("__latest")


def month_grid(df: DataFrame, key: str, month: str, measures: list[str], extra_keys: DataFrame | None = None) -> DataFrame:
    """Every key at every month between the first and the last, measures 0 where there was no row."""
    keys = df.select(key) if extra_keys is None else df.select(key).unionByName(extra_keys.select(key))
    span = df.agg(F.min(month).alias("lo"), F.max(month).alias("hi")).where("lo IS NOT NULL")
    months = span.select(F.explode(F.expr("sequence(lo, hi, INTERVAL 1 MONTH)")).alias(month))
    grid = keys.where(F.col(key).isNotNull()).distinct().crossJoin(F.broadcast(months))
    return grid.join(df, [key, month], "left").select(key, month, *[F.coalesce(m, F.lit(0)).alias(m) for m in measures])


def expand_units(df: DataFrame) -> DataFrame:
    """Scraped rows as one row per floor plan: pricing first, then beds_baths, then the first rent in it."""
    has = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    beds, pricing = F.col("beds_baths"), has("pricing")
    units = F.when(F.trim(pricing) != "", pricing).otherwise(beds)
    plans = X.floorplans(units)
    rent = X.first_rent(beds)
    single = F.array(F.struct(X.label_before_price(beds).alias("label"), rent.alias("rent")))
    chosen = F.when(F.size(plans) > 0, plans).when(rent.isNotNull(), single)
    explicit = X.number(F.coalesce(*[F.col(c) for c in C.SQFT_COLUMNS if c in df.columns][:1], F.lit(None).cast("string")))
    sqft = F.coalesce(explicit, X.square_feet(units), X.square_feet(beds))
    return df.withColumns({"__sqft": sqft, "__plans": chosen}).select("*", F.explode("__plans").alias("__p")).withColumns({"rent_usd": F.col("__p.rent"), "beds_baths": X.strip_square_feet("__p.label"), "sqft": F.col("__sqft")}).drop("__p", "__plans", "__sqft")


def expand_unit_prices(df: DataFrame, pricing: str = "pricing") -> DataFrame:
    """One row per unit type; rows without a price that can be read go."""
    return df.select("*", F.explode(X.unit_prices(pricing)).alias("__u")).withColumns({"beds_baths": F.col("__u.unit"), pricing: F.col("__u.price")}).drop("__u")


def override(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Fields of the right side replace those of the left where the key is there, even by empty text."""
    shared = [c for c in right.columns if c != key]
    r = right.select(key, *[F.col(c).alias(f"__{c}") for c in shared], F.lit(True).alias("__hit"))
    joined = left.join(r, key, "left")
    new = [F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c) if c in left.columns else F.lit(None)).alias(c) for c in shared]
    return joined.select(*[c for c in left.columns if c not in shared], *new)


def room_range(c: Column | str, picks: list[float], open_top: float, floor: bool = True) -> Column:
    """None: all pass. One: that number, or more for the open top. Several: from the least to the largest, no upper end
    for the open top."""
    if not picks:
        return F.lit(True)
    n = F.floor(_col(c)) if floor else _col(c)
    low, high = min(picks), max(picks)
    if len(picks) == 1 and low != open_top:
        test = n == low
    else:
        test = (n >= low) & (F.lit(True) if high == open_top else n <= high)
    return F.coalesce(test, F.lit(False))


def bath_minimum(c: Column | str, least: float) -> Column:
    return F.coalesce(_col(c), F.lit(1.0)) >= least


def within_budget(actual: Column | str, rent: Column | str, budget: float) -> Column:
    return F.coalesce(X.number(F.coalesce(_col(actual).cast("string"), _col(rent).cast("string"))) <= budget, F.lit(False))


def in_places(df: DataFrame, zip_col: str, places: DataFrame, names: list[str]) -> DataFrame:
    """Rows in a ZIP of any of the named places (place, zip_code)."""
    wanted = places.where(F.col("place").isin(names)).select(F.col("zip_code").alias(zip_col)).distinct()
    return df.join(wanted, zip_col, "left_semi")


# Ranges that a payload has to keep, (low, high, low excluded).
RULES = {
    "bedrooms": (0, 20, False), "bathrooms": (0, 20, False), "walk_score": (0, 100, False), "transit_score": (0, 100, False),
    "census_renter_ratio": (0, 1, False), "census_vacancy_rate": (0, 1, False), "actual_rent_usd": (0, 100000, True),
}


def validate(df: DataFrame, rules: dict[str, tuple] | None = None, required: list[str] = (), lengths: dict[str, int] | None = None) -> DataFrame:
    """Adds failed, the names of broken rules, and valid. A null breaks a rule only where the column is required."""
    tests = [(f"{c}_required", F.col(c).isNull()) for c in required]
    tests += [(f"{c}_length", F.length(c) != n) for c, n in (lengths or {}).items()]
    for c, (low, high, above) in (RULES if rules is None else rules).items():
        if c in df.columns:
            tests.append((f"{c}_range", (F.col(c) <= low if above else F.col(c) < low) | (F.col(c) > high)))
    failed = F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests]), lambda x: x.isNotNull())
    return df.withColumn("failed", failed).withColumn("valid", F.size("failed") == 0)
