"""Scalar functions over dates and numbers. Null in, null out; division never fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentloom.functions import constants as C
from rentloom.functions.text import _col


def utc_time(c: Column | str) -> Column:
    return F.try_to_timestamp(F.regexp_replace(_col(c).cast("string"), r"\s*UTC$", ""))


def month_of(c: Column | str) -> Column:
    return F.date_trunc("MONTH", _col(c))


def log_count(c: Column | str) -> Column:
    return F.log1p(_col(c).cast("double"))


def from_log(c: Column | str) -> Column:
    """expm1, not below 0."""
    c = _col(c)
    return F.when(c.isNotNull(), F.greatest(F.expm1(c), F.lit(0.0)))


def share_or_zero(part: Column | str, whole: Column | str) -> Column:
    whole = _col(whole)
    return F.when(whole > 0, _col(part) / whole).otherwise(0.0)


def rate_per_1000(part: Column | str, whole: Column | str) -> Column:
    whole = _col(whole)
    return F.when(whole > 0, _col(part) * 1000.0 / whole)


def ratio_of(part: Column | str, other: Column | str) -> Column:
    """part / (part + other), null where that is 0."""
    return F.try_divide(_col(part), _col(part) + _col(other))


def without_sentinel(df: DataFrame, sentinel: float = C.CENSUS_SENTINEL) -> DataFrame:
    numeric = {f.name for f in df.schema if f.dataType.simpleString() in ("double", "float", "int", "bigint")}
    return df.select(*[F.nullif(F.col(c), F.lit(sentinel)).alias(c) if c in numeric else F.col(c) for c in df.columns])


def product(a: Column | str, b: Column | str) -> Column:
    return _col(a) * _col(b)


def clip(c: Column | str, low: float, high: float) -> Column:
    c = _col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def heuristic_rent(bedrooms, bathrooms, walk, transit, index) -> Column:
    """Rent from an index level, sizes and scores, with defaults for what is missing."""
    beds = clip(F.coalesce(_col(bedrooms), F.lit(1.0)), 0.0, 5.0)
    baths = clip(F.coalesce(_col(bathrooms), F.lit(1.0)), 1.0, 4.0)
    walk, transit = (clip(F.coalesce(_col(x), F.lit(80.0)), 0.0, 100.0) for x in (walk, transit))
    level = F.when(_col(index) > 0, _col(index)).otherwise(3500.0)
    factor = F.lit(1.0)
    for n, f in C.SIZE_FACTORS.items():
        factor = F.when(F.floor(beds) == n, f).otherwise(factor)
    amenity = F.lit(1.0) + 0.0015 * (walk - 70) + 0.0010 * (transit - 70)
    return clip(level * factor * amenity + 200.0 * F.greatest(F.lit(0.0), baths - 1.0), 1500.0, 12000.0)


def delta(actual: Column | str, predicted: Column | str) -> tuple[Column, Column]:
    """(difference, share of the prediction), null where either is missing."""
    d = _col(actual) - _col(predicted)
    return d, F.when(_col(predicted) > 0, d / _col(predicted))


def member(c: Column | str, values: list[str]) -> Column:
    return F.coalesce(_col(c), F.lit("")).isin(values)


def or_null(c: Column | str) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(_col(c)), _col(c))


def finite(c: Column | str) -> Column:
    """A double; NaN and infinities as null."""
    c = _col(c).cast("double")
    return F.when(F.abs(c) < float("inf"), c)


def normal_output(df: DataFrame, bands: list[str], contributors: str | None = None) -> DataFrame:
    """Model output with real nulls and an empty list for missing contributors."""
    out = df.withColumns({b: or_null(b) if b in df.columns else F.lit(None).cast("double") for b in bands})
    if contributors is not None:
        empty = F.array().cast("array<struct<feature:string,contribution:double>>")
        out = out.withColumn(contributors, F.coalesce(F.col(contributors), empty) if contributors in df.columns else empty)
    return out
