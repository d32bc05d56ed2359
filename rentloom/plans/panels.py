"""Source tables to panels: indices, census, market trend, incidents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentloom.functions import constants as C
from rentloom.functions import numbers as N
from rentloom.functions import text as X
from rentloom.operators import aggregates as A
from rentloom.operators import joins as J
from rentloom.operators import reshape as R
from rentloom.sources import tables as S

INDEX_IDS = ["zip_code", "SizeRank", "City", "Metro", "CountyName", "State", "StateName"]


def index_panel(raw: DataFrame, value: str, drop_zips: list[str] = (), zips: list[str] = C.CITY_ZIPS, start: str = C.START_DATE) -> DataFrame:
    """A wide index as (zip_code, date, value, ids): ZIPs are chosen before the unpivot."""
    S.require(raw, ["RegionName"])
    wide = raw.withColumn("zip_code", X.standard_zip("RegionName")).where(F.col("zip_code").isin(zips))
    ids = [c for c in INDEX_IDS if c in wide.columns]
    rows = R.unpivot_months(wide, ids, value, start).where(R.not_in("zip_code", list(drop_zips)))
    return rows.select("zip_code", "date", value, *[c for c in ids if c != "zip_code"])


def clean_rent_index(spark: SparkSession, path: str) -> DataFrame:
    return index_panel(S.read_csv(spark, path), "zori_rent", C.SPARSE_ZIPS)


def clean_value_index(spark: SparkSession, path: str) -> DataFrame:
    return index_panel(S.read_csv(spark, path, encoding="ISO-8859-1"), "zhvi_value")


def clean_census(raw: DataFrame, numeric: list[str]) -> DataFrame:
    S.require(raw, ["zip_code"])
    rows = S.typed(raw, zip_code="zip", **dict.fromkeys(numeric, "double")).where(R.not_in("zip_code", C.CENSUS_DROP_ZIPS) & F.col("zip_code").isNotNull())
    return N.without_sentinel(rows)


def shape_census(matrix: DataFrame, zips: list[str] = C.CITY_ZIPS) -> DataFrame:
    """Raw census columns as features, one row per ZIP of the city."""
    names = {"zip code tabulation area": "zip_code", "B25064_001E": "median_rent", "B19013_001E": "median_income", "B25002_003E": "vacant", "B01003_001E": "population", "B25003_002E": "owners", "B25003_003E": "renters"}
    rows = R.drop_and_rename(matrix.withColumn("__k", F.monotonically_increasing_id()), rename=names)
    values = [v for v in names.values() if v != "zip_code"]
    rows = N.without_sentinel(S.typed(rows, zip_code="zip", **dict.fromkeys(values, "double")).where(F.col("zip_code").isin(zips)))
    one = J.keep_first(rows.select("zip_code", *values, "__k"), ["zip_code"], ["__k"]).drop("__k")
    occupied = F.col("owners") + F.col("renters")
    return one.withColumns({"renter_ratio": N.ratio_of("renters", "owners"), "vacancy_rate": F.try_divide(F.col("vacant"), occupied + F.col("vacant"))})


def clean_trend(spark: SparkSession, path: str) -> DataFrame:
    """Metro rent momentum: (region, month, median_rent, mom_pct, yoy_pct), percentages in percent."""
    raw = S.read_csv(spark, path, encoding="UTF-16", sep="\t")
    start = R.first_present(raw, ["StartMonth", "Start"])
    return raw.select(
        F.col("Region").alias("region"), N.month_of(N.utc_time(start)).alias("month"), X.money("MedianRent").alias("median_rent"),
        X.percent("RentMoM").alias("redfin_mom_pct"), X.percent("RentYoY").alias("redfin_yoy_pct"),
    )


def incident_panel(incidents: DataFrame, areas: DataFrame, start: str = C.START_DATE, cell: float = 0.02, counters: A.Counters | None = None) -> DataFrame:
    """Incidents by ZIP and month, assigned to ZIPs by their points; ``cell`` is the grid's step, about an area's size.
    ``counters`` gets how many were read, had a time and a place, and were in some ZIP."""
    typed = S.typed(incidents, latitude="double", longitude="double").withColumn("ts", N.utc_time("incident_datetime"))
    typed = A.watched(typed, counters, "read", dated=F.col("ts").isNotNull(), with_place=F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    rows = typed.dropna(subset=["ts", "latitude", "longitude"])
    placed = J.assign_area_small(R.since(rows, "ts", start), areas, "latitude", "longitude", cell=cell).withColumn("month", N.month_of("ts"))
    placed = A.watched(placed, counters, "placed", with_zip=F.col("zip_code").isNotNull())
    return A.category_counts(placed, ["zip_code", "month"], "incident_category", A.VIOLENCE, "crime_total_month_zip")


def incident_features(panel: DataFrame, population: DataFrame) -> DataFrame:
    """The panel on a full grid of months, with trailing means, shares, trend and the month's rate."""
    names = ["crime_total_month_zip", "crime_violent_month_zip", "crime_property_month_zip"]
    short = dict(zip(names, ["total", "violent", "property"], strict=True))
    grid = R.month_grid(panel.withColumnsRenamed(short), "zip_code", "month", list(short.values()), population)
    rolled = A.rolling_means(grid, "zip_code", "month", list(short.values()), [3, 12])
    with_people = rolled.join(population, "zip_code", "left")
    return with_people.withColumns(
        {
            "violent_share": N.share_or_zero("violent", "total"),
            "trend_3_vs_12": F.when(F.col("total_12m") > 0, F.col("total_3m") / F.col("total_12m") - 1).otherwise(0.0),
            "rate_per_1k": N.rate_per_1000("total", "population"),
        }
    )


def category_breakdown(incidents: DataFrame, areas: DataFrame, n: int = 6, cell: float = 0.02) -> DataFrame:
    """Each ZIP's most frequent categories of the last twelve months. A ZIP column, if there is one, is used as it is."""
    rows = incidents.withColumn("ts", N.utc_time("incident_datetime")).withColumn("incident_category", F.coalesce("incident_category", F.lit("Unknown")))
    if "zip_code" not in rows.columns:
        rows = J.assign_area(S.typed(rows, latitude="double", longitude="double"), areas, "latitude", "longitude", cell=cell)
    else:
        rows = rows.withColumn("zip_code", X.standard_zip("zip_code"))
    return A.top_categories(R.trailing_months(rows, "ts", 12), "zip_code", "incident_category", n)
