"""Listings: cleaning, expansion, features and the whole data set."""

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
from rentloom.sources.staging import materialize


def clean_listings(raw: DataFrame, start: str = C.START_DATE, rents: tuple = C.RENT_RANGE) -> DataFrame:
    """Scraped rows as one typed row per floor plan, inside the rent range and from the start date on."""
    S.require(raw, ["address", "beds_baths"])
    title = "title" if "title" in raw.columns else None
    when = N.utc_time("scraped_at") if "scraped_at" in raw.columns else F.lit(None).cast("timestamp")
    url = F.col("url") if "url" in raw.columns else F.lit(None).cast("string")
    rows = raw.withColumns({"zip_code": X.standard_zip(X.zip_of_address("address", title)), "date": when, "url": url})
    out = R.expand_units(rows).select(*C.LISTING_COLUMNS)
    kept = out.where(F.col("zip_code").isNotNull() & F.col("rent_usd").between(*rents))
    return kept.where(F.col("date").isNull() | (F.col("date") >= F.lit(start).cast("timestamp")))


def combined_listings(raw: DataFrame) -> DataFrame:
    """Property rows as one row per unit type, with the address filled from the title and the ZIP from either."""
    filled = raw.withColumn("address", F.coalesce("address", X.address_from_title("title")))
    filled = filled.withColumn("zip_code", F.coalesce(X.first_zip("address"), X.first_zip("title")))
    return R.expand_unit_prices(filled).select("title", "beds_baths", "pricing", "address", "zip_code", "url", "scraped_at")


def merge_sources(curated: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """Both, without repeats of the keys; the curated row wins, then the earlier one. Both have a position column."""
    rows = curated.withColumn("__p", F.lit(0)).unionByName(more.withColumn("__p", F.lit(1)), allowMissingColumns=True)
    return J.keep_first(rows, keys, ["__p", "position"]).drop("__p")


def first_seen(rows: DataFrame, position: str = "position") -> DataFrame:
    """The first row of each url, or of title and address where there is no url."""
    key = F.coalesce(F.nullif("url", F.lit("")), F.concat_ws("|", "title", "address"))
    return J.keep_first(rows.withColumn("__key", key), ["__key"], [position]).drop("__key")


def build_features(listings: DataFrame, static: DataFrame, rent_index: DataFrame, value_index: DataFrame, incidents: DataFrame, trend: DataFrame, metro: str = "san francisco") -> DataFrame:
    """The feature table: static values by ZIP, panels as of the listing's month, products."""
    rows = listings.withColumns({"listing_month": N.month_of("date"), "bedrooms": X.bedrooms("beds_baths"), "bathrooms": X.bathrooms("beds_baths")})
    rows = rows.join(static, "zip_code", "left")
    month = lambda df: df.withColumn("listing_month", N.month_of("date" if "date" in df.columns else "month"))
    rent = A.means(month(rent_index), ["zip_code", "listing_month"], ["zori_rent"]).withColumnRenamed("zori_rent", "zori_baseline")
    value = A.means(month(value_index), ["zip_code", "listing_month"], ["zhvi_value"]).withColumnRenamed("zhvi_value", "zhvi_level")
    value = A.lag_difference(value, "zip_code", "listing_month", "zhvi_level", 12, "zhvi_12mo_delta")
    crime = month(incidents).select("zip_code", "listing_month", F.col("crime_total_month_zip_log1p").alias("crime_total_month_zip_log1p_latest"))
    for panel, values in ((crime, ["crime_total_month_zip_log1p_latest"]), (rent, ["zori_baseline"]), (value, ["zhvi_level", "zhvi_12mo_delta"])):
        rows = J.asof_join(rows, panel, values, "listing_month", "zip_code").drop("provenance")
    market = A.means(R.matching_or_all(month(trend), "region", metro), ["listing_month"], ["redfin_mom_pct", "redfin_yoy_pct"])
    rows = J.asof_join(rows, market, ["redfin_mom_pct", "redfin_yoy_pct"], "listing_month").drop("provenance")
    rows = rows.withColumns({c: F.lit(None).cast("double") for c in C.MODEL_NUMERIC if c not in rows.columns})
    rows = rows.withColumns({"bedrooms_x_census_income": N.product("bedrooms", "census_median_income"), "walk_score_x_transit_score": N.product("walk_score", "transit_score")})
    return rows.select(*C.FEATURE_COLUMNS)


def manifest(features: DataFrame, target: str = "rent_usd") -> dict[str, DataFrame]:
    numeric = [f.name for f in features.schema if f.dataType.simpleString() == "double" and f.name != target]
    return {"null_rates": A.null_rates(features), "target": A.distribution(features, target), "correlations": A.strongest(A.correlations(features, target, numeric))}


def enrich_scores(listings: DataFrame, cache: DataFrame | None, centroids: DataFrame, city: tuple[float, float] = (37.7749, -122.4194)) -> DataFrame:
    """Scores from a cache by recovered address, imputed by ZIP and checked; null columns where there is no cache."""
    kinds = ["walk", "transit", "bike"]
    if cache is None:
        return listings.withColumns({f"{k}_score": F.lit(None).cast("double") for k in kinds} | {f"{k}_description": F.lit(None).cast("string") for k in kinds})
    query = X.recover_address("address", "url", "zip_code")
    rows = listings.withColumns({"raw_address": F.col("address"), "address": query["query"], "address_source": query["source"]})
    for c in ("lat", "lon"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("double"))
    scored = A.impute_scores(J.with_scores(rows, cache, centroids, city), kinds)
    return A.require_complete(scored, [f"{k}_score" for k in kinds] + [f"{k}_description" for k in kinds])


def build_clean_dataset(spark: SparkSession, tables: dict[str, DataFrame | None], out: str) -> DataFrame | None:
    """Writes each cleaned source that there is, listings with their incidents, and the joined index panel."""
    listings, incidents = tables.get("listings"), tables.get("incidents")
    if listings is not None and incidents is not None:
        fills = {"crime_total_month_zip": 0, "crime_violent_month_zip": 0, "crime_property_month_zip": 0, "crime_total_month_zip_log1p": 0.0}
        rows = listings.withColumn("month", N.month_of("date"))
        tables = tables | {"listings": J.left_features(rows, incidents, ["zip_code", "month"], fills)}
    S.write_tables(tables, out)
    rent, value = tables.get("rent_index"), tables.get("value_index")
    if rent is None or value is None:
        return None
    panel = rent.select("zip_code", "date", "zori_rent").join(value.select("zip_code", "date", "zhvi_value"), ["zip_code", "date"])
    S.write_tables({"panel": panel}, out)
    return panel


def rankable(scored: DataFrame, payload: str, schema: str, offers: DataFrame, centroids: DataFrame) -> DataFrame:
    """Scored units with their payload's fields, an id by position, a place, and the scraped listing claimed for each."""
    # Read once, by many tasks however few files there are, as claims go over the rows several times.
    rows = scored.repartition("position").withColumn("p", S.literal_struct(payload, schema)).select("position", "actual_rent_usd", "p.*")
    rows = materialize(rows.withColumns({"listing_id": X.listing_id("position"), "zip_code": X.standard_zip("zip_code"), "label": X.bed_label("bedrooms")}), "rankable-rows")
    claims = J.claim_once(rows.select("zip_code", "position", "label", F.col("actual_rent_usd").alias("price")), offers.select("zip_code", "offer", "label", "price"), "zip_code", "string")
    found = rows.join(claims.select("position", "offer"), "position", "left").join(offers.drop("zip_code", "label", "price"), "offer", "left")
    return X.with_centroid(found, "zip_code", centroids)


def enrich_details(listings: DataFrame, done: DataFrame | None, details: DataFrame) -> DataFrame:
    """Listings that aren't done yet, with the fields that their pages gave."""
    work = listings if done is None else J.not_done(listings, done, "url")
    return R.override(work, details, "url")
