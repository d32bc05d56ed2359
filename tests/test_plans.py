import os
import random
from datetime import datetime, timedelta

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rentloom.functions import constants as C
from rentloom.operators import modelling as M
from rentloom.plans import listings as L
from rentloom.plans import panels as P
from rentloom.plans import queries_relational as Q


def months(spark, rows, schema):
    return spark.createDataFrame(rows, schema).withColumn("month", F.to_timestamp("month"))


def test_incident_features(spark):
    panel = months(spark, [("94110", "2024-01-01", 10, 1, 5), ("94110", "2024-02-01", 20, 2, 7), ("94110", "2024-03-01", 30, 6, 10), ("94103", "2024-03-01", 5, 0, 1)], "zip_code string, month string, crime_total_month_zip int, crime_violent_month_zip int, crime_property_month_zip int")
    people = spark.createDataFrame([("94110", 1000), ("94103", 2000)], "zip_code string, population long")
    got = {(r.zip_code, r.month.month): r for r in P.incident_features(panel, people).collect()}
    assert len(got) == 6
    last = got["94110", 3]
    assert (last.total_3m, last.violent_3m, last.rate_per_1k) == (20.0, 3.0, 30.0) and last.trend_3_vs_12 == 0.0
    assert got["94103", 1].total == 0 and got["94103", 1].violent_share == 0.0


def test_features(spark):
    listings = spark.createDataFrame([("94110", "2024-02-10", 3000.0, "1 Bed 1 Bath"), ("00000", None, 2500.0, "Studio")], "zip_code string, date string, rent_usd double, beds_baths string").withColumn("date", F.to_timestamp("date"))
    static = spark.createDataFrame([("94110", 90.0, 80.0, 100000.0)], "zip_code string, walk_score double, transit_score double, census_median_income double")
    index = lambda v: spark.createDataFrame([("94110", "2024-01-31", 10.0)], f"zip_code string, date string, {v} double").withColumn("date", F.to_timestamp("date"))
    crime = months(spark, [("94110", "2024-02-01", 1.5)], "zip_code string, month string, crime_total_month_zip_log1p double")
    trend = months(spark, [("San Francisco, CA", "2024-01-01", 0.8, 6.9), ("Other", "2024-02-01", 9.0, 9.0)], "region string, month string, redfin_mom_pct double, redfin_yoy_pct double")
    out = L.build_features(listings, static, index("zori_rent"), index("zhvi_value"), crime, trend)
    assert out.columns == C.FEATURE_COLUMNS
    row = out.where("zip_code = '94110'").first()
    assert (row.zori_baseline, row.redfin_mom_pct, row.crime_total_month_zip_log1p_latest, row.bedrooms_x_census_income) == (10.0, 0.8, 1.5, 100000.0)
    assert out.count() == 2


def test_representative_cases(spark):
    rows = [("94110", "over", 9.0), ("94110", "under", 8.0), ("94103", "under", 7.0), ("94105", "edge", 1.0), ("94107", "edge", 2.0)]
    scored = spark.createDataFrame(rows, "zip_code string, category string, gap double")
    got = M.representative_cases(scored, {"over": [F.desc("gap")], "under": [F.desc("gap")]}, total=4).collect()
    assert [(r.zip_code, r.category) for r in got[:2]] == [("94110", "over"), ("94103", "under")] and len(got) == 4
    with pytest.raises(ValueError):
        L.clean_listings(spark.createDataFrame([("x",)], "address string"))


def test_month_rollup_of_shuffled_files(spark, tmp_path):
    rng = random.Random(4)
    start = datetime(2024, 1, 1)
    (tmp_path / "events.parquet").mkdir()
    order = rng.sample(range(20), 20)
    for place, k in enumerate(order):
        times = [start + timedelta(days=4 * k, minutes=rng.randrange(4 * 24 * 60)) for _ in range(30)] + [None]
        values = [rng.choice([10.0, 90.0, None]) for _ in times]
        kinds = [rng.choice(["click", "view", None]) for _ in times]
        name = tmp_path / "events.parquet" / f"part-{place:02d}.parquet"
        pq.write_table(pa.table({"event_id": list(range(31)), "ts": pa.array(times, pa.timestamp("us")), "event_type": kinds, "value": pa.array(values, pa.float64())}), name)
        os.utime(name, (1_700_000_000 + place, 1_700_000_000 + place))
    got = {tuple(r) for r in Q.stream_month_rollup(spark, str(tmp_path)).select("event_type", "month", "n", "large").collect()}
    sql = Q.ORACLE["stream_month_rollup"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == set(duckdb.sql(sql).fetchall()) and sum(r[2] for r in got) == 620


def test_clean_data_set_with_and_without_sources(spark, tmp_path):
    """The whole clean-up job over files: what there is gets written, joined where both sides are there, and read again."""
    ids = "RegionID,RegionName,SizeRank,City,State,2017-01-31,2018-01-31,2020-06-30\n"
    (tmp_path / "rent.csv").write_text(ids + "".join(f"1,{z},1,SF,CA,2000,2500,2600\n" for z in (94110, 94103, 94104, 99999)))
    (tmp_path / "value.csv").write_bytes((ids.replace("City", "Citt\u00e0") + "1,94110,1,SF,CA,1,900000,910000\n").encode("latin-1"))
    (tmp_path / "trend.csv").write_bytes("Region\tStart\tMedianRent\tRentMoM\tRentYoY\nSan Francisco, CA\t2024-01-01\t$3,000\t+0.8%\t-6.9%\nOther\tsoon\t\tx\t1%\n".encode("utf-16"))
    census = spark.createDataFrame([("94110", "100", "-666666666"), ("94104", "5", "6"), ("x", "1", "2")], "zip_code string, median_income string, median_rent string")
    raw = spark.createDataFrame([("1 A St, San Francisco, CA 94110", "x", "Studio $2,800 / 1 Bed $3,400", "https://x/1", "2024-05-03"), ("2 B St, CA 94103", "1 Bed $900", None, None, None)], "address string, beds_baths string, pricing string, url string, scraped_at string")
    area = spark.createDataFrame([("94110", [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0], [0.0, 0.0]], 0)], "zip_code string, contour array<array<double>>, position long")
    crimes = spark.createDataFrame([("2024-05-01T00:00:00.000", c, "0.5", "0.5") for c in ("Assault", "Burglary", "Other")], "incident_datetime string, incident_category string, latitude string, longitude string")
    tables = {
        "rent_index": P.clean_rent_index(spark, str(tmp_path / "rent.csv")), "value_index": P.clean_value_index(spark, str(tmp_path / "value.csv")), "trend": P.clean_trend(spark, str(tmp_path / "trend.csv")),
        "census": P.clean_census(census, ["median_income", "median_rent"]), "listings": L.clean_listings(raw), "incidents": P.incident_panel(crimes, area),
    }
    out = str(tmp_path / "out")
    panel = L.build_clean_dataset(spark, tables, out)
    read = lambda name: spark.read.parquet(f"{out}/{name}").collect()
    assert {(r.zip_code, str(r.date)[:10], r.zori_rent, r.zhvi_value) for r in read("panel")} == {("94110", "2018-01-31", 2500.0, 900000.0), ("94110", "2020-06-30", 2600.0, 910000.0)} and panel.count() == 2
    assert sorted((r.zip_code, r.rent_usd, r.crime_total_month_zip, r.crime_violent_month_zip) for r in read("listings")) == [("94103", 900.0, 0, 0), ("94110", 2800.0, 3, 1), ("94110", 3400.0, 3, 1)]
    assert {(r.region, r.median_rent, r.redfin_mom_pct, r.redfin_yoy_pct) for r in read("trend")} == {("San Francisco, CA", 3000.0, 0.8, -6.9), ("Other", None, None, 1.0)}
    assert [(r.zip_code, r.median_income, r.median_rent) for r in read("census")] == [("94110", 100.0, None)]
    assert {r.zip_code for r in read("rent_index")} == {"94110", "94103"}
    some = str(tmp_path / "some")
    assert L.build_clean_dataset(spark, tables | {"value_index": None, "incidents": None, "trend": None}, some) is None
    assert sorted(os.listdir(some)) == ["census", "listings", "rent_index"]
    assert "crime_total_month_zip" not in spark.read.parquet(f"{some}/listings").columns


def test_scores_without_a_cache(spark):
    listings = spark.createDataFrame([("1 A St", None, "94110")], "address string, url string, zip_code string")
    row = L.enrich_scores(listings, None, None).first()
    assert row.walk_score is None and row.bike_description is None and row.address == "1 A St"


def test_payloads_are_read_once(spark):
    """What is claimed and joined comes from rows that are written, not read from their texts again; when an area's offers
    are gone the rest gets none."""
    rows = [(k, 100.0 * (k % 5), f"{{'zip_code': '0000{k % 3}', 'bedrooms': {k % 2}, 'name_of': {['None', 'True', chr(39) + 'None' + chr(39)][k % 3]}}}") for k in range(30)]
    scored = spark.createDataFrame(rows, "position long, actual_rent_usd double, payload string").coalesce(1)
    offers = spark.createDataFrame([(f"0000{o % 2}", o, "1 Bed" if o % 4 else None, 100.0 * o) for o in range(6)], "zip_code string, offer long, label string, price double")
    places = spark.createDataFrame([("00001", 1.0, 2.0)], "zip_code string, lat double, lon double")
    out = L.rankable(scored, "payload", "zip_code string, bedrooms double, name_of string", offers, places)
    assert "from_json" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.position: r for r in out.collect()}
    assert len(got) == 30 and sorted(r.offer for r in got.values() if r.offer is not None) == list(range(6))
    assert all(r.offer is None or (r.zip_code == f"0000{r.offer % 2}" and r.position < 18) for r in got.values())
    assert [got[k].name_of for k in range(3)] == [None, "true", "None"] and got[4].lat == 1.0 and got[3].listing_id == "L003"


def test_models_are_fitted_in_full(spark, monkeypatch):
    """The queries that give a model's predictions train with the operators' own rounds and trees."""
    rounds, trees, whole, bands = [], [], M.point_pipeline, M.LeafQuantiles

    def small(*args, **kw):
        rounds.append(whole(*args, **kw).getStages()[-1].getMaxIter())
        return whole(*args, **kw | {"rounds": 2})

    def few(*args, **kw):
        band = bands(*args, **kw)
        trees.append((band.trees, band.depth))
        return bands(*args, **kw | {"trees": 2, "depth": 2})

    monkeypatch.setattr(M, "point_pipeline", small)
    monkeypatch.setattr(M, "LeafQuantiles", few)
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/orders.parquet").count()
    assert Q.gbt_predict(spark, sf).count() == n and Q.feature_contributions(spark, sf).count() == 2 * n
    assert rounds == [220, 220] and trees == [(20, 5)]
