import pytest
from pyspark.sql import functions as F

from rentloom.operators import aggregates as A
from rentloom.operators import joins as J
from rentloom.operators import modelling as M
from rentloom.operators import ranking as K
from rentloom.operators import reshape as R
from rentloom.plans import listings as L
from rentloom.plans import panels as P
from rentloom.sources import html as H
from rentloom.sources import tables as S


def square(lon, lat, side=0.01):
    return [[lon, lat], [lon + side, lat], [lon + side, lat + side], [lon, lat + side], [lon, lat]]


@pytest.fixture
def areas(spark):
    return spark.createDataFrame([("94110", square(-122.42, 37.74), 0), ("94103", square(-122.41, 37.77), 1)], "zip_code string, contour array<array<double>>, position long")


def test_points(spark, areas):
    points = spark.createDataFrame([(1, 37.745, -122.415), (2, 37.775, -122.405), (3, 0.0, 0.0), (4, None, -122.4), (5, 37.7, None)], "k int, lat double, lon double")
    for out in (J.assign_area(points, areas), J.assign_area_small(points, areas)):
        assert {r.k: r.zip_code for r in out.collect()} == {1: "94110", 2: "94103", 3: None, 4: None, 5: None}


def test_incident_panel(spark, areas):
    rows = [("2024-05-01T00:00:00.000", c, la, lo) for c, la, lo in [("Assault", "37.745", "-122.415"), ("Burglary", "37.745", "-122.415"), ("Arson", "37.745", "-122.415"), ("Other", "37.745", "-122.415"), ("Robbery", "37.775", "-122.405"), ("Fraud", "37.775", "-122.405"), ("Rape", "bad", "-122.405")]]
    df = spark.createDataFrame(rows, "incident_datetime string, incident_category string, latitude string, longitude string")
    got = {r.zip_code: (r.crime_total_month_zip, r.crime_violent_month_zip, r.crime_property_month_zip) for r in P.incident_panel(df, areas).collect()}
    assert got == {"94110": (4, 1, 2), "94103": (2, 1, 1)}


def test_index_panel(spark):
    cols = ["RegionID", "RegionName", "SizeRank", "City", "State", "2017-01-31", "2018-01-31", "2020-06-30"]
    raw = spark.createDataFrame([("1", z, "1", "SF", "CA", "2000", "2500", "2600") for z in ("94110", "94103", "94104", "99999")], ", ".join(f"`{c}` string" for c in cols))
    got = P.index_panel(raw, "zori_rent", ["94104"])
    assert got.columns[:3] == ["zip_code", "date", "zori_rent"]
    rows = got.collect()
    assert {r.zip_code for r in rows} == {"94110", "94103"} and min(str(r.date) for r in rows) >= "2018-01-01"


def test_listings(spark):
    raw = spark.createDataFrame(
        [("123 Market St, San Francisco, CA 94103", "x", "Studio $2,800 / 1 Bed $3,400", "https://x/1", "2023-05-01"), ("9 Valencia, CA 94110", "1 Bed $3,500, 900 sq ft", None, "https://x/2", "2023-05-01"), ("no zip", "1 Bed $3,500", None, None, None), ("1 A, CA 94110", "call us", None, None, "2023-05-01")],
        "address string, beds_baths string, pricing string, url string, scraped_at string",
    )
    got = sorted((r.zip_code, r.beds_baths, r.rent_usd, r.sqft) for r in L.clean_listings(raw).collect())
    assert got == [("94103", "1 Bed", 3400.0, None), ("94103", "Studio", 2800.0, None), ("94110", "1 Bed", 3500.0, 900.0)]


def test_asof_fallbacks(spark):
    panel = spark.createDataFrame([("a", "2024-01-01", 1.0), ("a", "2024-03-01", None), ("a", "2024-05-01", 5.0)], "z string, m string, v double").withColumn("month", F.to_timestamp("m")).drop("m")
    left = spark.createDataFrame([(1, "a", "2024-01-01"), (2, "a", "2024-02-01"), (3, "a", "2024-04-01"), (4, "a", "2023-01-01"), (5, "b", "2024-01-01"), (6, "a", None)], "k int, z string, m string").withColumn("month", F.to_timestamp("m")).drop("m")
    got = {r.k: (r.v, r.provenance) for r in J.asof_join(left, panel, ["v"], "month", "z").collect()}
    assert got == {1: (1.0, "exact"), 2: (1.0, "asof"), 3: (5.0, "latest"), 4: (5.0, "latest"), 5: (None, "none"), 6: (5.0, "latest")}
    assert J.asof_join(left, panel, ["v"], "month", "z", fallback="none").where("provenance = 'latest'").count() == 0


def test_rolling_grid(spark):
    panel = spark.createDataFrame([("a", "2024-01-01", 10), ("a", "2024-03-01", 30), ("b", "2024-02-01", 4)], "zip_code string, m string, n int").withColumn("month", F.to_timestamp("m")).drop("m")
    grid = R.month_grid(panel, "zip_code", "month", ["n"])
    assert grid.count() == 6
    last = A.rolling_means(grid, "zip_code", "month", ["n"], [3]).where("zip_code = 'a'").orderBy(F.desc("month")).first()
    assert last.n_3m == pytest.approx(40 / 3)


def test_left_features_and_uniqueness(spark):
    left = spark.createDataFrame([(1, "a", 999), (2, "b", 999)], "k int, z string, n int")
    right = spark.createDataFrame([("a", 3)], "z string, n int")
    assert {r.k: r.n for r in J.left_features(left, right, ["z"], {"n": 0}).collect()} == {1: 3, 2: 0}
    with pytest.raises(ValueError):
        J.check_unique(right.union(right), ["z"])


def test_imputation_and_gate(spark):
    df = spark.createDataFrame([("a", 80.0), ("a", None), ("b", None), (None, None)], "zip_code string, walk_score double")
    got = A.impute_scores(df, ["walk"])
    assert got.where("walk_score != 80").count() == 0 and got.where("walk_description = 'Very Walkable'").count() == 4
    with pytest.raises(ValueError):
        A.require_complete(df, ["walk_score"])


def test_ranking(spark):
    assert sum(K.normal_weights({"safety": -1, "walk": 2}).values()) == pytest.approx(1) and K.normal_weights({}) == pytest.approx(dict.fromkeys(K.COMPONENTS, 1 / 3))
    df = spark.createDataFrame([(1, 40.0, 40.0, 8.0), (0, 99.0, 99.0, 2.0), (2, None, None, None)], "k int, w double, t double, c double")
    rows = K.rank_listings(df, {"safety": 1, "walk": 1, "transit": 1}, "c", "w", "t", "k", 2).orderBy("rank").collect()
    assert [r.k for r in rows] == [0, 2] and rows[0].n_input == 3 and rows[0].n_returned == 2
    same = spark.createDataFrame([(1, 1.0), (2, 1.0)], "k int, c double").withColumns({"w": F.lit(None).cast("double"), "t": F.lit(None).cast("double")})
    assert {r.safety for r in K.score_components(same, "c", "w", "t").collect()} == {1.0}


def test_claims_are_made_once(spark):
    wanted = spark.createDataFrame([("a", 0, "1 Bed", 3000.0), ("a", 1, "1 Bed", 3010.0), ("a", 2, None, 9000.0)], "z string, position long, label string, price double")
    offers = spark.createDataFrame([("a", 0, "1 Bed", 3005.0), ("a", 1, "2 Bed", 3000.0), ("a", 2, "Studio", None)], "z string, offer long, label string, price double")
    got = {r.position: r.offer for r in J.claim_once(wanted, offers, "z", "string").collect()}
    assert got[0] == 0 and len(set(got.values())) == 3


def test_conformal_covers(spark):
    df = spark.range(200).select((F.col("id") % 100).cast("double").alias("y"), F.lit(45.0).alias("lo"), F.lit(55.0).alias("hi"))
    row = M.conformal(df, "y", "lo", "hi").first()
    assert row.coverage >= 0.5 and row.offset > 0 and row.coverage_raw < row.coverage


def test_validation(spark):
    df = spark.createDataFrame([("94110", 2.0, 100.0), ("941", -1.0, 0.0), (None, None, None)], "zip_code string, bedrooms double, actual_rent_usd double")
    got = [(r.valid, list(r.failed)) for r in R.validate(df, required=["zip_code"], lengths={"zip_code": 5}).collect()]
    assert got == [(True, []), (False, ["zip_code_length", "bedrooms_range", "actual_rent_usd_range"]), (False, ["zip_code_required"])]


def test_html(spark):
    html = '<ul><li class="result"><a href="/x"><span class="title">A b</span></a><b class="price">$1,200</b></li><li class="result"><a>no link</a></li></ul>'
    pages = spark.createDataFrame([(1, html), (2, '<a href="http://y">C $3 Mission</a>'), (3, None)], "page_id long, html string")
    got = sorted(tuple(r) for r in H.listing_cards(pages, [{"card": ".result", "title": ".title", "price": ".price"}], "https://b").collect())
    assert got == [(1, 0, "A b", "https://b/x", 1200.0, None), (2, 0, "C", "http://y", 3.0, "Mission")]
    detail = spark.createDataFrame([(1, "<li>In Unit  Laundry</li><li>Dishwasher</li><li>dishwasher</li>"), (2, "")], "page_id long, html string")
    assert {r.page_id: r.amenities for r in H.amenities(detail, ["li"]).collect()} == {1: "In Unit Laundry | Dishwasher", 2: ""}


def test_sources(spark, tmp_path):
    (tmp_path / "trend.csv").write_bytes("Region\tStartMonth\tMedianRent\tRentMoM\tRentYoY\nSan Francisco, CA\t2024-01-01\t$3,000\t+0.8%\t6.9%\n".encode("utf-16"))
    row = P.clean_trend(spark, str(tmp_path / "trend.csv")).first()
    assert (row.median_rent, row.redfin_mom_pct, row.redfin_yoy_pct) == (3000.0, 0.8, 6.9)
    (tmp_path / "m.json").write_text('[["NAME","zip code tabulation area"],["a","94110"],["b","94103"]]')
    assert S.read_json_matrix(spark, str(tmp_path / "m.json"), ["NAME", "zip code tabulation area"]).count() == 2
    (tmp_path / "p.json").write_text('[{"zipcode": 94110, "population": 5, "contour": [[0,0],[0,1],[1,1],[0,0]]}, {"zipcode": 94103, "contour": [[0,0],[1,1]]}, {"zipcode": "abc", "contour": [[0,0],[0,1],[1,1],[0,0]]}]')
    assert [r.zip_code for r in S.read_polygons(spark, str(tmp_path / "p.json")).collect()] == ["94110"]
    with pytest.raises(ValueError):
        S.require(spark.range(1), ["x"])


def test_paged_feed(spark):
    parts = S._PagedReader({"total": "7", "page": "3", "fetcher": "itertools:repeat"}).partitions()
    assert [p.value for p in parts] == [0, 3, 6]
    spark.dataSource.register(S.PagedFeed)
    df = spark.read.format("paged_feed").options(total=7, page=3, schema="k long", fetcher="x:y").load()
    assert df.schema.simpleString() == "struct<k:bigint>"
