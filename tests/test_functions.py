import pytest
from pyspark.sql import functions as F

from rentloom.functions import numbers as N
from rentloom.functions import text as X


def values(spark, f, cells, kind="string"):
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cells)], f"k int, c {kind}")
    return [r.v for r in df.select("k", f(F.col("c")).alias("v")).orderBy("k").collect()]


@pytest.mark.parametrize(
    "function, cells, want",
    [
        (X.standard_zip, ["94110", "94103", "9414", "abc", None, "-1", "100000", "94110.0", "94110d"], ["94110", "94103", "09414", None, None, None, None, "94110", None]),
        (X.money, ["$3,250", "  $1,000.50 ", "", "nan", None, "not-a-number"], [3250.0, 1000.5, None, None, None, None]),
        (X.percent, ["+2.5%", "-1.25%", "0", None, "1,000%"], [2.5, -1.25, 0.0, None, None]),
        (X.square_feet, ["Studio, 942 sq ft, $3,000", "1 Bed, 1,100 sq. ft.", "none", "0 sq ft"], [942.0, 1100.0, None, None]),
        (X.strip_square_feet, ["Studio, 942 sq ft ,", "2  Beds"], ["Studio", "2 Beds"]),
        (X.first_rent, ["from $ 3,500+", "none"], [3500.0, None]),
        (X.zip_of_address, ["123 Market St, San Francisco, CA 94103", "x"], ["94103", None]),
        (X.address_from_title, ["Isle House 39 Bruton St", "none"], ["39 Bruton St", None]),
        (X.bedrooms, ["Studio", "2 Beds+ 1.5 Baths", "nothing"], [0.0, 2.0, None]),
        (X.bathrooms, ["Studio", "2 Beds+ 1.5 Baths"], [None, 1.5]),
        (X.title_from_slug, ["https://x/apartments/isle-house-39%20st/", "https://x/a-b+c.html"], ["Isle House 39 St", "A B+c"]),
        (X.street_of_slug, ["14-isis-st-san-francisco-ca-unit-4", "yp192jvx"], ["14 isis st", None]),
    ],
)
def test_text(spark, function, cells, want):
    assert values(spark, function, cells) == want


def test_floorplans(spark):
    got = values(spark, X.floorplans, ["Studio $2,500 / 1 Bed $3,100 / 2 Beds $4,250+ / 3 Beds+ $6,000", "studio no price", None])
    assert [(p.label, p.rent) for p in got[0]] == [("Studio", 2500.0), ("1 Bed", 3100.0), ("2 Beds", 4250.0), ("3 Beds+", 6000.0)]
    assert got[1:] == [[], []]
    units = values(spark, X.unit_prices, ["1 Bed+ $3,862+"])[0]
    assert [(u.unit, u.price) for u in units] == [("1 Bed+", "$3,862+")]


def test_recovery(spark):
    rows = [("Unit 1315 at 388 Beale", None, None), (None, "https://www.a.example/14-isis-st-san-francisco-ca-unit-4/yp192jv/", None), ("letters only", "https://a.example/yp192jv/", "94110.0"), (None, None, None), ("388 Beale", None, None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, a string, u string, z string")
    got = [tuple(r.r) for r in df.select("k", X.recover_address("a", "u", "z").alias("r")).orderBy("k").collect()]
    assert got == [("388 Beale", "address_normalized"), ("14 isis st", "url"), ("94110, San Francisco, CA", "zip_fallback"), (None, "none"), ("388 Beale", "address")]


def test_labels(spark):
    assert values(spark, lambda c: X.score_label(c, "walk"), [95.0, 70.0, 24.0, None, float("nan")], "double") == ["Walker's Paradise", "Very Walkable", "Car-Dependent", None, None]
    assert values(spark, lambda c: X.score_label(c, "boat"), [95.0], "double") == [None]
    assert values(spark, X.bed_label, [0.0, 2.0], "double") == ["Studio", "2 Bed"]
    assert values(spark, X.listing_id, [7, 12345], "long") == ["L007", "L12345"]


def test_numbers(spark):
    assert values(spark, N.utc_time, ["2024-05-01T00:00:00.000", "bad", None])[1:] == [None, None]
    assert values(spark, N.from_log, [0.0, -5.0, None], "double") == [0.0, 0.0, None]
    got = values(spark, lambda c: N.heuristic_rent(c, F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("double")), [0.0, 1.0, 3.0, 50.0], "double")
    assert got == sorted(got) and all(1500 <= v <= 12000 for v in got)
    assert values(spark, lambda c: N.share_or_zero(c, c), [0.0, 2.0, None], "double") == [0.0, 1.0, 0.0]
