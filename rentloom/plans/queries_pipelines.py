"""Queries over whole pipelines: cleaning, features, enrichment, scoring, audits. Rental columns are made from the columns
of the given tables, alike on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from rentloom.functions import constants as C
from rentloom.functions import numbers as N
from rentloom.functions import text as X
from rentloom.operators import aggregates as A
from rentloom.operators import joins as J
from rentloom.operators import modelling as M
from rentloom.operators import ranking as K
from rentloom.operators import reshape as R
from rentloom.plans import listings as L
from rentloom.plans import panels as P
from rentloom.plans.queries_relational import _PARTS, areas, events, priced_parts
from rentloom.sources import tables as S
from rentloom.sources.staging import materialize

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def zip_of(key):
    """A ZIP of the city for a nation's number."""
    return F.element_at(F.array(*[F.lit(z) for z in C.CITY_ZIPS]), (key + 1).cast("int"))


_CITY = f"[{', '.join(repr(z) for z in C.CITY_ZIPS)}]"
_BY_MONTH = "SELECT c_nationkey AS k, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, count(*) AS n, sum(o_totalprice) AS v, avg(o_totalprice) AS a FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"


def nation_months(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("c_nationkey").alias("k"), N.month_of("o_orderdate").alias("m")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("v"), F.avg("o_totalprice").alias("a"))


def wide_index(spark, sf_dir):
    """An index as it is published: a row per region, a column per month, numbers as text."""
    rows = nation_months(spark, sf_dir).withColumn("month", F.date_format("m", "yyyy-MM-dd"))
    wide = rows.groupBy("k").pivot("month").agg(F.first(F.round("v", 2).cast("string")))
    name = F.when(F.col("k") == 24, "99999").otherwise(zip_of(F.col("k")))
    return wide.withColumns({"RegionName": name, "SizeRank": F.col("k").cast("string"), "City": F.lit("SF")}).drop("k")


@query(f"""
WITH m AS ({_BY_MONTH}), z AS (SELECT *, {_CITY}[k + 1] AS zip_code FROM m WHERE k < 24),
d AS (SELECT DISTINCT m FROM m WHERE m >= TIMESTAMP '1998-01-01'), g AS (SELECT * FROM (SELECT DISTINCT k, zip_code FROM z) CROSS JOIN d)
SELECT g.zip_code, g.m AS date, round(z.v, 2) AS zori_rent, CAST(g.k AS VARCHAR) AS rank, 'SF' AS city FROM g LEFT JOIN z ON g.k = z.k AND g.m = z.m WHERE g.zip_code NOT IN ({", ".join(repr(z) for z in C.SPARSE_ZIPS)})
""")
def index_panel(spark, sf_dir):
    """PL01, PL02: ZIP filter, unpivot, sparse ZIPs out."""
    panel = P.index_panel(wide_index(spark, sf_dir), "zori_rent", C.SPARSE_ZIPS, start="1998-01-01")
    return panel.select("zip_code", "date", "zori_rent", F.col("SizeRank").alias("rank"), F.col("City").alias("city"))


@query(f"""
SELECT {_CITY}[n_nationkey + 1] AS zip_code, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_nationkey * 1000.0 END AS median_income, n_regionkey + 0.5 AS median_rent FROM nation WHERE {_CITY}[n_nationkey + 1] != '94104'
""")
def census_clean(spark, sf_dir):
    """PL03, SM07: sentinels as null, one ZIP out."""
    n = table(spark, sf_dir, "nation")
    income = F.when(F.col("n_nationkey") % 5 == 0, "-666666666").otherwise((F.col("n_nationkey") * 1000).cast("string"))
    raw = n.select(zip_of(F.col("n_nationkey")).alias("zip_code"), income.alias("median_income"), (F.col("n_regionkey") + 0.5).cast("string").alias("median_rent"))
    return P.clean_census(raw, ["median_income", "median_rent"]).select("zip_code", "median_income", "median_rent")


@query(f"""
WITH c AS (SELECT c_nationkey AS k, min(c_custkey) AS first FROM customer GROUP BY 1),
v AS (SELECT k, first % 97 + 1.0 AS owners, first % 89 + 2.0 AS renters, CASE WHEN first % 4 = 0 THEN NULL ELSE first % 31 + 0.0 END AS vacant FROM c)
SELECT {_CITY}[k + 1] AS zip_code, owners, renters, round(renters / (owners + renters), 6) AS renter_ratio, round(vacant / (owners + renters + vacant), 6) AS vacancy_rate FROM v
""")
def census_shape(spark, sf_dir):
    """PL09, SM06, SO03: a row per ZIP, the first of several, with its ratios."""
    k = F.col("c_custkey")
    raw = table(spark, sf_dir, "customer").orderBy("c_custkey").select(
        zip_of(F.col("c_nationkey")).alias("zip code tabulation area"), F.lit("1").alias("B25064_001E"), F.lit("2").alias("B19013_001E"), F.lit("3").alias("B01003_001E"),
        F.when(k % 4 == 0, "-666666666").otherwise((k % 31).cast("string")).alias("B25002_003E"), (k % 97 + 1).cast("string").alias("B25003_002E"), (k % 89 + 2).cast("string").alias("B25003_003E"),
    )
    out = P.shape_census(raw)
    return out.select("zip_code", "owners", "renters", F.round("renter_ratio", 6).alias("renter_ratio"), F.round("vacancy_rate", 6).alias("vacancy_rate"))


_PANEL = """e AS (SELECT event_id, ts, event_type, (event_id * 37 % 1009) / 10.0 AS lon, (event_id * 91 % 997) / 10.0 AS lat FROM events),
z AS (SELECT *, CASE WHEN lon < 50 AND lat < 50 THEN '00001' WHEN lon >= 50 AND lon < 100 AND lat < 50 THEN '00002' WHEN lon >= 25 AND lon < 75 AND lat >= 25 AND lat < 75 THEN '00003' END AS zip_code FROM e),
c AS (SELECT *, CASE event_type WHEN 'error' THEN 'Assault' WHEN 'purchase' THEN 'Burglary' WHEN 'signup' THEN 'Larceny Theft' ELSE event_type END AS category, CAST(date_trunc('month', ts - INTERVAL (event_id % 7) MONTH) AS TIMESTAMP) AS month FROM z),
p AS (SELECT zip_code, month, count(*) AS total, count(*) FILTER (category = 'Assault') AS violent, count(*) FILTER (category IN ('Burglary', 'Larceny Theft')) AS property FROM c WHERE zip_code IS NOT NULL GROUP BY 1, 2)"""


def incidents(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", "Assault").when(F.col("event_type") == "purchase", "Burglary").when(F.col("event_type") == "signup", "Larceny Theft").otherwise(F.col("event_type"))
    when = F.date_format(F.col("ts").cast("timestamp") - F.make_ym_interval(F.lit(0), (F.col("event_id") % 7).cast("int")), "yyyy-MM-dd'T'HH:mm:ss")
    return events(spark, sf_dir).select(when.alias("incident_datetime"), kind.alias("incident_category"), F.col("lat").cast("string").alias("latitude"), F.col("lon").cast("string").alias("longitude"))


@query(f"WITH {_PANEL} SELECT zip_code, month, total AS crime_total_month_zip, violent AS crime_violent_month_zip, property AS crime_property_month_zip, round(ln(1 + total), 6) AS crime_total_month_zip_log1p FROM p")
def incident_panel(spark, sf_dir):
    """PL05, JN07, AG01, SM14."""
    return P.incident_panel(incidents(spark, sf_dir), areas(spark), cell=20.0).withColumn("crime_total_month_zip_log1p", F.round("crime_total_month_zip_log1p", 6))


@query(f"""WITH {_PANEL}, r AS (SELECT count(*) AS n, count(ts) AS dated, count(*) FILTER (lat IS NOT NULL AND lon IS NOT NULL) AS with_place, count(*) FILTER (zip_code IS NOT NULL AND month IS NOT NULL) AS with_zip FROM c)
SELECT 'read' AS step, 'rows' AS counter, n FROM r UNION ALL SELECT 'read', 'dated', dated FROM r UNION ALL SELECT 'read', 'with_place', with_place FROM r UNION ALL SELECT 'placed', 'rows', dated FROM r UNION ALL SELECT 'placed', 'with_zip', with_zip FROM r""")
def stage_counters(spark, sf_dir):
    """AG17: what passes each step of the incident job, from the one run that writes its panel."""
    counters = A.Counters()
    materialize(P.incident_panel(incidents(spark, sf_dir), areas(spark), cell=20.0, counters=counters), "panel")
    return counters.rows(spark)


@query(f"""WITH {_PANEL}, s AS (SELECT min(month) AS lo, max(month) AS hi FROM p),
pop(zip_code, population) AS (VALUES ('00001', 1000), ('00002', 0), ('00004', 50)),
g AS (SELECT zip_code, month FROM (SELECT DISTINCT zip_code FROM p UNION SELECT zip_code FROM pop) CROSS JOIN (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS TIMESTAMP) AS month FROM s)),
f AS (SELECT g.zip_code, g.month, coalesce(total, 0) AS total, coalesce(violent, 0) AS violent FROM g LEFT JOIN p ON p.zip_code = g.zip_code AND p.month = g.month),
r AS (SELECT *, avg(total) OVER w3 AS a, avg(total) OVER w12 AS b FROM f WINDOW w3 AS (PARTITION BY zip_code ORDER BY month ROWS 2 PRECEDING), w12 AS (PARTITION BY zip_code ORDER BY month ROWS 11 PRECEDING))
SELECT r.zip_code, month, total, round(a, 6) AS total_3m, round(b, 6) AS total_12m, round(CASE WHEN total > 0 THEN violent / total ELSE 0 END, 6) AS violent_share,
       round(CASE WHEN b > 0 THEN a / b - 1 ELSE 0 END, 6) AS trend, round(CASE WHEN population > 0 THEN total * 1000.0 / population END, 6) AS rate_per_1k FROM r LEFT JOIN pop ON pop.zip_code = r.zip_code""")
def incident_features(spark, sf_dir):
    """PL10: the grid, trailing means, share, trend and the month's rate."""
    people = spark.createDataFrame([("00001", 1000), ("00002", 0), ("00004", 50)], "zip_code string, population long")
    out = P.incident_features(P.incident_panel(incidents(spark, sf_dir), areas(spark), cell=20.0), people)
    return out.select("zip_code", "month", "total", *[F.round(c, 6).alias(n) for c, n in (("total_3m", "total_3m"), ("total_12m", "total_12m"), ("violent_share", "violent_share"), ("trend_3_vs_12", "trend"), ("rate_per_1k", "rate_per_1k"))])


@query(f"""WITH {_PANEL}, t AS (SELECT *, CAST(date_trunc('second', ts - INTERVAL (event_id % 7) MONTH) AS TIMESTAMP) AS seen FROM c),
w AS (SELECT zip_code, category, count(*) AS n FROM t WHERE zip_code IS NOT NULL AND seen > (SELECT max(seen) FROM t) - INTERVAL 12 MONTH GROUP BY 1, 2)
SELECT * FROM (SELECT zip_code, category AS incident_category, n AS count, round(n / sum(n) OVER (PARTITION BY zip_code), 6) AS share, CAST(row_number() OVER (PARTITION BY zip_code ORDER BY n DESC, category) AS INT) AS rank FROM w) WHERE rank <= 6""")
def category_breakdown(spark, sf_dir):
    """PL11, JN08, WN04, WN06."""
    return P.category_breakdown(incidents(spark, sf_dir), areas(spark), cell=20.0).withColumn("share", F.round("share", 6))


_SCRAPED = f"""s AS (SELECT p_partkey AS k, p_size, {_CITY}[p_partkey % 24 + 1] AS zip, CAST(floor(p_retailprice) AS BIGINT) AS a FROM part)"""


def scraped(spark, sf_dir):
    """Parts as scraped listings: two floor plans, one in the label, or a rent that is out of range."""
    p, k, a = table(spark, sf_dir, "part"), F.col("p_partkey"), F.floor("p_retailprice").cast("long").cast("string")
    address = F.concat(k.cast("string"), F.lit(" Main St, San Francisco, CA "), zip_of(k % 24))
    pricing = F.when(k % 3 == 0, F.concat(F.lit("Studio $"), a, F.lit(" / 2 Beds $1"), a, F.lit("+")))
    beds = F.when(k % 3 == 1, F.concat(F.lit("1 Bed $"), a, F.lit(", "), (F.col("p_size") + 500).cast("string"), F.lit(" sq ft"))).when(k % 3 == 2, F.concat(F.lit("Loft $"), a, F.lit("0"))).otherwise("x")
    return p.select(F.when(k % 11 != 0, address).alias("address"), F.when(k % 11 == 0, F.concat(F.lit("Tower, CA "), zip_of(k % 24))).alias("title"), beds.alias("beds_baths"), pricing.alias("pricing"), F.concat(F.lit("https://x/"), k.cast("string")).alias("url"), F.when(k % 5 != 0, "2023-05-01").when(k % 10 == 5, "2017-01-01").alias("scraped_at"))


@query(f"""WITH {_SCRAPED}, u AS (SELECT k, zip, 'Studio' AS label, a AS rent, NULL AS sqft FROM s WHERE k % 3 = 0 UNION ALL SELECT k, zip, '2 Beds', CAST('1' || a AS BIGINT), NULL FROM s WHERE k % 3 = 0
UNION ALL SELECT k, zip, '1 Bed', a, p_size + 500 FROM s WHERE k % 3 = 1 UNION ALL SELECT k, zip, 'Loft', a * 10, NULL FROM s WHERE k % 3 = 2)
SELECT zip AS zip_code, CASE WHEN k % 5 != 0 THEN TIMESTAMP '2023-05-01' END AS date, CAST(rent AS DOUBLE) AS rent_usd, label AS beds_baths, CAST(sqft AS DOUBLE) AS sqft, 'https://x/' || k AS url FROM u WHERE rent BETWEEN 500 AND 10000 AND k % 10 != 5""")
def listings_clean(spark, sf_dir):
    """PL06, RS02, PF09, PF07, SF10: floor plans as rows, inside the rent range, from the start date on."""
    return L.clean_listings(scraped(spark, sf_dir)).drop("address")


@query("""
WITH p AS (SELECT p_partkey AS k, CAST(floor(p_retailprice) AS BIGINT) AS a FROM part)
SELECT CASE WHEN k % 4 = 0 THEN 'Casa' ELSE k || ' Oak St 94110' END AS title, 'Studio' AS beds_baths, '$' || a AS pricing, CASE WHEN k % 2 = 0 THEN 'At 9410' || k % 5 WHEN k % 4 = 0 THEN NULL ELSE k || ' Oak St 94110' END AS address,
       CASE WHEN k % 2 = 0 THEN '9410' || k % 5 ELSE CASE WHEN k > 9999 THEN CAST(k AS VARCHAR) ELSE '94110' END END AS zip_code, 'u' || k AS url FROM p
UNION ALL SELECT CASE WHEN k % 4 = 0 THEN 'Casa' ELSE k || ' Oak St 94110' END, '1 Bed+', '$' || (a + 1) || '+', CASE WHEN k % 2 = 0 THEN 'At 9410' || k % 5 WHEN k % 4 = 0 THEN NULL ELSE k || ' Oak St 94110' END,
       CASE WHEN k % 2 = 0 THEN '9410' || k % 5 ELSE CASE WHEN k > 9999 THEN CAST(k AS VARCHAR) ELSE '94110' END END, 'u' || k FROM p WHERE k % 3 = 0
""")
def listings_combined(spark, sf_dir):
    """PL08, RS03, SF07, SF11, SF12."""
    k, a = F.col("p_partkey"), F.floor("p_retailprice").cast("long")
    title = F.when(k % 4 == 0, "Casa").otherwise(F.concat(k.cast("string"), F.lit(" Oak St 94110")))
    pricing = F.concat(F.lit("Studio  $"), a.cast("string"), F.when(k % 3 == 0, F.concat(F.lit(" / 1  Bed+ $"), (a + 1).cast("string"), F.lit("+"))).otherwise(""))
    raw = table(spark, sf_dir, "part").select(title.alias("title"), pricing.alias("pricing"), F.when(k % 2 == 0, F.concat(F.lit("At 9410"), (k % 5).cast("string"))).alias("address"), F.concat(F.lit("u"), k.cast("string")).alias("url"), F.lit("2024-01-01").alias("scraped_at"))
    return L.combined_listings(raw).drop("scraped_at")


@query(f"""
WITH l AS (SELECT o_orderkey AS k, c_nationkey AS z, o_totalprice AS rent, o_custkey % 4 AS beds, CASE WHEN o_orderkey % 9 != 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS date, CASE WHEN o_orderkey % 9 != 0 THEN CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) END AS lm FROM orders JOIN customer ON o_custkey = c_custkey),
m AS ({_BY_MONTH}), r AS (SELECT k, m, a FROM m WHERE n % 2 = 1), v AS (SELECT k, m, a AS lvl, a - lag(a, 12) OVER (PARTITION BY k ORDER BY m) AS d12 FROM m),
c AS (SELECT k, m, ln(1 + n) AS cr FROM m WHERE k % 5 != 0), x AS (SELECT m, avg(n) AS mom, avg(v) AS yoy FROM m WHERE k < 3 GROUP BY 1),
lr AS (SELECT k, arg_max(a, m) AS a FROM r GROUP BY 1), lv AS (SELECT k, arg_max(lvl, m) AS lvl, arg_max(coalesce(d12, -1e300), m) AS d12 FROM v GROUP BY 1), lc AS (SELECT k, arg_max(cr, m) AS cr FROM c GROUP BY 1), lx AS (SELECT arg_max(mom, m) AS mom, arg_max(yoy, m) AS yoy FROM x),
j1 AS (SELECT l.*, r.a FROM l ASOF LEFT JOIN r ON l.z = r.k AND l.lm >= r.m), j2 AS (SELECT j1.*, v.lvl, v.d12 FROM j1 ASOF LEFT JOIN v ON j1.z = v.k AND j1.lm >= v.m),
j3 AS (SELECT j2.*, c.cr FROM j2 ASOF LEFT JOIN c ON j2.z = c.k AND j2.lm >= c.m), j4 AS (SELECT j3.*, x.mom, x.yoy FROM j3 ASOF LEFT JOIN x ON j3.lm >= x.m)
SELECT j4.k AS listing, j4.z AS zip_code, beds + 0.0 AS bedrooms, round(coalesce(j4.cr, lc.cr), 6) AS crime, round(coalesce(j4.a, lr.a), 6) AS zori_baseline, round(coalesce(j4.lvl, lv.lvl), 6) AS zhvi_level, round(coalesce(j4.d12, nullif(lv.d12, -1e300)), 6) AS zhvi_12mo_delta,
       round(coalesce(j4.mom, lx.mom), 4) AS mom, round(beds * (CASE WHEN j4.z % 6 != 0 THEN j4.z * 100.0 END), 4) AS beds_x_income
FROM j4 LEFT JOIN lr ON lr.k = j4.z LEFT JOIN lv ON lv.k = j4.z LEFT JOIN lc ON lc.k = j4.z CROSS JOIN lx
""")
def feature_table(spark, sf_dir):
    """PL12: static values by ZIP, four panels as of the listing's month, products. The id travels as the unit label."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    label = F.concat((F.col("o_custkey") % 4).cast("string"), F.lit(" Beds #"), k.cast("string"))
    listings = o.select(F.col("c_nationkey").alias("zip_code"), F.when(k % 9 != 0, F.col("o_orderdate").cast("timestamp")).alias("date"), F.col("o_totalprice").alias("rent_usd"), label.alias("beds_baths"))
    static = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("zip_code"), F.when(F.col("n_nationkey") % 6 != 0, F.col("n_nationkey") * 100.0).alias("census_median_income"))
    m = nation_months(spark, sf_dir).withColumns({"zip_code": F.col("k"), "month": F.col("m")})
    trend = m.where("k < 3").select(F.lit("San Francisco, CA").alias("region"), "month", F.col("n").cast("double").alias("redfin_mom_pct"), F.col("v").alias("redfin_yoy_pct"))
    crime = m.where("k % 5 != 0").select("zip_code", "month", N.log_count("n").alias("crime_total_month_zip_log1p"))
    rent = m.where("n % 2 = 1").select("zip_code", F.col("m").alias("date"), F.col("a").alias("zori_rent"))
    out = L.build_features(listings, static, rent, m.select("zip_code", F.col("m").alias("date"), F.col("a").alias("zhvi_value")), crime, trend)
    rounded = {"crime": ("crime_total_month_zip_log1p_latest", 6), "zori_baseline": ("zori_baseline", 6), "zhvi_level": ("zhvi_level", 6), "zhvi_12mo_delta": ("zhvi_12mo_delta", 6), "mom": ("redfin_mom_pct", 4), "beds_x_income": ("bedrooms_x_census_income", 4)}
    return out.select(F.regexp_extract("beds_baths", "#([0-9]+)$", 1).cast("long").alias("listing"), "zip_code", "bedrooms", *[F.round(c, d).alias(n) for n, (c, d) in rounded.items()])


@query("""
WITH c AS (SELECT c_custkey AS k, c_nationkey AS z FROM customer), s AS (SELECT k, z, CASE WHEN k % 3 = 0 AND z < 20 THEN k % 100 + 0.0 END AS w FROM c),
f AS (SELECT k, coalesce(w, CASE WHEN z IS NOT NULL THEN avg(w) OVER (PARTITION BY z) END) AS w FROM s), g AS (SELECT k, round_even(coalesce(w, avg(w) OVER ()), 0) AS walk_score FROM f)
SELECT k AS listing, walk_score, CASE WHEN walk_score >= 90 THEN 'Walker''s Paradise' WHEN walk_score >= 70 THEN 'Very Walkable' WHEN walk_score >= 50 THEN 'Somewhat Walkable' ELSE 'Car-Dependent' END AS walk_description,
       CASE WHEN k % 2 = 0 THEN 'address' ELSE 'zip_fallback' END AS address_source, CASE WHEN k % 7 = 0 THEN 'address' ELSE 'city_centroid' END AS geo_source FROM g
""")
def score_enrichment(spark, sf_dir):
    """PL13, JN13, DQ01, DQ02: scores from a cache by recovered address and place, imputed by ZIP, checked."""
    k, z = F.col("c_custkey"), F.col("c_nationkey")
    place = F.when(k % 7 == 0, k / 1e6)
    address = F.when(k % 2 == 0, F.concat(k.cast("string"), F.lit(" Pine St")))
    rows = table(spark, sf_dir, "customer").select(k.alias("listing"), z.cast("string").alias("zip_code"), address.alias("address"), F.lit(None).cast("string").alias("url"), place.alias("lat"), place.alias("lon"))
    found = F.coalesce(address, F.concat(F.lpad(z.cast("string"), 5, "0"), F.lit(", San Francisco, CA")))
    # Customers that share an address have scores of their own, so their number goes with it on both sides.
    own = table(spark, sf_dir, "customer").where((k % 3 == 0) & (z < 20))
    keyed = own.select(F.concat_ws(" ", found, k.cast("string")).alias("address"), F.coalesce(place, F.lit(37.7749)).alias("lat"), F.coalesce(place, F.lit(-122.4194)).alias("lon"), (k % 100).cast("double").alias("walk_score"))
    centroids = spark.createDataFrame([], "zip_code string, lat double, lon double")
    query = X.recover_address("address", "url", "zip_code")
    placed = rows.withColumns({"address_source": query["source"], "address": F.concat_ws(" ", query["query"], F.col("listing").cast("string"))})
    out = A.require_complete(A.impute_scores(J.with_scores(placed, keyed, centroids, (37.7749, -122.4194)), ["walk"]), ["walk_score", "walk_description"])
    return out.select("listing", "walk_score", "walk_description", "address_source", "geo_source")


@query("""
WITH w AS (SELECT c_custkey AS k, c_name AS url, c_mktsegment AS seg FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier))
SELECT k, url, CASE WHEN o IS NULL THEN seg ELSE '' END AS amenities FROM w LEFT JOIN (SELECT DISTINCT o_custkey AS o FROM orders) ON k = o
""")
def detail_enrichment(spark, sf_dir):
    """PL16, JN11, RS05: listings that aren't done, with what their pages gave, even where that is empty."""
    work = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("url"), F.col("c_mktsegment").alias("amenities"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("url"))
    done = c.join(table(spark, sf_dir, "supplier"), F.col("c_custkey") == F.col("s_suppkey")).select("url")
    pages = c.join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey").select("url", F.lit("").alias("amenities"))
    return L.enrich_details(work, done, pages).select("k", "url", "amenities")


@query(f"""WITH {_PARTS}, n AS (SELECT p_partkey AS k, p_size % 4 AS beds, p_brand AS zip_code FROM part), u AS (SELECT y.*, n.* FROM y JOIN n ON p_partkey = k WHERE actual BETWEEN 900 AND 1500),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY zip_code, beds, actual ORDER BY k) AS r FROM u) WHERE r = 1)
SELECT k AS unit, CASE WHEN p25 IS NULL THEN CASE WHEN actual > point * 1.1 THEN 'overpriced' WHEN actual < point * 0.9 THEN 'underpriced' ELSE 'in_band' END
WHEN actual > p75 * 1.1 THEN 'overpriced_clear' WHEN actual < p25 * 0.9 THEN 'underpriced_clear' WHEN abs(actual - p75) <= 0.05 * (p75 - p25) OR abs(actual - p25) <= 0.05 * (p75 - p25) THEN 'edge_case' WHEN actual BETWEEN p25 AND p75 THEN 'in_band' ELSE 'out_of_band_minor' END AS category,
flag AS flag_overpriced, round(actual - p75, 4) AS above, round(p25 - actual, 4) AS below, round(p75 - p25, 4) AS width FROM o""")
def unit_scores(spark, sf_dir):
    """ML16: all distinct units in scope, classified, with gaps and the band's width."""
    p = priced_parts(spark, sf_dir).withColumns({"beds": F.col("p_size") % 4, "position": F.col("p_partkey")})
    out = M.score_units(p, "actual", "point", "p25", "p75", ["p_brand", "beds", "actual"], scope=(900, 1500))
    return out.select(F.col("p_partkey").alias("unit"), "category", "flag_overpriced", F.round("delta_above_p75", 4).alias("above"), F.round("delta_below_p25", 4).alias("below"), F.round("interval_width", 4).alias("width"))


@query("""
SELECT 'l_orderkey' AS column_name, count(DISTINCT l_orderkey) AS n_distinct FROM lineitem UNION ALL SELECT 'l_partkey', count(DISTINCT l_partkey) FROM lineitem UNION ALL SELECT 'l_shipdate', count(DISTINCT l_shipdate) FROM lineitem
""")
def distinct_keys(spark, sf_dir):
    """AG18."""
    return A.distinct_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey", "l_shipdate"])


@query(f"""WITH {_PARTS}, i AS (SELECT p_partkey AS k, CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 11 = 0 THEN CAST('infinity' AS DOUBLE) WHEN p_size % 13 = 0 THEN CAST('nan' AS DOUBLE) ELSE ln(1 + p_size) END AS c, CASE WHEN p_size % 9 = 0 THEN CAST('nan' AS DOUBLE) ELSE p_size * 3.0 END AS w FROM part),
b AS (SELECT k, CASE WHEN isfinite(c) THEN c END AS c, CASE WHEN isfinite(w) THEN w END AS w FROM i),
s AS (SELECT k, coalesce(1 - (c - min(c) OVER ()) / (max(c) OVER () - min(c) OVER ()), 0.5) AS safety, CASE WHEN w IS NULL THEN 0.5 ELSE least(greatest(w / 100, 0), 1) END AS walk FROM b),
r AS (SELECT s.*, flag, safety * 0.5 + walk * 0.3 + 0.5 * 0.2 AS composite FROM s JOIN y ON p_partkey = k)
SELECT k AS p_partkey, round(composite, 4) AS composite, round(safety, 4) AS safety, round(walk, 4) AS walk, flag AS flag_overpriced, CAST(row_number() OVER (ORDER BY round(composite, 9) DESC, k) AS INT) AS rank FROM r ORDER BY rank LIMIT 100""")
def rank_flagged(spark, sf_dir):
    """RK06 with its flag step; NaN, infinite and missing values are one half (RK02, RK03)."""
    size = F.col("p_size")
    crime = F.when(size % 7 == 0, None).when(size % 11 == 0, float("inf")).when(size % 13 == 0, float("nan")).otherwise(F.log1p(size.cast("double")))
    p = priced_parts(spark, sf_dir).withColumns({"crime": crime, "w": F.when(size % 9 == 0, float("nan")).otherwise(size * 3.0), "t": F.lit(None).cast("double")})
    out = K.rank_flagged(p, {"safety": 5, "walk": 3, "transit": 2}, "actual", "point", "p75", "crime", "w", "t", "p_partkey", 100)
    return out.select("p_partkey", "composite", "safety", "walk", "flag_overpriced", "rank")


@query("""
WITH c AS (SELECT CASE WHEN c_custkey % 5 = 0 THEN '$1,200' ELSE c_name END AS title, CASE c_custkey % 3 WHEN 0 THEN 'Studio' WHEN 1 THEN '2 Beds+' ELSE 'Loft' END AS beds, '$' || c_custkey AS pricing, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'X St, CA 94110' END AS address, c_custkey AS k FROM customer),
r AS (SELECT 'no_missing_cell' AS rule, count(*) FILTER (address IS NULL) AS failures, 'hard' AS severity FROM c UNION ALL SELECT 'url_shape', count(*) FILTER (k % 6 = 0), 'hard' FROM c UNION ALL SELECT 'price_has_dollar', 0, 'hard' UNION ALL SELECT 'price_format', 0, 'hard'
UNION ALL SELECT 'unit_label', count(*) FILTER (beds = 'Loft'), 'hard' FROM c UNION ALL SELECT 'scraped_at_format', 0, 'hard' UNION ALL SELECT 'zip_digits', 0, 'hard' UNION ALL SELECT 'title_present', 0, 'hard' UNION ALL SELECT 'address_present', count(*) FILTER (address IS NULL), 'hard' FROM c
UNION ALL SELECT 'address_has_zip', count(*) FILTER (address IS NULL), 'soft' FROM c UNION ALL SELECT 'title_not_price', count(*) FILTER (k % 5 = 0), 'soft' FROM c UNION ALL SELECT 'not_empty', 0, 'hard' UNION ALL SELECT 'exact_header', 0, 'hard')
SELECT * FROM r
""")
def listing_checks(spark, sf_dir):
    """DQ04, SO07."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        F.when(k % 5 == 0, "$1,200").otherwise(F.col("c_name")).alias("title"), F.when(k % 3 == 0, "Studio").when(k % 3 == 1, "2 Beds+").otherwise("Loft").alias("beds_baths"), F.concat(F.lit("$"), k.cast("string")).alias("pricing"),
        F.when(k % 4 != 0, "X St, CA 94110").alias("address"), F.lit("94110").alias("zip_code"), F.when(k % 6 == 0, "x").otherwise("https://a/b").alias("url"), F.lit("2024-01-01T00:00").alias("scraped_at"),
    )
    return A.check_listings(rows).select("rule", "failures", "severity")


@query("""
SELECT page_id, page_id % 3 = 0 OR contains(lower(coalesce(html, '')), 'captcha') OR contains(lower(coalesce(html, '')), 'access denied') OR contains(lower(coalesce(html, '')), 'unusual traffic') OR contains(lower(coalesce(html, '')), 'verify you are human')
  OR contains(lower(coalesce(html, '')), 'pardon our interruption') OR contains(lower(coalesce(html, '')), 'are you a robot') OR contains(lower(coalesce(html, '')), 'akamai') OR contains(lower(coalesce(html, '')), 'access to this page') OR page_id % 5 = 0 AS blocked FROM pages
""")
def blocked_markers(spark, sf_dir):
    """SF26 with its own markers."""
    k = F.col("page_id")
    body = F.concat(F.coalesce("html", F.lit("")), F.when(k % 5 == 0, " Access to THIS page has been denied").otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", X.looks_blocked(F.when(k % 3 == 0, "https://x/Interstitial").otherwise("https://x"), body).alias("blocked"))


@query("""
WITH s AS (SELECT p_brand AS feature, p_size % 5 AS fold, sum(p_retailprice) AS gain FROM part GROUP BY 1, 2), t AS (SELECT feature, sum(gain) AS g, sum(gain) / 5 AS mean, sqrt(greatest(sum(gain * gain) / 5 - (sum(gain) / 5) * (sum(gain) / 5), 0)) AS std FROM s GROUP BY 1)
SELECT feature, round(mean, 4) AS mean, round(std, 4) AS std, round(std / mean, 6) AS cv, round(g / (SELECT sum(g) FROM t), 6) AS share FROM t ORDER BY g DESC, feature LIMIT 10
""")
def importance_audit(spark, sf_dir):
    """AG10, AG11, JN12: shares of gain and stability over folds."""
    gains = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("feature"), (F.col("p_size") % 5).alias("fold")).agg(F.sum("p_retailprice").alias("gain"))
    shares = A.importance_shares(gains.groupBy("feature").agg(F.sum("gain").alias("gain")), 10)
    out = A.fold_stability(gains, 5, 1000).join(shares, "feature")
    return out.select("feature", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), F.round("cv", 6).alias("cv"), F.round("share", 6).alias("share"))


@query("""
WITH o AS (SELECT o_custkey % 5 AS fold, o_totalprice AS y, o_totalprice * (0.9 + (o_orderkey % 5) / 20.0) AS p, o_totalprice - (o_orderkey % 300) AS lo, o_totalprice + 100 - (o_orderkey % 200) AS hi FROM orders),
f AS (SELECT fold, avg(abs(y - p)) AS mae FROM o GROUP BY 1)
SELECT round(avg(mae), 4) AS mean, round(stddev_pop(mae), 4) AS std, round(1.96 * stddev_samp(mae) / sqrt(count(*)), 4) AS half_width, (SELECT round(avg(CASE WHEN y BETWEEN lo AND hi THEN 1.0 ELSE 0 END), 6) FROM o) AS coverage, (SELECT round(avg(greatest(hi - lo, 0)), 4) FROM o) AS width FROM f
""")
def cv_summary(spark, sf_dir):
    """AG13, AG14, AG15: metrics by fold, their summary, coverage and width of a band."""
    k, y = F.col("o_orderkey"), F.col("o_totalprice")
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 5).alias("fold"), y.alias("y"), (y * (0.9 + (k % 5) / 20.0)).alias("p"), (y - k % 300).alias("lo"), (y + 100 - k % 200).alias("hi"))
    summary = A.fold_summary(A.regression_metrics(o, "y", "p", "fold"), ["mae"])
    return summary.crossJoin(A.interval_coverage(o, "y", "lo", "hi")).select(*[F.round(c, 6 if c == "coverage" else 4).alias(c) for c in ("mean", "std", "half_width", "coverage", "width")])


@query("""
SELECT o_custkey, arg_max(o_orderkey, o_orderdate) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) GROUP BY 1
""")
def latest_rows(spark, sf_dir):
    """WN03, SO04: the latest row of each key, the last of equal ones."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return J.keep_first(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], last=True)


@query("""
WITH k AS (SELECT c_custkey AS k, c_nationkey AS z FROM customer), r AS (SELECT n_nationkey AS z, arg_max(s_suppkey, s_suppkey) AS s FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1) SELECT k.k AS c_custkey, coalesce(r.s, 0) AS n FROM k LEFT JOIN r ON r.z = k.z
""")
def keep_last_join(spark, sf_dir):
    """JN03: a right side that repeats its keys counts with its last row."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("z"), F.lit(999).alias("n"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("z"), F.col("s_suppkey").alias("n"), F.col("s_suppkey").alias("at"))
    return J.left_features(c, s, ["z"], {"n": 0}, latest_by=["at"]).select("c_custkey", "n")


@query("""
SELECT c_custkey, 'Unit ' || c_custkey || ' Sq' AS slug, CASE WHEN c_custkey % 2 = 0 THEN 'https://b/x' ELSE 'http://y' END AS url, c_custkey % 4 = 0 AS studio, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN c_custkey + 0.5 ELSE 7.0 END AS rent,
       'T' AS title, CAST(c_custkey AS DOUBLE) AS card_rent, 'Mission' AS place, 'a b' AS squeezed, CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '2024-02-03 04:05:06' END AS at, CAST(c_custkey AS VARCHAR) || ' Elm' AS address FROM customer
""")
def text_fields(spark, sf_dir):
    """SF12, SF13, SF15, SF16, SF17, SF23, SF25, SM01."""
    k = F.col("c_custkey")
    n = k.cast("string")
    card = X.split_card(F.concat(F.lit("T $"), n, F.lit(" Mission")))
    rent = X.actual_rent(F.when(k % 3 == 0, "call us").when(k % 3 == 1, (k + 0.5).cast("string")), F.lit("7"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", X.title_from_slug(F.concat(F.lit("/h/unit-"), n, F.lit("-sq.html?x=1"))).alias("slug"), X.absolute_url(F.when(k % 2 == 0, "/x").otherwise("http://y"), "https://b").alias("url"),
        (X.bed_label(F.when(k % 4 == 0, 0.0).otherwise(2.0)) == "Studio").alias("studio"), rent.alias("rent"), card["title"].alias("title"), card["rent"].alias("card_rent"), card["place"].alias("place"),
        X.squeeze(F.lit("  a \t b\n")).alias("squeezed"), N.utc_time(F.when(k % 2 == 0, "2024-02-03T04:05:06.000 UTC").otherwise("soon")).alias("at"), X.address_from_title(F.concat(F.lit("The "), n, F.lit(" Elm"))).alias("address"),
    )


@query("""
SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'transient' WHEN 2 THEN 'bad_place' WHEN 3 THEN 'fatal' ELSE 'unknown' END AS state, CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey % 100 + 0.0 END AS walk_score, CASE WHEN s_suppkey % 5 = 0 AND s_suppkey % 2 = 0 THEN 'Good' END AS transit_description,
       CASE WHEN s_suppkey % 3 != 0 THEN s_suppkey + 0.25 END AS lat, 'None Such St' AS address, s_suppkey % 2 = 0 AS furnished, CAST(NULL AS DOUBLE) AS baths FROM supplier
""")
def service_answers(spark, sf_dir):
    """SC10, SC16, SC17: score service, geocoder and dict literals as columns."""
    k = F.col("s_suppkey")
    status = F.element_at(F.array(*[F.lit(x) for x in ("1", "2", "30", "41", "9")]), (k % 5 + 1).cast("int"))
    transit = F.when(k % 2 == 0, ', "transit": {"score": 5, "description": "Good"}').otherwise("")
    score = F.concat(F.lit('{"status": '), status, F.lit(', "walkscore": '), (k % 100).cast("string"), transit, F.lit("}"))
    place = F.when(k % 3 != 0, F.concat(F.lit('[{"lat": "'), (k + 0.25).cast("string"), F.lit('", "lon": "1"}]'))).otherwise("[]")
    literal = F.concat(F.lit("{'address': 'None Such St', 'baths': None, 'furnished': "), F.when(k % 2 == 0, "True").otherwise("False"), F.lit("}"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", score.alias("score"), place.alias("place"), literal.alias("literal"))
    out = rows.select("s_suppkey", S.score_response("score").alias("s"), S.geocode_response("place").alias("g"), S.literal_struct("literal", "address string, baths double, furnished boolean").alias("d"))
    return out.select("s_suppkey", "s.state", "s.walk_score", "s.transit_description", "g.lat", "d.address", "d.furnished", "d.baths")


@query("""
WITH c AS (SELECT c_nationkey AS z, c_custkey AS k FROM customer) SELECT 'L' || CASE WHEN k < 1000 THEN lpad(CAST(k AS VARCHAR), 3, '0') ELSE CAST(k AS VARCHAR) END AS listing_id, k % 4 + 0.0 AS bedrooms, CASE WHEN z < 20 THEN z + 0.5 END AS lat FROM c
""")
def rankable_listings(spark, sf_dir):
    """PL15: payload fields, an id by position, a place, and the offer that each unit claims."""
    k, z = F.col("c_custkey"), F.col("c_nationkey")
    literal = F.concat(F.lit("{'zip_code': '"), F.lpad(z.cast("string"), 5, "0"), F.lit("', 'bedrooms': "), (k % 4).cast("string"), F.lit("}"))
    scored = table(spark, sf_dir, "customer").select(k.alias("position"), F.col("c_acctbal").alias("actual_rent_usd"), literal.alias("payload"))
    offers = table(spark, sf_dir, "supplier").select(F.lpad(F.col("s_nationkey").cast("string"), 5, "0").alias("zip_code"), F.col("s_suppkey").alias("offer"), F.lit("1 Bed").alias("label"), F.col("s_acctbal").alias("price"), F.col("s_name").alias("name"))
    places = table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("zip_code"), (F.col("n_nationkey") + 0.5).alias("lat"), F.lit(1.0).alias("lon"))
    return L.rankable(scored, "payload", "zip_code string, bedrooms double", offers, places).select("listing_id", "bedrooms", "lat")


@query("""
WITH c AS (SELECT c_custkey AS k, c_nationkey AS z, lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS zip FROM customer),
a AS (SELECT *, CASE k % 4 WHEN 0 THEN k || ' Pine St' WHEN 1 THEN 'Unit ' || k || ' at ' || k || ' Oak Ave' ELSE CASE WHEN k % 4 = 2 THEN 'Lobby' END END AS address FROM c),
q AS (SELECT *, CASE k % 4 WHEN 0 THEN k || ' Pine St' WHEN 1 THEN k || ' Oak Ave' ELSE zip || ', San Francisco, CA' END AS query, CASE k % 4 WHEN 0 THEN 'address' WHEN 1 THEN 'address_normalized' ELSE 'zip_fallback' END AS address_source,
      CASE WHEN k % 7 = 0 THEN 'address' WHEN z < 20 THEN 'zip_centroid' ELSE 'city_centroid' END AS geo_source FROM a),
s AS (SELECT *, CASE WHEN k % 4 < 2 AND k % 3 = 0 THEN k % 100 + 0.0 WHEN k % 4 > 1 AND k % 7 != 0 AND z % 2 = 0 THEN z * 4.0 END AS w, CASE WHEN k % 4 < 2 AND k % 3 = 0 THEN k % 90 + 0.0 END AS t FROM q),
f AS (SELECT *, coalesce(w, avg(w) OVER (PARTITION BY zip)) AS w1, coalesce(t, avg(t) OVER (PARTITION BY zip)) AS t1 FROM s),
g AS (SELECT *, round_even(coalesce(w1, avg(w1) OVER ()), 0) AS walk_score, round_even(coalesce(t1, avg(t1) OVER ()), 0) AS transit_score FROM f)
SELECT k AS listing, query, address_source, geo_source, walk_score, transit_score, CASE WHEN walk_score >= 90 THEN 'Walker''s Paradise' WHEN walk_score >= 70 THEN 'Very Walkable' WHEN walk_score >= 50 THEN 'Somewhat Walkable' ELSE 'Car-Dependent' END AS walk_description FROM g
""")
def enriched_scores(spark, sf_dir):
    """PL13 as it is composed: addresses recovered, scores by address and place, imputed by ZIP, checked for gaps."""
    k, z = F.col("c_custkey"), F.col("c_nationkey")
    n, zipped = k.cast("string"), F.lpad(z.cast("string"), 5, "0")
    own = F.when(k % 4 == 0, F.concat(n, F.lit(" Pine St"))).when(k % 4 == 1, F.concat(F.lit("Unit "), n, F.lit(" at "), n, F.lit(" Oak Ave"))).when(k % 4 == 2, "Lobby")
    place = F.when(k % 7 == 0, k / 1e6)
    c = table(spark, sf_dir, "customer")
    listings = c.select(k.alias("listing"), zipped.alias("zip_code"), own.alias("address"), F.lit(None).cast("string").alias("url"), place.alias("lat"), place.alias("lon"))
    centre = lambda at, other: F.when(z < 20, z + at).otherwise(other)
    known = c.where((k % 4 < 2) & (k % 3 == 0)).select(
        F.concat(n, F.when(k % 4 == 0, " Pine St").otherwise(" Oak Ave")).alias("address"), F.coalesce(place, centre(0.5, 37.7749)).alias("lat"), F.coalesce(place, centre(0.25, -122.4194)).alias("lon"),
        (k % 100).cast("double").alias("walk_score"), (k % 90).cast("double").alias("transit_score"),
    )
    areas_ = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"))
    shared = areas_.where(z % 2 == 0).select(F.concat(zipped, F.lit(", San Francisco, CA")).alias("address"), centre(0.5, 37.7749).alias("lat"), centre(0.25, -122.4194).alias("lon"), (z * 4.0).alias("walk_score"), F.lit(None).cast("double").alias("transit_score"))
    none = F.lit(None).cast("string")
    cache = known.unionByName(shared).withColumns({"bike_score": F.lit(60.0), "walk_description": none, "transit_description": none, "bike_description": none})
    centroids = areas_.where(z < 20).select(zipped.alias("zip_code"), (z + 0.5).alias("lat"), (z + 0.25).alias("lon"))
    out = L.enrich_scores(listings, cache, centroids)
    return out.select("listing", F.col("address").alias("query"), "address_source", "geo_source", "walk_score", "transit_score", "walk_description")


@query("""
SELECT count(*) AS units, count(*) FILTER (s_nationkey IS NOT NULL) AS in_areas_with_offers, (SELECT count(*) FROM (SELECT least(w.n, o.n) AS m FROM (SELECT c_nationkey AS z, count(*) AS n FROM customer GROUP BY 1) w JOIN (SELECT s_nationkey AS z, count(*) AS n FROM supplier GROUP BY 1) o USING (z)), (SELECT unnest(range(1, 100000)) AS i) WHERE i <= m) AS claimed, true AS once, true AS named_as_offered
FROM customer LEFT JOIN (SELECT DISTINCT s_nationkey FROM supplier) ON s_nationkey = c_nationkey
""")
def rankable_claims(spark, sf_dir):
    """PL15, JN10: each area gives out as many offers as it can, none twice, and units have the fields of what they claimed."""
    k, z = F.col("c_custkey"), F.col("c_nationkey")
    literal = F.concat(F.lit("{'zip_code': '"), F.lpad(z.cast("string"), 5, "0"), F.lit("', 'bedrooms': "), (k % 4).cast("string"), F.lit("}"))
    scored = table(spark, sf_dir, "customer").select(k.alias("position"), F.col("c_acctbal").alias("actual_rent_usd"), literal.alias("payload"))
    s = table(spark, sf_dir, "supplier")
    offers = s.select(F.lpad(F.col("s_nationkey").cast("string"), 5, "0").alias("zip_code"), F.col("s_suppkey").alias("offer"), F.when(F.col("s_suppkey") % 3 == 0, "1 Bed").otherwise("2 Bed").alias("label"), F.col("s_acctbal").alias("price"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("offered"))
    places = table(spark, sf_dir, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("zip_code"), F.lit(0.5).alias("lat"), F.lit(1.0).alias("lon"))
    found = materialize(L.rankable(scored, "payload", "zip_code string, bedrooms double", offers, places), "rankable")
    again = found.join(s, F.col("offer") == F.col("s_suppkey"), "left").withColumn("same", (F.col("name") == F.col("s_name")) & (F.col("offered") == F.col("s_acctbal")) & (F.lpad(F.col("s_nationkey").cast("string"), 5, "0") == F.col("zip_code")))
    areas_ = s.select(F.lpad(F.col("s_nationkey").cast("string"), 5, "0").alias("zip_code")).distinct().withColumn("has", F.lit(True))
    out = again.join(areas_, "zip_code", "left")
    return out.agg(
        F.count(F.lit(1)).alias("units"), F.count("has").alias("in_areas_with_offers"), F.count("offer").alias("claimed"),
        (F.count_distinct("offer") == F.count("offer")).alias("once"), (F.count_if("same") == F.count("offer")).alias("named_as_offered"),
    )
