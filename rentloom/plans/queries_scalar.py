"""Queries over scalar functions, reshaping and filters. Texts are made from numeric columns alike on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from rentloom.functions import numbers as N
from rentloom.functions import text as X
from rentloom.operators import aggregates as A
from rentloom.operators import reshape as R
from rentloom.plans import listings as L
from rentloom.sources import html as H

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


@query("""
SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 5 = 0 THEN NULL ELSE lpad(CAST(s_suppkey AS VARCHAR), 5, '0') END AS zip_code FROM supplier
""")
def zip_standardize(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    raw = F.concat(F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 7 == 0, "x").when(F.col("s_suppkey") % 5 == 0, "d").otherwise(".0"))
    return s.select("s_suppkey", X.standard_zip(raw).alias("zip_code"))


@query("""
SELECT p_partkey, round(p_retailprice, 2) AS price, CASE WHEN p_size % 4 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) / 2 END AS pct FROM part
""")
def money_pct_parse(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    price = F.concat(F.lit(" $"), F.format_number("p_retailprice", 2), F.lit(" "))
    pct = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("1,00"), F.col("p_size").cast("string"), F.lit("%"))).otherwise(F.concat(F.lit("+"), (F.col("p_size") / 2).cast("string"), F.lit("%")))
    return p.select("p_partkey", F.round(X.money(price), 2).alias("price"), X.percent(pct).alias("pct"))


@query("""
WITH p AS (SELECT p_partkey, CAST(floor(p_retailprice) AS BIGINT) AS a, p_size FROM part)
SELECT p_partkey, 'Studio' AS label, CAST(a AS DOUBLE) AS rent FROM p
UNION ALL SELECT p_partkey, p_size || ' Beds' AS label, CAST(a + 1000 AS DOUBLE) AS rent FROM p
UNION ALL SELECT p_partkey, '3 Beds+' AS label, CAST(a + 2500 AS DOUBLE) AS rent FROM p WHERE p_size % 2 = 0
""")
def floorplan_explode(spark, sf_dir):
    a = F.floor("p_retailprice").cast("long")
    text = F.concat(F.lit("Studio $"), F.format_number(a.cast("double"), 0), F.lit(" / "), F.col("p_size").cast("string"), F.lit(" Beds $"), (a + 1000).cast("string"), F.lit("+"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" / 3 Beds+ $"), (a + 2500).cast("string"))).otherwise(" / 1 Loft $9"))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(X.floorplans(text)).alias("x")).select("p_partkey", "x.label", "x.rent")


@query("""
SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 0.0 WHEN p_size % 5 = 1 THEN NULL ELSE CAST(p_size % 7 AS DOUBLE) END AS bedrooms,
       CASE WHEN p_size % 3 = 0 THEN NULL ELSE (p_size % 4) + 0.5 END AS bathrooms FROM part
""")
def beds_baths_parse(spark, sf_dir):
    k = F.col("p_size")
    beds = F.when(k % 5 == 0, "Cosy STUDIO").when(k % 5 == 1, "Loft").otherwise(F.concat((k % 7).cast("string"), F.lit(" Beds+")))
    text = F.concat(beds, F.when(k % 3 == 0, "").otherwise(F.concat(F.lit(", "), ((k % 4) + 0.5).cast("string"), F.lit(" Baths"))))
    return table(spark, sf_dir, "part").select("p_partkey", X.bedrooms(text).alias("bedrooms"), X.bathrooms(text).alias("bathrooms"))


@query("""
SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey || ' Beale St' WHEN s_suppkey % 3 = 1 THEN s_suppkey || ' isis st' ELSE lpad(CAST(s_suppkey AS VARCHAR), 5, '0') || ', San Francisco, CA' END AS query,
       CASE WHEN s_suppkey % 3 = 0 THEN 'address_normalized' WHEN s_suppkey % 3 = 1 THEN 'url' ELSE 'zip_fallback' END AS source,
       CASE WHEN s_suppkey % 3 = 2 THEN NULL ELSE s_suppkey || ' Beale St' END AS cleaned FROM supplier
""")
def address_recovery(spark, sf_dir):
    k = F.col("s_suppkey")
    n = k.cast("string")
    address = F.when(k % 3 == 0, F.concat(F.lit("Unit 5 at "), n, F.lit(" Beale St, apt 3"))).when(k % 3 == 1, "no number")
    url = F.when(k % 3 == 1, F.concat(F.lit("https://homes.example/yp192jv/"), n, F.lit("-isis-st-san-francisco-ca-unit-4/")))
    out = X.recover_address(address, url, n)
    plain = F.when(k % 3 != 2, F.concat(n, F.lit(" Beale St #2b")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", out["query"].alias("query"), out["source"].alias("source"), X.clean_address(plain).alias("cleaned"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 942.0 + p_size ELSE NULL END AS sqft, 'Studio' AS label, CAST(floor(p_retailprice) AS DOUBLE) AS rent,
       CASE WHEN p_size % 2 = 0 THEN 'L' || CASE WHEN p_partkey < 1000 THEN lpad(CAST(p_partkey AS VARCHAR), 3, '0') ELSE CAST(p_partkey AS VARCHAR) END ELSE 'L' || CASE WHEN p_partkey < 1000 THEN lpad(CAST(p_partkey AS VARCHAR), 3, '0') ELSE CAST(p_partkey AS VARCHAR) END END AS listing_id,
       CASE WHEN p_size >= 45 THEN 'Walker''s Paradise' WHEN p_size >= 35 THEN 'Very Walkable' WHEN p_size >= 25 THEN 'Somewhat Walkable' ELSE 'Car-Dependent' END AS walk FROM part
""")
def listing_texts(spark, sf_dir):
    k = F.col("p_size")
    text = F.concat(F.lit("Studio"), F.when(k % 2 == 0, F.concat(F.lit(", "), (k + 942).cast("string"), F.lit(" sq. ft."))).otherwise(""), F.lit("  $"), F.floor("p_retailprice").cast("string"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", X.square_feet(text).alias("sqft"), X.strip_square_feet(X.label_before_price(text)).alias("label"),
        X.first_rent(text).alias("rent"), X.listing_id("p_partkey").alias("listing_id"), X.score_label(k * 2, "walk").alias("walk"),
    )


@query("""
WITH m AS (SELECT DISTINCT date_trunc('month', o_orderdate) AS d FROM orders JOIN customer ON o_custkey = c_custkey WHERE date_trunc('month', o_orderdate) >= DATE '1996-06-01'),
s AS (SELECT c_nationkey, date_trunc('month', o_orderdate) AS d, round(sum(o_totalprice), 2) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
n AS (SELECT DISTINCT c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT n.c_nationkey AS nation, CAST(m.d AS TIMESTAMP) AS date, v AS value FROM n CROSS JOIN m LEFT JOIN s ON s.c_nationkey = n.c_nationkey AND s.d = m.d
""")
def wide_unpivot(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.withColumn("month", F.date_format("o_orderdate", "yyyy-MM-01"))
    wide = o.groupBy(F.col("c_nationkey").alias("nation")).pivot("month").agg(F.round(F.sum("o_totalprice"), 2))
    return R.unpivot_months(wide, ["nation"], "value", "1996-06-01")


@query("""
WITH f AS (SELECT n_name, r_name, r_name LIKE '%AS%' AS a, n_name LIKE '%ZZZ%' AS b FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT n_name, 'some' AS kind FROM f WHERE a UNION ALL SELECT n_name, 'all' AS kind FROM f
""")
def conditional_region(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    some = R.matching_or_all(rows, "r_name", "as").select("n_name", F.lit("some").alias("kind"))
    return some.unionByName(R.matching_or_all(rows, "n_name", "zzz").select("n_name", F.lit("all").alias("kind")))


@query("""
WITH c AS (SELECT c_nationkey AS nation, c_mktsegment AS segment, c_acctbal AS balance, 0 AS p, c_custkey AS k FROM customer
           UNION ALL SELECT s_nationkey, CASE WHEN s_suppkey % 2 = 0 THEN 'BUILDING' ELSE 'SUPPLIER' END, s_acctbal, 1, s_suppkey FROM supplier)
SELECT nation, segment, round(balance, 2) AS balance FROM (SELECT *, row_number() OVER (PARTITION BY nation, segment ORDER BY p, k) AS r FROM c) WHERE r = 1
""")
def union_dedup(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), F.col("c_custkey").alias("position"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.when(F.col("s_suppkey") % 2 == 0, "BUILDING").otherwise("SUPPLIER").alias("segment"), F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("position"))
    return L.merge_sources(c, s, ["nation", "segment"]).select("nation", "segment", F.round("balance", 2).alias("balance"))


@query("""
SELECT l_orderkey, l_linenumber, list_filter([CASE WHEN l_quantity < 2 OR l_quantity > 48 THEN 'l_quantity_range' END, CASE WHEN l_discount <= 0 OR l_discount > 0.09 THEN 'l_discount_range' END], lambda x: x IS NOT NULL) AS failed_names,
       (l_quantity BETWEEN 2 AND 48) AND (l_discount > 0 AND l_discount <= 0.09) AS valid FROM lineitem
""".replace("list_filter(", "array_to_string(list_filter(").replace("IS NOT NULL) AS failed_names", "IS NOT NULL), ',') AS failed_names"))
def row_validation(spark, sf_dir):
    rules = {"l_quantity": (2, 48, False), "l_discount": (0, 0.09, True)}
    out = R.validate(table(spark, sf_dir, "lineitem"), rules)
    return out.select("l_orderkey", "l_linenumber", F.array_join("failed", ",").alias("failed_names"), "valid")


@query("""
SELECT p_partkey FROM part WHERE p_size % 6 BETWEEN 1 AND 3 AND coalesce(CASE WHEN p_size % 5 = 0 THEN NULL ELSE (p_size % 5) / 2.0 END, 1.0) >= 1.5 AND p_retailprice <= 1500 AND p_partkey % 25 IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE'))
UNION ALL SELECT p_partkey FROM part WHERE p_size % 6 >= 4
""")
def room_budget_filter(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumns({"rooms": F.col("p_size") % 6, "baths": F.when(F.col("p_size") % 5 != 0, (F.col("p_size") % 5) / 2), "zip": (F.col("p_partkey") % 25).cast("int")})
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("place"), F.col("n_nationkey").cast("int").alias("zip_code"))
    kept = p.where(R.room_range("rooms", [1, 3], 4) & R.bath_minimum("baths", 1.5) & R.within_budget(F.lit(None).cast("double"), "p_retailprice", 1500))
    several = R.in_places(kept, "zip", places, ["ASIA", "EUROPE"]).select("p_partkey")
    return several.unionByName(p.where(R.room_range("rooms", [4], 4)).select("p_partkey"))


@query("""
SELECT r_regionkey AS zip_code, string_agg(n_name, ' · ' ORDER BY n_name) AS label FROM (SELECT DISTINCT r_regionkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey) GROUP BY 1
""")
def zip_neighborhoods(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return X.place_labels(rows.withColumnRenamed("r_regionkey", "zip_code"), "zip_code", "n_name")


@query("""
WITH p AS (SELECT p_partkey, least(greatest(CAST(p_size % 8 AS DOUBLE), 0), 5) AS beds, least(greatest(coalesce(CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size % 6 END, 1.0), 1), 4) AS baths,
           least(greatest(CASE WHEN p_size % 4 = 0 THEN 80.0 ELSE p_size * 2.5 END, 0), 100) AS walk, 80.0 AS transit, CASE WHEN p_size % 10 = 0 THEN 3500.0 ELSE p_retailprice * 3.0001713 END AS lvl FROM part)
SELECT p_partkey, round(least(greatest(lvl * (CASE CAST(floor(beds) AS INT) WHEN 0 THEN 0.7 WHEN 1 THEN 0.9 WHEN 2 THEN 1.1 WHEN 3 THEN 1.35 WHEN 4 THEN 1.55 ELSE 1.7 END) * (1.0 + 0.0015 * (walk - 70) + 0.0010 * (transit - 70)) + 200.0 * greatest(0.0, baths - 1), 1500.0), 12000.0), 2) AS rent FROM p
""")
def heuristic_rent(spark, sf_dir):
    k = F.col("p_size")
    rent = N.heuristic_rent((k % 8).cast("double"), F.when(k % 3 != 0, (k % 6).cast("double")), F.when(k % 4 != 0, k * 2.5), F.lit(None).cast("double"), F.when(k % 10 != 0, F.col("p_retailprice") * 3.0001713).otherwise(-1.0))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(rent, 2).alias("rent"))


@query("""
WITH k AS (SELECT page_id, url, coalesce(nullif(regexp_extract(url, '^(https?://[^/]+/)', 1), ''), 'page' || '|' || page_id) AS key FROM pages)
SELECT page_id, url FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY page_id) AS r FROM k) WHERE r = 1
""")
def first_seen_dedup(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    rows = pages.select(F.col("page_id").alias("position"), F.regexp_extract("url", "^(https?://[^/]+/)", 1).alias("url"), F.lit("page").alias("title"), F.col("page_id").cast("string").alias("address"), F.col("url").alias("full"))
    return L.first_seen(rows).select(F.col("position").alias("page_id"), F.col("full").alias("url"))


@query("""
SELECT page_id, CAST(unnest(generate_series(0, len(l) - 1)) AS INT) AS position, unnest(l) AS href FROM (SELECT page_id, regexp_extract_all(coalesce(html, ''), '<a [^>]*href="([^"]*)"', 1) AS l FROM pages) WHERE len(l) > 0
""")
def page_links(spark, sf_dir):
    return H.links(table(spark, sf_dir, "pages"))


@query()
def page_cards(spark, sf_dir):
    layouts = [{"card": ".result", "title": ".title", "price": ".price", "place": ".hood"}, {"card": "li", "title": "h2", "price": ".price"}]
    return H.listing_cards(table(spark, sf_dir, "pages"), layouts, "https://listings.example")


@query()
def page_amenities(spark, sf_dir):
    return H.amenities(table(spark, sf_dir, "pages"), ["h1", "h2", "li"])


@query("""
SELECT page_id, contains(lower(concat_ws(' ', url, html)), 'privacy') OR contains(lower(concat_ws(' ', url, html)), 'captcha') AS blocked FROM pages
""")
def blocked_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.looks_blocked("url", "html", ["privacy", "captcha"]).alias("blocked"))


@query("""
WITH u AS (SELECT count(*) AS n FROM (SELECT c_nationkey, c_mktsegment FROM customer GROUP BY 1, 2 HAVING count(*) > 1))
SELECT 'name_shape' AS rule, count(*) FILTER (NOT regexp_matches(c_name, '^Customer#[0-9]+$')) AS failures, 'hard' AS severity FROM customer
UNION ALL SELECT 'balance_positive', count(*) FILTER (NOT (c_acctbal > 0)), 'soft' FROM customer
UNION ALL SELECT 'segment_known', count(*) FILTER (NOT c_mktsegment IN ('BUILDING', 'MACHINERY')), 'hard' FROM customer
UNION ALL SELECT 'unique', n, 'hard' FROM u
""")
def expectations(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    rules = {"name_shape": F.col("c_name").rlike("^Customer#[0-9]+$"), "balance_positive": F.col("c_acctbal") > 0, "segment_known": F.col("c_mktsegment").isin("BUILDING", "MACHINERY")}
    return A.expectations(c, rules, ["c_nationkey", "c_mktsegment"], ["balance_positive"]).select("rule", "failures", "severity")
