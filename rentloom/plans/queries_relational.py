"""Queries over joins, aggregates, windows, audits, models, ranking and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from rentloom.functions import numbers as N
from rentloom.operators import aggregates as A
from rentloom.operators import joins as J
from rentloom.operators import modelling as M
from rentloom.operators import quantiles as Q
from rentloom.operators import ranking as K
from rentloom.operators import reshape as R
from rentloom.sources.paged import PagedFeed
from rentloom.sources.published import Published, read_published
from rentloom.sources.staging import kept_small, materialize, new_folder
from rentloom.streaming import feeds as S
from rentloom.streaming.seen import first_ever, state_on_disk

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


# Two squares that share an edge, and one that lies over the first.
AREAS = [("00001", 0.0, 0.0, 50.0, 50.0), ("00002", 50.0, 0.0, 100.0, 50.0), ("00003", 25.0, 25.0, 75.0, 75.0)]


def areas(spark):
    rows = [(z, [[a, b], [c, b], [c, d], [a, d], [a, b]], k) for k, (z, a, b, c, d) in enumerate(AREAS)]
    return spark.createDataFrame(rows, "zip_code string, contour array<array<double>>, position long")


def events(spark, sf_dir):
    """Events as incidents at points that their ids give."""
    return table(spark, sf_dir, "events").withColumns({"lon": (F.col("event_id") * 37 % 1009) / 10.0, "lat": (F.col("event_id") * 91 % 997) / 10.0, "month": N.month_of("ts")})


_EVENTS = """
e AS (SELECT *, (event_id * 37 % 1009) / 10.0 AS lon, (event_id * 91 % 997) / 10.0 AS lat, date_trunc('month', ts) AS month FROM events),
z AS (SELECT *, CASE WHEN lon < 50 AND lat < 50 THEN '00001' WHEN lon >= 50 AND lon < 100 AND lat < 50 THEN '00002' WHEN lon >= 25 AND lon < 75 AND lat >= 25 AND lat < 75 THEN '00003' END AS zip_code FROM e),
p AS (SELECT zip_code, CAST(month AS TIMESTAMP) AS month, count(*) AS total, count(*) FILTER (event_type IN ('error')) AS errors, count(*) FILTER (event_type IN ('purchase', 'signup')) AS deals, ln(1 + count(*)) AS total_log1p FROM z WHERE zip_code IS NOT NULL GROUP BY 1, 2)
"""


def _panel(spark, sf_dir):
    placed = J.assign_area(events(spark, sf_dir), areas(spark), cell=20.0)
    return A.category_counts(placed, ["zip_code", "month"], "event_type", {"errors": ["error"], "deals": ["purchase", "signup"]}, "total")


@query(f"WITH {_EVENTS} SELECT zip_code, month, total, errors, deals, round(total_log1p, 6) AS total_log1p FROM p")
def incident_zip_month(spark, sf_dir):
    return _panel(spark, sf_dir).withColumn("total_log1p", F.round("total_log1p", 6))


@query(f"""WITH {_EVENTS} SELECT o_orderkey, coalesce(total, 0) AS total, coalesce(errors, 0) AS errors, round(coalesce(total_log1p, 0.0), 6) AS total_log1p
FROM orders LEFT JOIN p ON p.zip_code = lpad(CAST(o_custkey % 5 AS VARCHAR), 5, '0') AND p.month = TIMESTAMP '2024-01-01'""")
def incident_left_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.lpad((F.col("o_custkey") % 5).cast("string"), 5, "0").alias("zip_code"), F.lit("2024-01-01").cast("timestamp").alias("month"))
    out = J.left_features(o, _panel(spark, sf_dir), ["zip_code", "month"], {"total": 0, "errors": 0, "total_log1p": 0.0})
    return out.select("o_orderkey", "total", "errors", F.round("total_log1p", 6).alias("total_log1p"))


def monthly_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("c_nationkey").alias("zip_code"), N.month_of("o_orderdate").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("v"))


_ORDERS = """m AS (SELECT c_nationkey AS zip_code, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, count(*) AS n, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


@query("""
SELECT a.zip_code, a.month, a.n, round(b.q, 2) AS q FROM (SELECT c_nationkey AS zip_code, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) a
JOIN (SELECT c_nationkey AS zip_code, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS month, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) b USING (zip_code, month)
""")
def index_panel_inner(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("zip_code"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"))
    shipped = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("zip_code", N.month_of("l_shipdate").alias("month")).agg(F.round(F.sum("l_quantity"), 2).alias("q"))
    return monthly_orders(spark, sf_dir).select("zip_code", "month", "n").join(shipped, ["zip_code", "month"])


@query(f"""WITH {_ORDERS}, s AS (SELECT min(month) AS lo, max(month) AS hi FROM m),
g AS (SELECT zip_code, month FROM (SELECT DISTINCT zip_code FROM m) CROSS JOIN (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS TIMESTAMP) AS month FROM s)),
f AS (SELECT g.zip_code, g.month, coalesce(CASE WHEN m.n % 3 != 0 THEN m.n END, 0) AS n FROM g LEFT JOIN m ON m.zip_code = g.zip_code AND m.month = g.month),
r AS (SELECT *, avg(n) OVER (PARTITION BY zip_code ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS a, avg(n) OVER (PARTITION BY zip_code ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS b FROM f)
SELECT zip_code, month, n, round(a, 4) AS n_3m, round(b, 4) AS n_12m, round(CASE WHEN b > 0 THEN a / b ELSE 0 END, 4) AS trend, round(CASE WHEN zip_code > 0 THEN n * 1000.0 / zip_code END, 4) AS rate FROM r""")
def grid_rolling(spark, sf_dir):
    # Some counts are missing, and count as 0 in the grid.
    panel = monthly_orders(spark, sf_dir).withColumn("n", F.when(F.col("n") % 3 != 0, F.col("n")))
    rolled = A.rolling_means(R.month_grid(panel, "zip_code", "month", ["n"]), "zip_code", "month", ["n"], [3, 12])
    return rolled.select("zip_code", "month", "n", F.round("n_3m", 4).alias("n_3m"), F.round("n_12m", 4).alias("n_12m"), F.round(N.share_or_zero("n_3m", "n_12m"), 4).alias("trend"), F.round(N.rate_per_1000("n", "zip_code"), 4).alias("rate"))


@query("""
WITH w AS (SELECT user_id % 20 AS zip_code, event_type, count(*) AS n FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 MONTH GROUP BY 1, 2)
SELECT * FROM (SELECT zip_code, event_type, n AS count, round(n / sum(n) OVER (PARTITION BY zip_code), 6) AS share, CAST(row_number() OVER (PARTITION BY zip_code ORDER BY n DESC, event_type) AS INT) AS rank FROM w) WHERE rank <= 3
""")
def category_topn(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("zip_code", F.col("user_id") % 20)
    return A.top_categories(R.trailing_months(e, "ts", 1), "zip_code", "event_type", 3).withColumn("share", F.round("share", 6))


@query(f"WITH {_ORDERS} SELECT zip_code, month, round(v - lag(v, 12) OVER (PARTITION BY zip_code ORDER BY month), 2) AS delta FROM m")
def lag12_delta(spark, sf_dir):
    return A.lag_difference(monthly_orders(spark, sf_dir), "zip_code", "month", "v", 12, "delta").select("zip_code", "month", F.round("delta", 2).alias("delta"))


_FACTS = """f AS (SELECT l_orderkey, l_linenumber, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS month, l_suppkey % 26 AS zip_code FROM lineitem)"""


def facts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", N.month_of("l_shipdate").alias("month"), (F.col("l_suppkey") % 26).cast("int").alias("zip_code"))


@query(f"""WITH {_ORDERS}, {_FACTS}, s AS (SELECT zip_code, month, CASE WHEN n % 7 != 0 THEN n END AS n FROM m),
t AS (SELECT zip_code, arg_max(coalesce(n, -1), month) AS n FROM s GROUP BY 1),
j AS (SELECT f.*, s.month AS pm, s.n AS pn FROM f ASOF LEFT JOIN s ON f.zip_code = s.zip_code AND f.month >= s.month)
SELECT l_orderkey, l_linenumber, coalesce(pn, nullif(t.n, -1), -1) AS n, CASE WHEN pn IS NOT NULL AND pm = j.month THEN 'exact' WHEN pn IS NOT NULL THEN 'asof' WHEN nullif(t.n, -1) IS NOT NULL THEN 'latest' ELSE 'none' END AS provenance
FROM j LEFT JOIN t USING (zip_code)""")
def asof_zip_month(spark, sf_dir):
    panel = monthly_orders(spark, sf_dir).withColumn("n", F.when(F.col("n") % 7 != 0, F.col("n")))
    return J.asof_join(facts(spark, sf_dir), panel, ["n"], "month", "zip_code").select("l_orderkey", "l_linenumber", F.coalesce("n", F.lit(-1)).alias("n"), "provenance")


@query(f"""WITH {_FACTS}, s AS (SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, count(*) AS n FROM orders GROUP BY 1)
SELECT l_orderkey, l_linenumber, coalesce(s.n, (SELECT arg_max(n, month) FROM s)) AS n, CASE WHEN s.n IS NULL THEN 'latest' WHEN s.month = f.month THEN 'exact' ELSE 'asof' END AS provenance FROM f ASOF LEFT JOIN s ON f.month >= s.month""")
def asof_month(spark, sf_dir):
    panel = table(spark, sf_dir, "orders").groupBy(N.month_of("o_orderdate").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return J.asof_join(facts(spark, sf_dir), panel, ["n"], "month").select("l_orderkey", "l_linenumber", "n", "provenance")


_NUM = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


@query("""
WITH o AS (SELECT CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS priority, o_orderkey FROM orders)
SELECT 'price' AS column_name, round(avg(CASE WHEN price IS NULL THEN 1.0 ELSE 0 END), 6) AS null_rate FROM o UNION ALL SELECT 'priority', round(avg(CASE WHEN priority IS NULL THEN 1.0 ELSE 0 END), 6) FROM o UNION ALL SELECT 'o_orderkey', 0.0 FROM (SELECT 1)
""")
def manifest_null_rates(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.when(F.col("o_custkey") % 10 != 0, F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("priority"), "o_orderkey")
    return A.null_rates(o).withColumn("null_rate", F.round("null_rate", 6))


@query("""
SELECT count(l_extendedprice) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std, min(l_extendedprice) AS min, max(l_extendedprice) AS max,
round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.75), 4) AS p75, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem
""")
def manifest_distribution(spark, sf_dir):
    d = A.distribution(table(spark, sf_dir, "lineitem"), "l_extendedprice")
    return d.select(*[F.round(c, 4).alias(c) if c != "n" else F.col(c) for c in d.columns])


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(corr({c}, l_extendedprice), 6) AS pearson FROM lineitem" for c in _NUM))
def manifest_correlations(spark, sf_dir):
    return A.strongest(A.correlations(table(spark, sf_dir, "lineitem"), "l_extendedprice", _NUM)).withColumn("pearson", F.round("pearson", 6))


@query("""
WITH d AS (SELECT n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)),
r AS (SELECT quality, n_chars, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS rx, rank() OVER (ORDER BY quality) + (count(*) OVER (PARTITION BY quality) - 1) / 2.0 AS ry,
      toxic, rank() OVER (ORDER BY toxic) + (count(*) OVER (PARTITION BY toxic) - 1) / 2.0 AS rt FROM d)
SELECT 'n_chars' AS feature, round(corr(n_chars, quality), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r
UNION ALL SELECT 'toxic', round(corr(toxic, quality), 6), round(corr(rt, ry), 6) FROM r
""")
def target_audit(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    p = A.correlations(d, "quality", ["n_chars", "toxic"])
    out = p.join(A.spearman(d, "quality", ["n_chars", "toxic"]), "feature")
    return out.select("feature", F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))


@query("""
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_nationkey END AS z, CASE WHEN c_custkey % 3 = 0 OR c_nationkey = 7 THEN NULL ELSE c_custkey % 100 + 0.0 END AS s FROM customer),
f AS (SELECT c_custkey, coalesce(s, CASE WHEN z IS NOT NULL THEN avg(s) OVER (PARTITION BY z) END) AS s FROM c), g AS (SELECT c_custkey, round_even(coalesce(s, avg(s) OVER ()), 0) AS walk_score FROM f)
SELECT c_custkey, walk_score, CASE WHEN walk_score >= 90 THEN 'Walker''s Paradise' WHEN walk_score >= 70 THEN 'Very Walkable' WHEN walk_score >= 50 THEN 'Somewhat Walkable' ELSE 'Car-Dependent' END AS walk_description FROM g
""")
def impute_scores(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 11 != 0, F.col("c_nationkey")).alias("zip_code"), F.when((F.col("c_custkey") % 3 != 0) & (F.col("c_nationkey") != 7), (F.col("c_custkey") % 100).cast("double")).alias("walk_score"))
    return A.impute_scores(c, ["walk"]).select("c_custkey", "walk_score", "walk_description")


@query("""
WITH q AS (SELECT quantile_cont(o_totalprice, 0.01) AS lo, quantile_cont(o_totalprice, 0.99) AS hi FROM orders WHERE o_totalprice > 0)
SELECT o_orderkey, round(least(greatest(o_totalprice, lo), hi), 2) AS o_totalprice FROM orders, q WHERE o_totalprice > 0
""")
def winsorize(spark, sf_dir):
    return M.winsorized(table(spark, sf_dir, "orders"), "o_totalprice").select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))


_FOLD = "CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8)) AS BIGINT) % 5"


@query(f"""
WITH o AS (SELECT *, {_FOLD} AS fold, CASE WHEN o_custkey % 6 = 0 THEN NULL ELSE 100000.0 + o_custkey END AS idx FROM orders),
m AS (SELECT a.fold, quantile_cont(b.idx, 0.5) AS med FROM (SELECT DISTINCT fold FROM o) a JOIN o b ON a.fold != b.fold GROUP BY 1),
p AS (SELECT o.fold, o_totalprice AS y, coalesce(idx, med) AS p FROM o JOIN m USING (fold))
SELECT fold, count(*) AS n, round(avg(abs(y - p)), 2) AS mae, round(avg(abs(y - p) / abs(y)), 6) AS mape, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2 FROM p GROUP BY 1
""")
def baseline_cv(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumns({"fold": M.fold_of(F.col("o_orderkey")), "idx": F.when(F.col("o_custkey") % 6 != 0, 100000.0 + F.col("o_custkey"))})
    return M.baseline_cv(o, "idx", "o_totalprice", "fold").select("fold", "n", F.round("mae", 2).alias("mae"), F.round("mape", 6).alias("mape"), F.round("r2", 6).alias("r2"))


@query("""
WITH b AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS lo, quantile_cont(o_totalprice, 0.75) AS hi FROM orders WHERE o_orderkey % 5 != 0 GROUP BY 1),
r AS (SELECT o_totalprice AS y, lo, hi, greatest(lo - o_totalprice, o_totalprice - hi) AS s FROM orders JOIN b USING (o_orderpriority) WHERE o_orderkey % 5 = 0),
n AS (SELECT count(*) AS n FROM r), k AS (SELECT s, row_number() OVER (ORDER BY s) AS i FROM r),
q AS (SELECT greatest(max(s), 0) AS q FROM k, n WHERE i = least(greatest(ceil((n + 1) * 0.5), 1), n))
SELECT count(*) AS n, round(max(q), 2) AS offset_value, round(avg(CASE WHEN y BETWEEN lo AND hi THEN 1.0 ELSE 0 END), 6) AS coverage_raw, round(avg(hi - lo), 2) AS width_raw,
round(avg(CASE WHEN y BETWEEN greatest(lo - q, 0) AND hi + q THEN 1.0 ELSE 0 END), 6) AS coverage, round(avg(hi + q - greatest(lo - q, 0)), 2) AS width FROM r, q
""")
def conformal_offset(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    band = Q.exact_quantiles(o.where("o_orderkey % 5 != 0"), "o_totalprice", [0.25, 0.75], ["o_orderpriority"]).select("o_orderpriority", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    out = M.conformal(o.where("o_orderkey % 5 = 0").join(F.broadcast(band), "o_orderpriority"), "o_totalprice", "lo", "hi")
    return out.select("n", F.round("offset", 2).alias("offset_value"), F.round("coverage_raw", 6).alias("coverage_raw"), F.round("width_raw", 2).alias("width_raw"), F.round("coverage", 6).alias("coverage"), F.round("width", 2).alias("width"))


def priced_parts(spark, sf_dir):
    """Parts with their brand's quartiles as band and its mean as prediction; some brands have no band."""
    p = table(spark, sf_dir, "part")
    band = Q.exact_quantiles(p, "p_retailprice", [0.25, 0.75], ["p_brand"]).select("p_brand", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p75"))
    q = p.groupBy("p_brand").agg(F.avg("p_retailprice").alias("point")).join(band, "p_brand")
    q = q.withColumns({c: F.when(~F.col("p_brand").endswith("1"), F.col(c)) for c in ("p25", "p75")})
    return p.join(F.broadcast(q), "p_brand").withColumn("actual", F.when(F.col("p_partkey") % 9 != 0, F.col("p_retailprice") * (0.8 + (F.col("p_partkey") % 13) / 20.0)))


_PARTS = """q AS (SELECT p_brand, CASE WHEN p_brand NOT LIKE '%1' THEN quantile_cont(p_retailprice, 0.25) END AS p25, CASE WHEN p_brand NOT LIKE '%1' THEN quantile_cont(p_retailprice, 0.75) END AS p75, avg(p_retailprice) AS point FROM part GROUP BY 1),
x AS (SELECT p_partkey, p25, p75, point, CASE WHEN p_partkey % 9 != 0 THEN p_retailprice * (0.8 + (p_partkey % 13) / 20.0) END AS actual FROM part JOIN q USING (p_brand)),
y AS (SELECT *, CASE WHEN p75 IS NOT NULL AND actual IS NOT NULL THEN actual > p75 ELSE coalesce(actual - point >= 250 AND (actual - point) / point >= 0.1, false) END AS flag FROM x)"""


@query(f"""WITH {_PARTS} SELECT p_partkey, flag AS flag_overpriced, CASE WHEN p75 IS NOT NULL AND actual IS NOT NULL THEN 'actual_rent_above_p75' ELSE 'delta_pct_exceeds_threshold' END AS flag_reason, coalesce(round((actual - point) / point, 3) + 0.0, -1) AS pct FROM y""")
def flag_overpriced(spark, sf_dir):
    out = M.flag_overpriced(priced_parts(spark, sf_dir), "actual", "point", "p75")
    return out.select("p_partkey", "flag_overpriced", "flag_reason", F.coalesce(F.round(N.delta("actual", "point")[1], 3) + 0.0, F.lit(-1.0)).alias("pct"))


@query(f"""WITH {_PARTS} SELECT p_partkey, CASE WHEN p25 IS NULL THEN CASE WHEN actual > point * 1.1 THEN 'overpriced' WHEN actual < point * 0.9 THEN 'underpriced' ELSE 'in_band' END
WHEN actual > p75 * 1.1 THEN 'overpriced_clear' WHEN actual < p25 * 0.9 THEN 'underpriced_clear' WHEN abs(actual - p75) <= 0.05 * (p75 - p25) OR abs(actual - p25) <= 0.05 * (p75 - p25) THEN 'edge_case' WHEN actual BETWEEN p25 AND p75 THEN 'in_band' ELSE 'out_of_band_minor' END AS category FROM y WHERE actual IS NOT NULL""")
def price_category(spark, sf_dir):
    rows = priced_parts(spark, sf_dir).where("actual IS NOT NULL")
    return rows.select("p_partkey", M.price_category(F.col("actual"), F.col("p25"), F.col("p75"), F.col("point")).alias("category"))


@query(f"""WITH {_PARTS}, v AS (SELECT *, coalesce(p25, point * 0.9) AS lo, coalesce(p75, point * 1.1) AS hi, coalesce(actual, 0) AS a FROM y),
w AS (SELECT *, CASE WHEN flag OR a > hi THEN 'over' WHEN a < lo THEN 'under' ELSE 'fair' END AS verdict FROM v)
SELECT p_partkey, verdict, CASE verdict WHEN 'over' THEN 'Overpriced' WHEN 'under' THEN 'Good deal' ELSE 'Fair price' END || CASE WHEN p25 IS NULL THEN ' (est.)' ELSE '' END AS verdict_label FROM w""")
def price_verdict(spark, sf_dir):
    flagged = M.flag_overpriced(priced_parts(spark, sf_dir), "actual", "point", "p75")
    return K.price_verdict(flagged, "actual", "point", "p25", "p75", "flag_overpriced").select("p_partkey", "verdict", "verdict_label")


_RANK = """p AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL ELSE ln(1 + p_size) END AS crime, p_size * 3.0 AS walk_score, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size + 40.0 END AS transit_score FROM part),
s AS (SELECT *, coalesce(1 - (crime - min(crime) OVER ()) / (max(crime) OVER () - min(crime) OVER ()), 0.5) AS safety, least(greatest(walk_score / 100, 0), 1) AS walk, CASE WHEN transit_score IS NULL THEN 0.5 ELSE least(greatest(transit_score / 100, 0), 1) END AS transit FROM p)"""


def _scored_parts(spark, sf_dir):
    k = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.when(k % 7 != 0, F.log1p(k.cast("double"))).alias("crime"), (k * 3.0).alias("walk_score"), F.when(k % 5 != 0, k + 40.0).alias("transit_score"))


@query(f"""WITH {_RANK}, c AS (SELECT *, safety * 0.5 + walk * 0.3 + transit * 0.2 AS composite FROM s)
SELECT p_partkey, round(composite, 4) AS composite, round(safety, 4) AS safety, CAST(row_number() OVER (ORDER BY round(composite, 9) DESC, p_partkey) AS INT) AS rank, (SELECT count(*) FROM part) AS n_input, 50 AS n_returned FROM c ORDER BY rank LIMIT 50""")
def rank_listings(spark, sf_dir):
    out = K.rank_listings(_scored_parts(spark, sf_dir), {"safety": 5, "walk": 3, "transit": 2}, "crime", "walk_score", "transit_score", "p_partkey", 50)
    return out.select("p_partkey", "composite", "safety", "rank", "n_input", F.col("n_returned").cast("int").alias("n_returned"))


_RANK_ALL = _RANK.replace("ln(1 + p_size)", "CAST(p_size AS DOUBLE)")


@query(f"""WITH {_RANK_ALL}, c AS (SELECT *, safety * 0.5 + walk * 0.3 + transit * 0.2 AS composite FROM s)
SELECT p_partkey, round(composite, 4) AS composite, CAST(row_number() OVER (ORDER BY composite DESC, p_partkey) AS INT) AS rank, (SELECT count(*) FROM part) AS n_input, (SELECT count(*) FROM part) AS n_returned FROM c""")
def rank_all(spark, sf_dir):
    """No number of rows asked for: all parts are ranked."""
    parts = _scored_parts(spark, sf_dir).drop("crime").join(table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 7 != 0, F.col("p_size").cast("double")).alias("crime")), "p_partkey")
    out = K.rank_listings(parts, {"safety": 5, "walk": 3, "transit": 2}, "crime", "walk_score", "transit_score", "p_partkey")
    return out.select("p_partkey", "composite", "rank", "n_input", "n_returned")


@query(f"""WITH {_RANK_ALL}, u AS (SELECT c_custkey, (c_custkey % 7) / 10.0 AS a, (c_custkey % 5) / 10.0 AS b, (c_custkey % 3 + 1) / 10.0 AS c FROM customer),
d AS (SELECT DISTINCT a, b, c, a / (a + b + c) AS ws, b / (a + b + c) AS ww, c / (a + b + c) AS wt FROM u),
x AS (SELECT a, b, c, safety * ws + walk * ww + transit * wt AS composite, s.p_partkey FROM s, d),
y AS (SELECT a, b, c, p_partkey, round(composite, 6) AS composite, row_number() OVER (PARTITION BY a, b, c ORDER BY composite DESC, p_partkey) AS rank FROM x)
SELECT c_custkey, CAST(rank AS INT) AS rank, composite FROM u JOIN y USING (a, b, c) WHERE rank <= 3""")
def rank_many_users(spark, sf_dir):
    """A list for every customer: parts that nobody would see are not crossed with them."""
    parts = _scored_parts(spark, sf_dir).drop("crime").join(table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 7 != 0, F.col("p_size").cast("double")).alias("crime")), "p_partkey")
    c = F.col("c_custkey")
    users = table(spark, sf_dir, "customer").select("c_custkey", (c % 7 / 10.0).alias("safety"), (c % 5 / 10.0).alias("walk"), ((c % 3 + 1) / 10.0).alias("transit"))
    out = K.rank_for_users(parts, users, "c_custkey", "crime", "walk_score", "transit_score", "p_partkey", 3)
    return out.select("c_custkey", "rank", F.round("composite", 6).alias("composite"))


@query(f"""WITH {_RANK}, u AS (SELECT r_regionkey AS user_id, CASE r_regionkey WHEN 0 THEN 1.0 / 3 WHEN 1 THEN 1.0 WHEN 2 THEN 2.0 / 3 WHEN 3 THEN 0.75 ELSE 0.8 END AS ws, CASE r_regionkey WHEN 0 THEN 1.0 / 3 WHEN 1 THEN 0.0 WHEN 2 THEN 1.0 / 3 WHEN 3 THEN 0.25 ELSE 0.2 END AS ww, CASE r_regionkey WHEN 0 THEN 1.0 / 3 ELSE 0.0 END AS wt FROM region),
c AS (SELECT user_id, p_partkey, safety * ws + walk * ww + transit * wt AS composite FROM s, u)
SELECT user_id, rank, composite FROM (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY composite DESC, p_partkey) AS INT) AS rank, round(composite, 4) AS composite FROM c) WHERE rank <= 10""")
def rank_users(spark, sf_dir):
    users = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("user_id"), F.col("r_regionkey").alias("safety"), F.when(F.col("r_regionkey") > 1, 1).alias("walk"), F.lit(-2).alias("transit"))
    out = K.rank_for_users(_scored_parts(spark, sf_dir), users, "user_id", "crime", "walk_score", "transit_score", "p_partkey", 10)
    return out.select("user_id", "rank", F.round("composite", 4).alias("composite"))


@query()
def claim_once(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("zip_code"), F.col("c_custkey").alias("position"), F.col("c_mktsegment").alias("label"), F.col("c_acctbal").alias("price"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("zip_code"), F.col("s_suppkey").alias("offer"), F.when(F.col("s_suppkey") % 3 == 0, "BUILDING").when(F.col("s_suppkey") % 3 == 1, "MACHINERY").alias("label"), F.when(F.col("s_suppkey") % 7 != 0, F.col("s_acctbal")).alias("price"))
    return J.claim_once(c, s, "zip_code", "int")


def model_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    num = {"balance": F.col("c_acctbal"), "month": F.month("o_orderdate").cast("double"), "year": F.when(F.col("o_orderkey") % 9 != 0, F.year("o_orderdate").cast("double"))}
    raw = M.model_input(o.withColumns(num), "o_orderpriority", list(num), "o_totalprice").select("o_orderkey", "o_orderpriority", "o_totalprice", "label", *num)
    # Models read their input many times.
    return materialize(A.fill_medians(materialize(raw, "model-raw"), list(num)), "model-rows"), list(num)


@query()
def gbt_predict(spark, sf_dir):
    rows, num = model_rows(spark, sf_dir)
    model = M.point_pipeline("o_orderpriority", num).fit(rows)
    band = M.LeafQuantiles([0.25, 0.75]).fit(model.transform(rows).select("features", "label"))
    out = M.predict(rows, model, band, "o_orderkey")
    return M.flag_overpriced(out, "o_totalprice", "predicted_rent_usd", "fair_rent_p75").select("o_orderkey", "predicted_rent_usd", "fair_rent_p25", "fair_rent_p75", "flag_overpriced")


@query()
def feature_contributions(spark, sf_dir):
    rows, num = model_rows(spark, sf_dir)
    model = M.point_pipeline("o_orderpriority", num).fit(rows)
    return M.contributions(rows, model, num, "o_orderkey", 2)


@query(f"""WITH o AS (SELECT {_FOLD} AS fold FROM orders JOIN customer ON o_custkey = c_custkey) SELECT fold, count(*) AS n, true AS covered FROM o WHERE fold = 0 GROUP BY 1""")
def band_coverage(spark, sf_dir):
    """ML05, AG15: of rows that were not learnt from, between 45 and 55 % lie inside the band of the middle half."""
    rows, num = model_rows(spark, sf_dir)
    data = rows.withColumn("fold", M.fold_of(F.col("o_orderkey")))
    train, test = data.where("fold != 0"), data.where("fold = 0")
    model = M.point_pipeline("o_orderpriority", num, rounds=2).fit(train)
    band = M.LeafQuantiles([0.25, 0.75], trees=5, depth=4).fit(model.transform(train).select("features", "label"))
    out = M.predict(test, model, band, "o_orderkey")
    inside = F.avg(F.col("o_totalprice").between(F.col("fair_rent_p25"), F.col("fair_rent_p75")).cast("double"))
    return out.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), inside.between(0.45, 0.55).alias("covered"))


@query(f"""WITH o AS (SELECT o_orderkey, {_FOLD} AS fold FROM orders JOIN customer ON o_custkey = c_custkey) SELECT fold, count(*) AS n, count(*) AS keys, true AS metrics FROM o GROUP BY 1""")
def out_of_fold(spark, sf_dir):
    """ML06, AG13: each row is predicted once, by a model that hasn't seen its fold."""
    rows, num = model_rows(spark, sf_dir)
    data = rows.withColumn("fold", M.fold_of(F.col("o_orderkey"), 5))
    scored = M.out_of_fold(data, lambda t: M.point_pipeline("o_orderpriority", num, rounds=2).fit(t), "fold", 5).withColumn("p", N.from_log("prediction"))
    keys = scored.groupBy("fold").agg(F.count_distinct("o_orderkey").alias("keys"))
    metrics = A.regression_metrics(scored, "o_totalprice", "p", "fold")
    good = (F.col("mae") > 0) & (F.col("mape") > 0) & (F.col("r2") < 1)
    return metrics.join(keys, "fold").select("fold", "n", "keys", good.alias("metrics"))


@query("""
SELECT p, n, true AS within, low, high FROM (SELECT count(*) AS n, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem), (SELECT CAST(unnest([0.1, 0.25, 0.5, 0.75, 0.9]) AS DOUBLE) AS p)
""")
def sketch_quantiles(spark, sf_dir):
    """AG06 for data that grows: sketches by day of shipping, merged; each quantile's true rank is within 1 % of its own."""
    points = [0.1, 0.25, 0.5, 0.75, 0.9]
    rows = table(spark, sf_dir, "lineitem").select("l_extendedprice", F.to_date("l_shipdate").alias("day"))
    states = materialize(A.sketch_states(rows, [F.col("day")], "l_extendedprice"), "sketches")
    merged = A.merged_quantiles(states, points)
    each = kept_small(merged.select("n", "low", "high", F.posexplode("q").alias("k", "v")), "quantiles")
    counted = rows.crossJoin(F.broadcast(each)).groupBy("k", "n", "low", "high").agg(F.avg((F.col("l_extendedprice") < F.col("v")).cast("double")).alias("below"), F.avg((F.col("l_extendedprice") <= F.col("v")).cast("double")).alias("upto"))
    p = F.element_at(F.array(*[F.lit(x) for x in points]), F.col("k") + 1)
    return counted.select(p.alias("p"), "n", ((F.col("below") - 0.01 <= p) & (F.col("upto") + 0.01 >= p)).alias("within"), "low", "high")


def _stream_folder(spark):
    return new_folder(spark, "stream")


@query("""
SELECT event_type, CAST(date_trunc('month', ts) AS TIMESTAMP) AS month, count(*) AS n, count(*) FILTER (value > 50) AS large FROM events GROUP BY 1, 2
""")
def stream_month_rollup(spark, sf_dir):
    source = table(spark, sf_dir, "events")
    folder = _stream_folder(spark)
    stream = S.read_stream(spark, f"{sf_dir}/events.parquet*", source.schema)
    days = S.add_available(stream, f"{folder}/days", f"{folder}/checkpoint", lambda rows: S.daily_counts(rows, "ts", ["event_type"], large=F.col("value") > 50))
    return S.monthly(days, ["event_type"], ["n", "large"])


@query("SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id FROM events) GROUP BY 1")
def stream_dedup(spark, sf_dir):
    source = table(spark, sf_dir, "events")
    folder = _stream_folder(spark)
    stream = S.first_seen_stream(S.read_stream(spark, f"{sf_dir}/events.parquet*", source.schema), "user_id", "ts", "400 days")
    S.run_available(stream, f"{folder}/seen", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/seen").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1
""")
def stream_first_ever(spark, sf_dir):
    """Each user's first event, from a stream that is stopped twice: it gets events by thirds of their time, so users come
    back after any delay."""
    source = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    folder = _stream_folder(spark)
    seconds = F.unix_micros(F.col("ts").cast("timestamp"))
    span = source.agg(F.min(seconds).alias("low"), F.max(seconds).alias("high"))
    dealt = source.crossJoin(F.broadcast(span)).withColumn("third", F.least(F.floor((seconds - F.col("low")) * 3 / F.greatest(F.col("high") - F.col("low"), F.lit(1))), F.lit(2))).drop("low", "high")
    for third in range(3):
        dealt.where(F.coalesce("third", F.lit(0)) == third).drop("third").write.mode("append").parquet(f"{folder}/source")
        with state_on_disk(spark):
            stream = first_ever(S.read_stream(spark, f"{folder}/source", source.schema, files=1000), ["user_id"], ["ts", "event_id"])
            S.run_available(stream, f"{folder}/seen", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/seen").select("user_id", "event_id", "event_type")


@query("""
SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, count(DISTINCT event_id) AS n_ids FROM events GROUP BY 1
""")
def stream_paged_feed(spark, sf_dir):
    """Events as a feed in pages, read by a stream that is stopped after three of them and goes on, to a published table."""
    spark.dataSource.register(PagedFeed)
    spark.dataSource.register(Published)
    total = table(spark, sf_dir, "events").count()
    folder = _stream_folder(spark)
    page = max(1, total // 10)
    options = {"schema": "event_id long, event_type string", "page": page, "fetcher": "rentloom.sources.paged:parquet_page", "path": f"{sf_dir}/events.parquet", "columns": "event_id,event_type"}
    for there in (3 * page, total):
        feed = spark.readStream.format("paged_feed").options(total=there, **options).load()
        feed.writeStream.format("published").option("path", f"{folder}/table").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return read_published(spark, f"{folder}/table").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"), F.count_distinct("event_id").alias("n_ids"))
