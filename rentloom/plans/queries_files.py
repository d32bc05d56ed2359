"""Queries whose rows go through files: what the given tables hold is written by the sinks, or in the form that a source
expects, and read again. Beside them the audits of models, over the given tables as well.

Files are written to a folder of their own in the shared folder when a query is built; see ``staging``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentloom.functions import numbers as N
from rentloom.operators import aggregates as A
from rentloom.operators import modelling as M
from rentloom.plans import listings as L
from rentloom.plans import panels as P
from rentloom.plans.queries_pipelines import _BY_MONTH, _CITY, nation_months, table, zip_of
from rentloom.sources import tables as S
from rentloom.sources.staging import new_folder

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def schema_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def documents_by_region(rows: DataFrame, folder: str) -> None:
    """One JSON document (column ``doc``) per region, each a file of its own."""
    rows.select("doc", "n_regionkey").write.partitionBy("n_regionkey").text(folder)


@query("""
WITH c AS (SELECT c_custkey, c_name || ' café, "corner"' AS name, CASE WHEN c_custkey % 10 != 0 THEN c_acctbal END AS balance, lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS zip_code FROM customer)
SELECT form, c.* FROM c, (VALUES ('latin-1'), ('utf-16'), ('utf-8')) f(form)
""")
def text_sources(spark, sf_dir):
    """SC01, SC02, SC03: text tables in three encodings, quoted cells, numbers that are none, ZIPs that were numbers."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(
        k.cast("string").alias("c_custkey"), F.concat("c_name", F.lit(' café, "corner"')).alias("name"),
        F.when(k % 10 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string")).alias("balance"), F.concat(F.col("c_nationkey").cast("string"), F.lit(".0")).alias("zip_code"),
    )
    out = []
    for form, encoding, sep in (("utf-8", "UTF-8", ","), ("latin-1", "ISO-8859-1", ","), ("utf-16", "UTF-16", "\t")):
        folder = new_folder(spark, f"text-{form}")
        c.write.option("header", True).option("escape", '"').option("encoding", encoding).option("sep", sep).csv(folder)
        rows = S.require(S.read_csv(spark, folder, encoding, sep), c.columns)
        out.append(S.typed(rows, c_custkey="long", balance="double", zip_code="zip").withColumn("form", F.lit(form)))
    return reduce(DataFrame.unionByName, out)


@query("""
SELECT lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS zip_code, 5 AS corners, CASE WHEN n_nationkey % 3 != 0 THEN CAST(1000 + n_nationkey AS BIGINT) END AS population FROM nation WHERE n_nationkey % 4 != 0 AND n_nationkey % 5 != 0 AND n_nationkey % 7 != 0
""")
def polygon_documents(spark, sf_dir):
    """SC04, SC05: areas of nested JSON; bad ZIPs, short rings and rings with gaps are left out, a population is the first known."""
    k = F.col("n_nationkey")
    ring = [F.array(k + a, (k + b).cast("double")) for a, b in ((0.0, 0), (1.0, 0), (1.0, 1), (0.0, 1))]
    gap = F.array(F.when(k % 7 != 0, k + 0.0), F.lit(0.0))
    contour = F.when(k % 4 == 0, F.array(*ring[:3])).otherwise(F.array(*ring, gap))
    one = F.struct(F.when(k % 5 == 0, "unknown").otherwise(k.cast("string")).alias("zipcode"), F.when(k % 3 != 0, k + 1000).alias("population"), contour.alias("contour"))
    folder = new_folder(spark, "polygons")
    documents_by_region(table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.to_json(F.collect_list(one)).alias("doc")), folder)
    areas = S.read_polygons(spark, folder)
    return areas.select("zip_code", F.size("contour").alias("corners")).join(S.zip_population(areas), "zip_code", "left")


@query("SELECT n_name AS name, CAST(n_nationkey * 1000 AS VARCHAR) AS income, CAST(NULL AS VARCHAR) AS absent FROM nation")
def json_matrix(spark, sf_dir):
    """SC06: documents of a row of names and rows of cells; a name that isn't there gives nulls."""
    row = F.array("n_regionkey", (F.col("n_nationkey") * 1000).cast("string"), "n_name")
    rows = table(spark, sf_dir, "nation").withColumn("n_regionkey", F.col("n_regionkey").cast("string"))
    docs = rows.groupBy("n_regionkey").agg(F.to_json(F.concat(F.array(F.array(F.lit("region"), F.lit("income"), F.lit("name"))), F.collect_list(row))).alias("doc"))
    folder = new_folder(spark, "matrix")
    documents_by_region(docs, folder)
    return S.read_json_matrix(spark, folder, ["name", "income", "absent"])


@query("SELECT event_id, event_type, value FROM events WHERE strftime(ts, '%Y-%m-%dT%H') >= '2024-01-05T12' ORDER BY event_id LIMIT 500")
def feed_pages(spark, sf_dir):
    """SC07, SL05: saved pages of a feed from a date on, as many rows as were asked for."""
    folder = new_folder(spark, "pages")
    S.write_json(table(spark, sf_dir, "events").select("event_id", "event_type", "value", F.date_format("ts", "yyyy-MM-dd'T'HH").alias("at")), folder)
    return S.read_pages(spark, folder, schema_of("event_id long, event_type string, value double, at string"), "2024-01-05T12", "at", "event_id", 500).drop("at")


@query("SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 3 = 1 THEN c_name END AS c_name, true AS named FROM customer WHERE c_custkey % 3 < 2")
def discovered_files(spark, sf_dir):
    """SC08, SO01, SO07: files found by what their headers have, those of several headers in one table."""
    c = table(spark, sf_dir, "customer")
    paths = []
    for k, columns in enumerate((["c_custkey", "c_acctbal"], ["c_custkey", "c_name", "c_acctbal"], ["c_custkey", "c_name"])):
        folder = new_folder(spark, "found")
        S.write_tables({"part": c.where(F.col("c_custkey") % 3 == k).select(*columns)}, folder, "csv")
        paths += spark.read.text(f"{folder}/part").inputFiles()
    found = S.discover(spark, paths, ["c_custkey", "c_acctbal"])
    return S.typed(found, c_custkey="long", c_acctbal="double").select("c_custkey", "c_acctbal", "c_name", F.col("source_file").isin(paths).alias("named"))


@query("SELECT n_nationkey, n_name, CAST(NULL AS VARCHAR) AS address, CAST(NULL AS DOUBLE) AS walk_score, CAST(NULL AS VARCHAR) AS walk_description FROM nation")
def optional_inputs(spark, sf_dir):
    """SC09, PF02, DQ03: a missing file has no rows, a missing column nulls, and without a cache the scores are null."""
    schema = schema_of("n_nationkey int, n_name string, address string")
    folder = new_folder(spark, "optional")
    there, missing = S.read_optional(spark, f"{sf_dir}/nation.parquet", schema), S.read_optional(spark, f"{folder}/none", schema)
    return L.enrich_scores(there.unionByName(missing), None, missing).select("n_nationkey", "n_name", "address", "walk_score", "walk_description")


@query("""
SELECT count(*) AS n_table, count(*) AS n_csv, count(*) FILTER (p_size % 5 != 0) AS n_with_target, true AS same, true AS in_order FROM part
""")
def sorted_sink(spark, sf_dir):
    """SK02, SK08, SL01, SC15: a table in a global order, nulls last, as Parquet and CSV, other columns left out."""
    size = F.when(F.col("p_size") % 5 != 0, F.col("p_size").cast("double"))
    folder = new_folder(spark, "sorted")
    S.write_sorted(table(spark, sf_dir, "part").withColumn("rent_usd", size), ["rent_usd", "p_partkey"], folder, ["p_partkey", "p_name", "rent_usd"])
    rows, text = spark.read.parquet(f"{folder}/parquet"), S.typed(S.read_csv(spark, f"{folder}/csv"), p_partkey="long", rent_usd="double")
    key = F.struct(F.col("rent_usd").isNull().alias("last"), "rent_usd", "p_partkey")
    # Files are named in their order, and each may hold only what comes after those before it.
    files = rows.groupBy(F.input_file_name().alias("file")).agg(F.min(key).alias("low"), F.max(key).alias("high"))
    order = files.agg(F.array_sort(F.collect_list(F.struct("file", "low", "high"))).alias("f")).select(F.expr("forall(sequence(1, size(f) - 1, if(size(f) > 1, 1, -1)), i -> i < 1 or i >= size(f) or f[i].low > f[i - 1].high)").alias("in_order"))
    both = rows.exceptAll(text.select(*rows.columns)).agg((F.count(F.lit(1)) == 0).alias("same"))
    counts = [rows.agg(F.count(F.lit(1)).alias("n_table")), text.agg(F.count(F.lit(1)).alias("n_csv")), S.read_features(spark, f"{folder}/parquet").agg(F.count(F.lit(1)).alias("n_with_target"))]
    return reduce(DataFrame.crossJoin, [*counts, both, order])


@query("""
SELECT r.run, o_orderkey % 5 AS fold, count(*) AS n, round(avg(abs(o_totalprice - o_totalprice * r.share)), 4) AS mae FROM orders, (VALUES ('first', 0.9), ('second', 1.05)) r(run, share) GROUP BY 1, 2
""")
def run_reports(spark, sf_dir):
    """SK06: the metrics of runs that follow each other, in one table."""
    folder = new_folder(spark, "runs")
    o = table(spark, sf_dir, "orders").withColumn("fold", F.col("o_orderkey") % 5)
    for run, share in (("first", 0.9), ("second", 1.05)):
        S.append_run(A.regression_metrics(o.withColumn("p", F.col("o_totalprice") * share), "o_totalprice", "p", "fold"), run, folder)
    return spark.read.parquet(folder).select("run", "fold", "n", F.round("mae", 4).alias("mae"))


@query("""
SELECT 'array' AS form, CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation UNION ALL SELECT 'records', p_partkey, p_name FROM part
""")
def record_sets(spark, sf_dir):
    """SK03, SK04, SC14: records as JSON lines and as arrays; a missing fixture has no rows."""
    folder, schema = new_folder(spark, "records"), schema_of("id long, name string")
    S.write_json(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), f"{folder}/lines")
    one = F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    documents_by_region(table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.to_json(F.collect_list(one)).alias("doc")), f"{folder}/arrays")
    arrays = S.read_json_rows(spark, f"{folder}/arrays", schema).select("id", "name").unionByName(S.read_json_rows(spark, f"{folder}/none", schema))
    return spark.read.schema(schema).json(f"{folder}/lines").withColumn("form", F.lit("records")).unionByName(arrays.withColumn("form", F.lit("array")))


@query(f"""
WITH m AS ({_BY_MONTH}), l AS (SELECT c_nationkey AS k, date_trunc('month', o_orderdate) AS m FROM orders JOIN customer ON o_custkey = c_custkey),
r AS (SELECT ({_CITY})[k + 1] AS z, * FROM m)
SELECT 'listings' AS name, count(*) AS n, CAST(sum(CASE WHEN m.n % 2 = 0 THEN m.n ELSE 0 END) AS DOUBLE) AS total FROM l JOIN m USING (k, m)
UNION ALL SELECT 'panel', count(*), round(sum(v + a) / 1000000, 3) FROM r UNION ALL SELECT 'incidents', count(*), CAST(sum(n) AS DOUBLE) FROM r WHERE n % 2 = 0 UNION ALL SELECT 'census', 0, NULL
""")
def clean_dataset(spark, sf_dir):
    """PL07, SK01, JN01, JN02: the whole clean-up job over files, a source missing; its tables as they lie there."""
    months = nation_months(spark, sf_dir).withColumn("zip_code", zip_of(F.col("k")))
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    names = ["crime_total_month_zip", "crime_violent_month_zip", "crime_property_month_zip"]
    tables = {
        "rent_index": months.select("zip_code", F.col("m").alias("date"), F.col("v").alias("zori_rent")),
        "value_index": months.select("zip_code", F.col("m").alias("date"), F.col("a").alias("zhvi_value")),
        "incidents": months.where("n % 2 = 0").select("zip_code", F.col("m").alias("month"), *[F.col("n").alias(c) for c in names], N.log_count("n").alias(f"{names[0]}_log1p")),
        "listings": orders.select(zip_of(F.col("c_nationkey")).alias("zip_code"), F.col("o_orderdate").alias("date"), F.col("o_totalprice").alias("rent_usd")),
        "census": None,
    }
    folder = new_folder(spark, "clean")
    L.build_clean_dataset(spark, tables, folder)
    census = S.read_optional(spark, f"{folder}/census", schema_of("zip_code string, total double"))
    sums = {"listings": F.sum(names[0]), "incidents": F.sum(names[0]), "panel": F.round(F.sum(F.col("zori_rent") + F.col("zhvi_value")) / 1000000, 3)}
    read = [spark.read.parquet(f"{folder}/{c}").agg(F.count(F.lit(1)).alias("n"), v.cast("double").alias("total")).withColumn("name", F.lit(c)) for c, v in sums.items()]
    return reduce(DataFrame.unionByName, [*read, census.agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("total")).withColumn("name", F.lit("census"))])


@query("""
SELECT s_name AS region, make_timestamp(2023, s_suppkey % 12 + 1, 1, 0, 0, 0) AS month, CASE WHEN s_suppkey % 11 != 0 THEN s_acctbal END AS median_rent, (s_suppkey % 50) / 10.0 AS redfin_mom_pct, -(s_suppkey % 40) / 8.0 AS redfin_yoy_pct FROM supplier
""")
def market_trend(spark, sf_dir):
    """PL04, PF04: metro momentum from a UTF-16 file with tabs, money and percentages as they are printed."""
    k = F.col("s_suppkey")
    rent = F.when(k % 11 == 0, "n/a").otherwise(F.concat(F.lit("$"), F.format_number("s_acctbal", 2)))
    rows = table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("Region"), F.concat(F.lit("2023-"), F.lpad((k % 12 + 1).cast("string"), 2, "0"), F.lit("-15")).alias("StartMonth"), rent.alias("MedianRent"),
        F.concat(F.lit("+"), ((k % 50) / 10.0).cast("string"), F.lit("%")).alias("RentMoM"), F.concat((-(k % 40) / 8.0).cast("string"), F.lit("%")).alias("RentYoY"),
    )
    folder = new_folder(spark, "trend")
    rows.write.option("header", True).option("encoding", "UTF-16").option("sep", "\t").csv(folder)
    return P.clean_trend(spark, folder)


@query("""
WITH e AS (SELECT *, CASE WHEN event_id % 9 != 0 THEN event_type ELSE 'Unknown' END AS incident_category, lpad(CAST(user_id % 20 AS VARCHAR), 5, '0') AS zip_code FROM events),
w AS (SELECT zip_code, incident_category, count(*) AS n FROM e WHERE ts > (SELECT max(ts) FROM e) - INTERVAL 12 MONTH GROUP BY 1, 2)
SELECT * FROM (SELECT zip_code, incident_category, n AS count, round(n / sum(n) OVER (PARTITION BY zip_code), 6) AS share, CAST(row_number() OVER (PARTITION BY zip_code ORDER BY n DESC, incident_category) AS INT) AS rank FROM w) WHERE rank <= 3
""")
def breakdown_by_zip(spark, sf_dir):
    """JN08, SM13: incidents that have a ZIP column keep it, those without a category count as unknown."""
    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("string").alias("incident_datetime"), F.when(F.col("event_id") % 9 != 0, F.col("event_type")).alias("incident_category"), F.concat((F.col("user_id") % 20).cast("string"), F.lit(".0")).alias("zip_code"))
    return P.category_breakdown(rows, None, 3).withColumn("share", F.round("share", 6))


@query("""
WITH l AS (SELECT unnest([corr(l_extendedprice * 2 + l_tax, l_extendedprice), corr(l_quantity, l_extendedprice), corr(l_discount, l_extendedprice)]) AS r FROM lineitem),
g AS (SELECT o_orderpriority AS feature, o_orderkey % 5 AS fold, sum(o_totalprice * CASE WHEN o_orderpriority = '1-URGENT' THEN 20 ELSE 1 END) AS gain FROM orders WHERE o_orderpriority != '5-LOW' OR o_orderkey % 5 = 0 GROUP BY 1, 2),
f AS (SELECT feature, sum(gain) AS g, sum(gain) / 5 AS mean, sqrt(greatest(sum(gain * gain) / 5 - (sum(gain) / 5) * (sum(gain) / 5), 0)) AS std FROM g GROUP BY 1),
w AS (SELECT 'near_deterministic' AS warning, count(*) AS n FROM l WHERE abs(r) >= 0.95 UNION ALL SELECT 'dominant_feature', count(*) FROM f WHERE g / (SELECT sum(g) FROM f) >= 0.5 UNION ALL SELECT 'unstable_feature', count(*) FROM f WHERE std / mean > 1)
SELECT * FROM w WHERE n > 0
""")
def audit_report(spark, sf_dir):
    """AG09, AG12: what there is to warn of: columns that give the target away, a feature that has most of the gain, one that only some folds use."""
    lines = table(spark, sf_dir, "lineitem").withColumn("twin", F.col("l_extendedprice") * 2 + F.col("l_tax"))
    certain = A.near_deterministic(A.correlations(lines, "l_extendedprice", ["twin", "l_quantity", "l_discount"]))
    rank, fold = F.col("o_orderpriority"), F.col("o_orderkey") % 5
    o = table(spark, sf_dir, "orders").where((rank != "5-LOW") | (fold == 0))
    gains = o.groupBy(rank.alias("feature"), fold.alias("fold")).agg(F.sum(F.col("o_totalprice") * F.when(rank == "1-URGENT", 20).otherwise(1)).alias("gain"))
    shares = A.importance_shares(gains.groupBy("feature").agg(F.sum("gain").alias("gain")))
    return A.audit_warnings(certain, shares, A.fold_stability(gains, 5))


@query("""
WITH p AS (SELECT p_partkey, p_size, p_retailprice AS y, CAST(p_size * 37.0 + 1.41421356 AS DOUBLE) AS p FROM part)
SELECT p_partkey, round(y - p, 2) AS delta_usd, round((y - p) / p, 4) AS delta_pct, false AS placeholder, y - p >= 250 AND (y - p) / p >= 0.1 AS flagged, false AS flags_alone, CASE WHEN p_size % 3 != 0 THEN p * 0.9 END AS low, CAST(NULL AS DOUBLE) AS high, 0 AS reasons, round(greatest(exp((p_size - 25) / 10.0) - 1, 0), 6) AS grown, round(ln(1 + y), 6) AS logged FROM p
""")
def model_outputs(spark, sf_dir):
    """ML12b, ML13, SM03, SM15: flags where actual rents are there and none without a model; output with real nulls; logarithms and back."""
    y, p = F.col("p_retailprice"), F.col("p_size") * 37.0 + 1.41421356
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", y.alias("actual_rent_usd"), p.alias("predicted"), F.when(F.col("p_size") % 3 == 0, float("nan")).otherwise(p * 0.9).alias("low"))
    plain = M.placeholder_flags(rows, "actual_rent_usd", "predicted").withColumnRenamed("flag_overpriced", "placeholder").drop("flag_reason")
    flagged = M.predict_or_flag(plain.drop("delta_usd", "delta_pct"), "predicted", None).withColumnRenamed("flag_overpriced", "flagged")
    alone = "flag_overpriced" in M.predict_or_flag(rows.drop("actual_rent_usd"), "predicted", None).columns
    out = N.normal_output(flagged, ["low", "high"], "reasons")
    return out.select(
        "p_partkey", "delta_usd", "delta_pct", "placeholder", "flagged", F.lit(alone).alias("flags_alone"), "low", "high", F.size("reasons").alias("reasons"),
        F.round(N.from_log((F.col("p_size") - 25) / 10.0), 6).alias("grown"), F.round(N.log_count("actual_rent_usd"), 6).alias("logged"),
    )


@query("""
WITH e AS (SELECT l_suppkey % 7 AS config, l_orderkey % 5 AS fold, avg(abs(l_quantity - 20 - l_suppkey % 7)) AS mae FROM lineitem GROUP BY 1, 2)
SELECT config, round(avg(mae), 6) AS mae_mean, round(stddev_pop(mae), 6) AS mae_std FROM e GROUP BY 1 ORDER BY 2, 3 LIMIT 1
""")
def best_configuration(spark, sf_dir):
    """SL04: of all runs that with the least mean error, of equal ones the steadiest."""
    rows = table(spark, sf_dir, "lineitem").withColumns({"config": F.col("l_suppkey") % 7, "fold": F.col("l_orderkey") % 5})
    each = rows.groupBy("config", "fold").agg(F.avg(F.abs(F.col("l_quantity") - 20 - F.col("config"))).alias("mae"))
    return M.best_run(each.groupBy("config").agg(F.round(F.avg("mae"), 6).alias("mae_mean"), F.round(F.stddev_pop("mae"), 6).alias("mae_std")))


@query("""
WITH s AS (SELECT p_partkey AS unit, p_brand AS zip_code, p_retailprice AS v, CASE p_size % 3 WHEN 0 THEN 'over' WHEN 1 THEN 'under' ELSE 'fair' END AS category FROM part),
a AS (SELECT * FROM s WHERE category = 'over' ORDER BY v DESC, unit LIMIT 1),
b AS (SELECT * FROM s WHERE category = 'under' AND zip_code NOT IN (SELECT zip_code FROM a) ORDER BY v, unit LIMIT 1),
d AS (SELECT * FROM s WHERE category = 'fair' AND zip_code NOT IN (SELECT zip_code FROM a UNION ALL SELECT zip_code FROM b) ORDER BY abs(v - 1000), unit LIMIT 1),
m AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM d)
SELECT * FROM m UNION ALL (SELECT * FROM s WHERE zip_code NOT IN (SELECT zip_code FROM m) ORDER BY v DESC, unit LIMIT 2)
""")
def representative_units(spark, sf_dir):
    """ML17: one unit of each category from a place of its own, a category without units filled from another, then others."""
    name = F.when(F.col("p_size") % 3 == 0, "over").when(F.col("p_size") % 3 == 1, "under").otherwise("fair")
    units = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("unit"), F.col("p_brand").alias("zip_code"), F.col("p_retailprice").alias("v"), name.alias("category"))
    orders = {"over": [F.desc("v"), F.asc("unit")], "under": [F.asc("v"), F.asc("unit")], "edge": [F.asc("unit")]}
    return M.representative_cases(units, orders, backup={"edge": ("fair", [F.abs(F.col("v") - 1000).asc(), F.asc("unit")])})


@query("""
WITH p AS (SELECT count(*) AS n, count(*) FILTER (p_size % 6 != 0) AS c FROM part)
SELECT 'count' AS summary, CAST(count(p_size) AS DOUBLE) AS p_size, CAST(count(p_retailprice) AS DOUBLE) AS p_retailprice, (SELECT n FROM p) AS rows, (SELECT c FROM p) AS with_place FROM part
UNION ALL SELECT 'mean', round(avg(p_size), 4), round(avg(p_retailprice), 4), (SELECT n FROM p), (SELECT c FROM p) FROM part
UNION ALL SELECT 'stddev', round(stddev(p_size), 4), round(stddev(p_retailprice), 4), (SELECT n FROM p), (SELECT c FROM p) FROM part
UNION ALL SELECT 'min', min(p_size), min(p_retailprice), (SELECT n FROM p), (SELECT c FROM p) FROM part UNION ALL SELECT 'max', max(p_size), max(p_retailprice), (SELECT n FROM p), (SELECT c FROM p) FROM part
""")
def table_profile(spark, sf_dir):
    """AG19, AG20: a table's summary, and how many rows have a place."""
    part = table(spark, sf_dir, "part").withColumn("place", F.when(F.col("p_size") % 6 != 0, F.col("p_size")))
    known = A.profile(part.select("p_size", "p_retailprice")).where(F.col("summary").isin("count", "mean", "stddev", "min", "max"))
    return known.select("summary", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in ("p_size", "p_retailprice")]).crossJoin(F.broadcast(A.coverage(part, ["place"])))
