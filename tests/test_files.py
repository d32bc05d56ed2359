import math

import duckdb
import pytest
from pyspark.sql import functions as F

from rentloom.operators import modelling as M
from rentloom.plans import queries_files as Q
from rentloom.sources import tables as S

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in ("nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return None if v is None else v if isinstance(v, (bool, int, str)) else str(v)[:19]


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_against_sql(spark, tables, name):
    got = Q.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = tables.execute(f"SELECT {', '.join(columns)} FROM ({Q.ORACLE[name]})").fetchall()
    assert len(tables.execute(Q.ORACLE[name]).description) == len(columns)
    key = lambda r: [(v is None, str(type(v)), v if v is not None else 0) for v in r]
    assert sorted(([plain(v) for v in r] for r in got.select(*columns).collect()), key=key) == sorted(([plain(v) for v in r] for r in want), key=key)


def test_csv_sinks_and_sources_agree_on_quotes(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "b", c'), (2, '"'), (3, None), (4, "back\\slash")], "k int, v string")
    S.write_tables({"t": rows}, str(tmp_path), "csv")
    S.write_sorted(rows, ["k"], str(tmp_path / "sorted"))
    for folder in (tmp_path / "t", tmp_path / "sorted" / "csv"):
        assert {(r.k, r.v) for r in S.read_csv(spark, str(folder)).collect()} == {("1", 'a "b", c'), ("2", '"'), ("3", None), ("4", "back\\slash")}


def test_matrix_without_a_column(spark, tmp_path):
    (tmp_path / "m.json").write_text('[["a", "b"], ["1", "2"], ["3"]]')
    got = S.read_json_matrix(spark, str(tmp_path / "m.json"), ["b", "c"]).collect()
    assert [(r.b, r.c) for r in got] == [("2", None), (None, None)]


def test_cases_that_fill_up_go_by_the_whole_order(spark):
    rows = spark.createDataFrame([(k, f"z{k}", 1.0, "over") for k in range(6)], "unit int, zip_code string, v double, category string").repartition(3)
    got = M.representative_cases(rows, {"over": [F.desc("v"), F.asc("unit")]}, total=3)
    assert sorted(r.unit for r in got.collect()) == [0, 1, 2]
