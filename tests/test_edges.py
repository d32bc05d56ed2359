import os
import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from rentloom.functions import text as X
from rentloom.operators import aggregates as A
from rentloom.operators import claims as C
from rentloom.operators import joins as J
from rentloom.operators import modelling as M
from rentloom.operators import ordering as O
from rentloom.operators import quantiles as Q
from rentloom.operators import ranking as K
from rentloom.sources import html as H
from rentloom.sources import staging as G
from rentloom.sources import tables as S


def test_missing_values_of_components(spark):
    inf, nan = float("inf"), float("nan")
    same = spark.createDataFrame([(1, 2.0, nan, inf), (2, 2.0, 50.0, None), (3, None, -5.0, 500.0), (4, inf, -inf, nan), (5, nan, None, 0.0)], "k int, c double, w double, t double")
    got = {r.k: (r.safety, r.walk, r.transit) for r in K.score_components(same, "c", "w", "t").collect()}
    assert got == {1: (1.0, 0.5, 0.5), 2: (1.0, 0.5, 0.5), 3: (0.5, 0.0, 1.0), 4: (0.5, 0.5, 0.5), 5: (0.5, 0.5, 0.0)}


def test_exact_quantiles(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), rng.choice([round(rng.gauss(0, 5), 1), None, 7.0])) for _ in range(2000)] + [(None, 1.0), ("d", 4.0), ("e", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    points = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    known = [v for _, v in rows if v is not None]
    assert list(Q.exact_quantiles(df, "v", points).first().q) == pytest.approx(np.quantile(known, points).tolist())
    for r in Q.exact_quantiles(df, "v", points, ["g"]).collect():
        assert list(r.q) == pytest.approx(np.quantile([v for g, v in rows if g == r.g and v is not None], points).tolist())
    assert Q.exact_quantiles(df.limit(0), "v", [0.5]).first().q[0] is None
    ranks = {r.v: r["rank"] for r in Q.mean_ranks(df, "v").collect()}
    assert all(ranks[v] == np.mean([i + 1 for i, x in enumerate(sorted(known)) if x == v]) for v in set(known))
    plan = Q.running_counts(df, "v")._jdf.queryExecution().toString()
    assert "percentile(" not in plan
    folds = df.withColumn("fold", F.pmod(F.xxhash64("g"), F.lit(3)))
    held = {r["__f"]: r["__m"] for r in M.medians_without(folds, "v", "fold").collect()}
    pairs = [(r.fold, r.v) for r in folds.collect()]
    assert held == {f: pytest.approx(np.median([v for g, v in pairs if g != f and v is not None])) for f in {g for g, _ in pairs}}


def test_as_of_joins_are_equi_joins(spark):
    months = [f"2024-{m:02d}-01" for m in range(1, 13)]
    rng = random.Random(1)
    panel = [(k, m, rng.choice([None, rng.random()])) for k in "abcd" for m in rng.sample(months, 5)]
    left = [(i, rng.choice("abcde"), rng.choice([*months, "2023-11-01", "2025-02-01", None])) for i in range(300)]
    p = spark.createDataFrame(panel, "k string, m string, v double").withColumn("month", F.to_timestamp("m")).drop("m")
    df = spark.createDataFrame(left, "i int, k string, m string").withColumn("month", F.to_timestamp("m"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for key in ("k", None):
            one = p if key else p.where("k = 'a'").drop("k")
            own = [(k, m, v) for k, m, v in panel if key or k == "a"]

            def want(k, m, own=own, key=key):
                mine = sorted((pm, v) for pk, pm, v in own if not key or pk == k)
                before = [x for x in mine if m is not None and x[0] <= m]
                if before and before[-1][1] is not None:
                    return before[-1][1], "exact" if before[-1][0] == m else "asof"
                late = mine[-1][1] if mine else None
                return (late, "latest") if late is not None else (None, "none")

            out = J.asof_join(df, one, ["v"], "month", key)
            assert {r.i: (r.v, r.provenance) for r in out.collect()} == {i: want(k, m) for i, k, m in left}
            joins = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "NestedLoop" in x and "Inner" not in x and "Cross" not in x]
            assert not joins
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plain_claims(wanted, offers):
    """The same, offer by offer."""
    taken, out = set(), {}
    for _, position, label, price in sorted(wanted, key=lambda w: w[1]):
        free = [o for o in sorted(offers, key=lambda o: o[1]) if o[1] not in taken]
        pick = None
        for pool in ([o for o in free if (o[2] or "").startswith(label)] if label is not None else [], free):
            priced = [o for o in pool if o[3] is not None] if price is not None else []
            pick = min(priced, key=lambda o: (abs(o[3] - price), o[1])) if priced else pool[0] if pool else None
            if pick:
                break
        out[position] = pick[1] if pick else None
        if pick:
            taken.add(pick[1])
    return out


def test_claims_against_plain_matching(spark):
    rng = random.Random(6)
    price = lambda: rng.choice([None, 100.0 * rng.randrange(8)])
    wanted = [("a", i, rng.choice([None, "1 Bed", "Studio", "9 Bed"]), price()) for i in range(60)]
    offers = [("a", i, rng.choice([None, "1 Bed", "1 Bed+", "Studio"]), price()) for i in range(45)]
    w, o = spark.createDataFrame(wanted, "z string, position long, label string, price double"), spark.createDataFrame(offers, "z string, offer long, label string, price double")
    assert {r.position: r.offer for r in J.claim_once(w, o, "z", "string").collect()} == plain_claims(wanted, offers)
    nowhere = w.unionByName(spark.createDataFrame([(None, 900, "1 Bed", 100.0), ("b", 901, None, None)], w.schema))
    assert {r.position: r.offer for r in J.claim_once(nowhere, o, "z", "string").collect()} == plain_claims(wanted, offers) | {900: None, 901: None}


def test_sources(spark, tmp_path):
    cells = spark.createDataFrame([("{'a': 'None Such St', 'b': None, 'c': True, 'd': \"False 'x' \"}",)], "p string")
    row = cells.select(S.literal_struct("p", "a string, b double, c boolean, d string").alias("s")).first().s
    assert tuple(row) == ("None Such St", None, True, "False 'x' ")
    zips = spark.createDataFrame([("123456",), ("941",), ("94110",)], "z string").select("z", X.recover_address(F.lit(None).cast("string"), F.lit(None).cast("string"), "z")["query"].alias("q"))
    assert {r.z: r.q.split(",")[0] for r in zips.collect()} == {"123456": "123456", "941": "00941", "94110": "94110"}
    (tmp_path / "big.csv").write_text("a,b\n" + "1,x\n" * 100_000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 50_000)
    assert S.read_csv(spark, str(tmp_path / "big.csv")).rdd.getNumPartitions() > 2
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "q.csv").write_text('a,b\n1,"x\ny"\n')
    assert S.read_csv(spark, str(tmp_path / "q.csv"), line_ends=True).first().b == "x\ny"
    skipped = []
    out = S.discover(spark, [str(tmp_path / "q.csv"), str(tmp_path / "missing.csv"), str(tmp_path / "q_clean.csv")], ["a"], skipped=skipped)
    assert out.columns[:2] == ["a", "b"] and [p for p, _ in skipped] == [str(tmp_path / "missing.csv")]
    rows = spark.createDataFrame([(2, "b"), (None, "c"), (1, "a")], "k int, v string")
    S.write_sorted(rows, ["k"], str(tmp_path / "sorted"))
    assert [r.k for r in spark.read.parquet(str(tmp_path / "sorted/parquet")).collect()] == [1, 2, None]


def rows_of_seven(offset, limit):
    return [(k,) for k in range(offset, min(7, offset + limit))]


def test_paged_feed_reads(spark):
    read = lambda **o: [r[0] for p in [S._PagedReader({"page": "3", "fetcher": f"{__name__}:rows_of_seven", **o})] for x in p.partitions() for r in p.read(x)]
    assert read(total="7") == list(range(7)) == read() and read(max_rows="5") == [0, 1, 2, 3, 4]


def test_listing_checks_and_titles(spark):
    good = ("T", "1 Bed", "$1,000+", "1 A St, CA 94110", "94110", "https://a/b", "2024-01-01")
    table = spark.createDataFrame([good, ("$900", "Loft", "900", "x", None, "a", "soon")], "title string, beds_baths string, pricing string, address string, zip_code string, url string, scraped_at string")
    got = {r.rule: (r.failures, r.severity) for r in A.check_listings(table).collect()}
    assert got["unit_label"] == (1, "hard") and got["title_not_price"] == (1, "soft") and got["address_has_zip"] == (1, "soft") and got["no_missing_cell"] == (1, "hard") and got["not_empty"][0] == 0
    assert {r.rule: r.failures for r in A.check_listings(table.limit(0).drop("url")).collect()}["not_empty"] == 1
    assert {r.rule: r.failures for r in A.check_listings(table.drop("url")).collect()}["exact_header"] == 1
    page = spark.createDataFrame([(1, '<div class="c"><a href="/homes/the-big-house.html"></a></div>')], "page_id long, html string")
    assert H.listing_cards(page, [{"card": ".c"}], "https://b").first().title == "The Big House"


def test_training_job(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, rng.choice("ab"), float(i % 5), 2500.0 + 400 * (i % 5) + rng.random() * 50, 2500.0) for i in range(120)]
    df = spark.createDataFrame(rows, "key int, zip string, beds double, rent double, idx double")
    report, audit = M.train_select_audit(df, [{"rounds": 3, "depth": 2}], "zip", ["beds"], "rent", "key", "idx", folds=2)
    got = report.collect()
    assert {r.variant for r in got} == {"raw_positive", "winsorized", "scope_band"} and sum(r.best for r in got) == 1
    assert next(r.lift for r in got if r.best) > 0 and audit.first().feature == "beds"
    data = A.fill_medians(M.model_input(df, "zip", ["beds"], "rent"), ["beds"])
    point = M.point_pipeline("zip", ["beds"], rounds=2).fit(data)
    band = M.LeafQuantiles([0.25, 0.75], trees=2, depth=2).fit(point.transform(data).select("features", "label"))
    M.save_bundle(str(tmp_path / "bundle"), point, band, {"features": ["beds"], "rows": 120})
    again = M.load_bundle(str(tmp_path / "bundle"), spark)
    about = M.load_metadata(str(tmp_path / "bundle"))
    assert about["quantiles"] == [0.25, 0.75] and about["rows"] == 120 and about["features"] == ["beds"] and "GBTRegressionModel" in about["stages"]
    M.save_bundle(str(tmp_path / "point"), point)
    assert M.load_bundle(str(tmp_path / "point"), spark)[1] is None
    one, two = (sorted(tuple(r) for r in M.predict(data, *m, "key").select("key", "fair_rent_p25", "fair_rent_p75").collect()) for m in ((point, band), again))
    assert one == two
    cases = spark.createDataFrame([("1", "in_band", 5.0), ("2", "in_band", 1.0), ("3", "over", 9.0)], "zip_code string, category string, gap double")
    picked = M.representative_cases(cases, {"over": [F.desc("gap")], "edge_case": []}, total=2, backup={"edge_case": ("in_band", ["gap"])}).collect()
    assert [r.zip_code for r in picked] == ["3", "2"]


def test_selection_holds_few_values(spark, monkeypatch):
    """Of a million distinct values no task sees more than ``small`` in the last step, and bins only before that."""
    df = spark.range(1_000_000).select(F.expr("pow(id * 7919 % 1000003, 3) - 1e12").alias("v"), (F.col("id") % 3).alias("g"))
    states = []
    keep = Q.kept_small
    monkeypatch.setattr(Q, "kept_small", lambda df, name: states.append(keep(df, name)) or states[-1])
    ranks = [0, 1, 333_333, 777_777, 999_999]
    got = Q.order_statistics(df, "v", lambda n: [F.lit(r) for r in ranks], small=500, width=50).first()
    assert got.n == 1_000_000
    values = np.sort([float(k * 7919 % 1000003) ** 3 - 1e12 for k in range(1_000_000)])
    assert list(got["at"]) == values[ranks].tolist()
    *steps, last, _ = states
    assert last.where("low < high").agg(F.max("n")).first()[0] <= 500 and all(s.count() <= len(ranks) for s in [*steps, last])


@pytest.mark.parametrize("kind", ["int", "bigint", "double", "float", "decimal(20,3)"])
def test_order_statistics_of_odd_values(spark, kind):
    big = {"bigint": [2**62 + k for k in range(40)] + [-(2**62), 2**62 + 7], "double": [float("inf"), float("-inf"), float("nan"), 0.0, -0.0, 5e-324, 1.7e308, -1.7e308, 1.0, 1.0000000000000002]}
    rows = [(x,) for x in [*big.get(kind, range(-20, 20)), None]]
    df = spark.createDataFrame(rows, f"v {kind}") if kind in big else spark.createDataFrame(rows, "v int").select(F.col("v").cast(kind).alias("v"))
    want = [r.v for r in df.where("v IS NOT NULL").orderBy("v").collect()]
    got = Q.order_statistics(df, "v", lambda n: [F.lit(k) for k in range(len(want))], small=2, width=3).first()
    assert [str(x) for x in got["at"]] == [str(float(x)) if kind == "float" else str(x) for x in want] or [x + 0 for x in got["at"] if x == x] == [x + 0 for x in want if x == x]


def test_places_in_a_global_order(spark):
    rng = random.Random(8)
    rows = [(k, rng.choice([1.0, 2.0, rng.random(), None])) for k in range(500)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(7)
    got = {r.k: r.place for r in O.numbered(df, [F.desc("v"), F.col("k")], "place").collect()}
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {k: i + 1 for i, (k, _) in enumerate(order)}
    weights = spark.createDataFrame([(k, k % 5) for k in range(300)], "k int, w int")
    assert {r.k: r.upto for r in O.running_total(weights, [F.col("k")], "w").collect()} == dict(enumerate(np.cumsum([k % 5 for k in range(300)]).tolist()))
    assert O.numbered(df.limit(0), [F.col("k")]).count() == 0


def test_staged_tables_go_with_their_scope(spark):
    with G.scope(spark):
        one = G.materialize(spark.range(3), "x")
        (path,) = [f.rsplit("/", 1)[0] for f in one.inputFiles()[:1]]
        assert one.count() == 3
    assert not os.path.exists(path.removeprefix("file://"))
    assert G.kept_small(spark.range(5), "y", most=4).inputFiles() and not G.kept_small(spark.range(4), "y", most=4).inputFiles()


def test_ranks_of_all_rows(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([None, 1.0, 5.0, rng.random() * 9]), rng.choice([None, 50.0, 100.0]), rng.choice([20.0, float("nan")])) for k in range(300)]
    df = spark.createDataFrame(rows, "k int, c double, w double, t double").repartition(5)
    weights = {"safety": 1, "walk": 2, "transit": 1}
    all_rows = K.rank_listings(df, weights, "c", "w", "t", "k")
    got = [r.k for r in all_rows.orderBy("rank").collect()]
    scored = K.score_components(df, "c", "w", "t").withColumn("s", K.composite(K.normal_weights(weights))).collect()
    assert got == [r.k for r in sorted(scored, key=lambda r: (-r.s, r.k))]
    assert {(r.n_input, r.n_returned) for r in all_rows.collect()} == {(300, 300)}
    few = K.rank_listings(df, weights, "c", "w", "t", "k", 7)
    assert [r.k for r in few.orderBy("rank").collect()] == got[:7]
    assert "partitionBy" not in str(all_rows) and K.rank_listings(df.limit(0), weights, "c", "w", "t", "k").count() == 0


@pytest.mark.parametrize("kind", ["spread", "ties", "edge"])
def test_lists_of_many_users(spark, kind):
    rng = random.Random(kind)
    value = {"spread": lambda: rng.random(), "ties": lambda: rng.choice([0.0, 0.5, 0.5 + 1e-13, 1.0]), "edge": lambda: rng.random()}[kind]
    points = [[value() for _ in range(3)] for _ in range(4000)]
    if kind == "edge":
        points = [[a, b, max(0.0, 1 - a - b) / 2] for a, b, _ in points]
    rows = [(k, -a, 100 * b, 100 * c) for k, (a, b, c) in enumerate(points)]
    df = spark.createDataFrame(rows, "k int, c double, w double, t double").repartition(4)
    users = spark.createDataFrame([(u, *[rng.choice([0.0, 1.0, -1.0, None, rng.random()]) for _ in range(3)]) for u in range(60)], "u int, safety double, walk double, transit double")
    got = {(r.u, r["rank"]): r.k for r in K.rank_for_users(df, users, "u", "c", "w", "t", "k", 5).collect()}
    scored = K.score_components(df, "c", "w", "t")
    held = [(r.k, r.safety, r.walk, r.transit) for r in scored.collect()]
    want = {}
    for r in K.normal_weight_columns(users).collect():
        best = sorted(held, key=lambda x: (-(x[1] * r.safety + x[2] * r.walk + x[3] * r.transit), x[0]))[:5]
        want |= {(r.u, i + 1): x[0] for i, x in enumerate(best)}
    assert got == want
    near = K.skyband(scored, "k", 5).count()
    assert near < (1000 if kind == "spread" else 400 if kind == "ties" else 4001)


@pytest.mark.parametrize("block", [1000, 7])
def test_users_meet_arrays_of_listings(spark, monkeypatch, block):
    """Pairs of users and listings are not rows to be sorted, in whatever arrays listings come; a user may come twice."""
    monkeypatch.setattr(K, "BLOCK", block, raising=False)
    rng = random.Random(block)
    rows = [(k, -rng.random(), 100 * rng.random(), 100 * rng.choice([0.2, 0.9])) for k in range(300)]
    users = [(u % 18 if u % 18 != 4 else None, rng.random(), rng.random(), rng.random()) for u in range(20)]
    df, w = spark.createDataFrame(rows, "k int, c double, w double, t double"), spark.createDataFrame(users, "u int, safety double, walk double, transit double")
    out = K.rank_for_users(df, w, "u", "c", "w", "t", "k", 4)
    assert out.columns == ["k", "c", "w", "t", "safety", "walk", "transit", "u", "composite", "rank"]
    held = [(r.k, r.safety, r.walk, r.transit) for r in K.score_components(df, "c", "w", "t").collect()]
    every = {}
    for r in K.normal_weight_columns(w).collect():
        every.setdefault(r.u, []).extend((-(x[1] * r.safety + x[2] * r.walk + x[3] * r.transit), x[0]) for x in held)
    assert sorted((str(r.u), r["rank"], r.k, r.composite) for r in out.collect()) == sorted((str(u), i + 1, k, -c) for u, x in every.items() for i, (c, k) in enumerate(sorted(x)[:4]))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window [") < plan.index("Generate inline") < plan.index("Join Cross" if "Join Cross" in plan else "Join Inner")


def test_files_are_found_by_header(spark, tmp_path):
    heads = ["a,b", "b,a,c", "x,y"]
    for k in range(500):
        name = f"f {k}+%41.csv" if k == 7 else f"f{k}.csv"
        (tmp_path / name).write_text(f"{heads[k % 3]}\n{k},{k + 1},9\n" if k % 3 == 1 else f"{heads[k % 3]}\n{k},{k + 1}\n")
    (tmp_path / "g_clean.csv").write_text("a,b\n1,2\n")
    (tmp_path / "bad.csv").write_bytes(b"\xff\xfe,a\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "bom.csv").write_bytes(b"\xef\xbb\xbfa,b\r\n-1,-2\r\n")
    paths = [str(p) for p in tmp_path.iterdir()] + [str(tmp_path / "none.csv")]
    skipped = []
    out = S.discover(spark, paths, ["a", "b"], skipped=skipped)
    assert sorted(p.rsplit("/", 1)[-1] for p, _ in skipped) == ["bad.csv", "none.csv"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 3
    got = {(r.source_file, r.a, r.b, r.c) for r in out.collect()}
    want = {(str(tmp_path / ("f 7+%41.csv" if k == 7 else f"f{k}.csv")), *((str(k), str(k + 1), None) if k % 3 == 0 else (str(k + 1), str(k), "9"))) for k in range(500) if k % 3 < 2}
    assert got == want | {(str(tmp_path / "bom.csv"), "-1", "-2", None)}
    assert S.discover(spark, [], ["a"]) is None


def test_a_repeated_key_fails_in_the_plan(spark):
    left = spark.createDataFrame([(1, "a"), (2, None)], "k int, z string")
    right = spark.createDataFrame([("a", 3), (None, 4), (None, 5)], "z string, n int")
    assert {r.k: r.n for r in J.left_features(left, right, ["z"], {"n": 0}).collect()} == {1: 3, 2: 0}
    twice = J.left_features(left, right.unionByName(spark.createDataFrame([("a", 9)], "z string, n int")), ["z"], {"n": 0})
    with pytest.raises(Exception, match="not unique"):
        twice.collect()


def test_counters_of_one_run(spark):
    counters = A.Counters()
    df = counters.watch(spark.range(10), "read", even=F.col("id") % 2 == 0)
    df = counters.watch(df.where("id > 3"), "kept", last=F.col("id") == 9)
    df.groupBy().count().collect()
    assert counters.counts() == {"read": {"rows": 10, "even": 5}, "kept": {"rows": 6, "last": 1}}
    assert {tuple(r) for r in counters.rows(spark).collect()} == {("read", "rows", 10), ("read", "even", 5), ("kept", "rows", 6), ("kept", "last", 1)}
    with pytest.raises(ValueError):
        counters.watch(df, "read")
    assert A.watched(df, None, "x") is df


def test_sketch_states_add_up(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=40_000), rng.exponential(5, 20_000), np.full(9_000, 1.0)])
    df = spark.createDataFrame([(int(k % 9), float(v)) for k, v in enumerate(values)] + [(3, None), (None, 2.0), (4, float("nan"))], "day int, v double")
    states = A.sketch_states(df.where("day < 5 OR day IS NULL"), [F.col("day")], "v").unionByName(A.sketch_states(df.where("day >= 5"), [F.col("day")], "v"))
    points = [0.0, 0.1, 0.5, 0.9, 0.99, 1.0]
    row = A.merged_quantiles(states, points).first()
    every = np.sort(np.append(values, 2.0))
    assert (row.n, row.low, row.high) == (len(every), every[0], every[-1])
    for p, q in zip(points, row.q, strict=True):
        low, high = np.searchsorted(every, q, "left") / len(every), np.searchsorted(every, q, "right") / len(every)
        assert low - 2 * A.sketch_error() <= p <= high + 2 * A.sketch_error()
    assert {r.day for r in A.merged_quantiles(states, [0.5], ["day"]).collect()} == {None, *range(9)}


def test_band_by_forest_weights(spark):
    rng = random.Random(9)
    rows = [(k, float(k % 4), 10.0 * (k % 4) + rng.gauss(0, 1 + k % 4)) for k in range(2000)]
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.createDataFrame(rows, "key int, x double, label double"))
    band = M.LeafQuantiles([0.25, 0.5, 0.75], trees=4, depth=3).fit(df)
    got = {r.key: [r.q0, r.q1, r.q2] for r in band.transform(df, "key").collect()}
    leaves = {r.key: tuple(r.leaf) for r in band.model.transform(df).select("key", vector_to_array("__leaf").alias("leaf")).collect()}
    y = np.array([r[2] for r in rows])
    held = np.array([leaves[k] for k in range(2000)])
    for k in range(0, 2000, 97):
        weight = np.mean([(held[:, t] == held[k, t]) / (held[:, t] == held[k, t]).sum() for t in range(4)], 0)
        order = np.argsort(y)
        upto = np.cumsum(weight[order])
        for p, q in zip([0.25, 0.5, 0.75], got[k], strict=True):
            near = [y[order][np.searchsorted(upto, p + d)] for d in (-0.04, 0.04)]
            assert near[0] <= q <= near[1]
    inside = np.mean([got[k][0] <= y[k] <= got[k][2] for k in range(2000)])
    assert 0.45 <= inside <= 0.55


def test_contributions_are_changes_of_the_prediction(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice("ab"), float(rng.randrange(5)), rng.random(), 1.0, 1000.0 + 300 * rng.randrange(5)) for k in range(150)]
    num = ["beds", "size", "flat"]
    df = M.model_input(spark.createDataFrame(rows, "key int, zip string, beds double, size double, flat double, rent double"), "zip", num, "rent")
    model = M.point_pipeline("zip", num, rounds=4).fit(df)
    predicted = lambda d: {r.key: r.p for r in model.transform(d).select("key", M.N.from_log("prediction").alias("p")).collect()}
    own = predicted(df)
    moved = {c: predicted(df.withColumn(c, F.lit(float(np.median([r[2 + k] for r in rows]))))) for k, c in enumerate(num)}
    for n in (2, 5):
        got = {}
        for r in M.contributions(df, model, num, "key", n).collect():
            got.setdefault(r.key, {})[r["rank"]] = (r.feature, r.contribution)
        for k, ranks in got.items():
            want = sorted(((own[k] - moved[c][k], c) for c in num), key=lambda x: (-abs(x[0]), x[1]))[:n]
            assert [ranks[i + 1] for i in range(len(want))] == [(c, pytest.approx(d)) for d, c in want]
        assert len(got) == 150


def test_bands_come_without_a_join(spark):
    """Each row has the band of its leaves, whatever its key is, and nothing is shuffled for it."""
    rng = random.Random(8)
    rows = [(None if k < 2 else k // 2, rng.choice("ab"), float(k % 4), 1000.0 + 400 * (k % 4) + 50 * rng.random()) for k in range(120)]
    data = M.model_input(spark.createDataFrame(rows, "key int, zip string, beds double, rent double"), "zip", ["beds"], "rent")
    point = M.point_pipeline("zip", ["beds"], rounds=2).fit(data)
    band = M.LeafQuantiles([0.25, 0.75], trees=3, depth=2).fit(point.transform(data).select("features", "label"))
    out = M.predict(data, point, band, "key")
    got = out.select("zip", "beds", "fair_rent_p25", "fair_rent_p75").collect()
    assert len(got) == 120 and all(0 < r.fair_rent_p25 <= r.fair_rent_p75 for r in got)
    assert len({tuple(r) for r in got}) == len({(r.zip, r.beds) for r in got})
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert band.transform(point.transform(data).limit(0), "key").collect() == []


@pytest.mark.parametrize("seed, block", [(1, 6), (4, 20)])
def test_claims_in_rounds(spark, seed, block):
    """A large area in blocks of a few offers gets what choosing in turn gives."""
    rng = random.Random(seed)
    price = lambda: rng.choice([None, float("nan"), 100.0 * rng.randrange(8), rng.randrange(900) + 0.5])
    n = 30 if seed != 4 else 20
    wanted = [(rng.choice("ab"), i, rng.choice([None, "", "1 Bed", "Studio", "9 Bed"]), price()) for i in range(n)]
    offers = [(rng.choice("abc"), i, rng.choice([None, "1 Bed", "1 Bed+", "Studio"]), price()) for i in range(24 if seed != 4 else 40)]
    w, o = spark.createDataFrame(wanted, "z string, position long, label string, price double"), spark.createDataFrame(offers, "z string, offer long, label string, price double")
    clean = lambda rows, z: [(a, b, c, None if d is None or d != d else d) for a, b, c, d in rows if a == z]
    want = {}
    for z in "ab":
        want |= plain_claims(clean(wanted, z), clean(offers, z))
    assert {r.position: r.offer for r in C.claim_in_rounds(w, o, "z", block).collect()} == want


def test_one_area_with_most_rows(spark):
    rng = random.Random(11)
    wanted = [("hot" if i % 3 else rng.choice("ab"), i, rng.choice(["1 Bed", "2 Bed"]), 50.0 * rng.randrange(30)) for i in range(45)] + [(None, 900, None, 1.0)]
    offers = [("hot" if i % 3 else rng.choice("ab"), i, rng.choice(["1 Bed", "2 Bed", None]), 50.0 * rng.randrange(30)) for i in range(60)]
    w, o = spark.createDataFrame(wanted, "z string, position long, label string, price double"), spark.createDataFrame(offers, "z string, offer long, label string, price double")
    want = {900: None}
    for z in ("hot", "a", "b"):
        want |= plain_claims([x for x in wanted if x[0] == z], [x for x in offers if x[0] == z])
    for most in (50, 1000):
        assert {r.position: r.offer for r in J.claim_once(w, o, "z", "string", most).collect()} == want
