"""Rent models: variants, folds, boosted trees, quantile bands, calibration, flags."""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Bucketizer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rentloom.functions import constants as C
from rentloom.functions import numbers as N
from rentloom.operators import aggregates as A
from rentloom.operators import joins as J
from rentloom.operators import quantiles as Q
from rentloom.sources.staging import materialize

LEAST_ROWS = 50


def positive(df: DataFrame, target: str) -> DataFrame:
    return df.where(F.col(target) > 0)


def winsorized(df: DataFrame, target: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Positive targets, clipped at exact quantiles."""
    rows = positive(df, target)
    q = Q.exact_quantiles(rows, target, [low, high]).withColumnRenamed("q", "__q")
    return rows.crossJoin(F.broadcast(q)).withColumn(target, F.least(F.greatest(F.col(target), F.col("__q")[0]), F.col("__q")[1])).drop("__q")


def in_scope(df: DataFrame, target: str, low: float = C.SCOPE_RANGE[0], high: float = C.SCOPE_RANGE[1]) -> DataFrame:
    return df.where(F.col(target).between(low, high))


def variants(df: DataFrame, target: str) -> dict[str, DataFrame]:
    """The three training sets, without those of fewer than LEAST_ROWS rows."""
    every = {"raw_positive": positive(df, target), "winsorized": winsorized(df, target), "scope_band": in_scope(df, target)}
    return {k: v for k, v in every.items() if v.limit(LEAST_ROWS).count() == LEAST_ROWS}


def model_input(df: DataFrame, category: str, numerics: list[str], target: str | None = None) -> DataFrame:
    """Unknown category as "UNK", numbers as doubles, missing columns null, the target as its logarithm."""
    num = {c: F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double") for c in numerics}
    out = df.withColumns(num | {category: F.coalesce(F.col(category).cast("string"), F.lit("UNK"))})
    return out if target is None else out.withColumn("label", F.log1p(F.col(target).cast("double")))


def fold_of(key: Column, folds: int = 5) -> Column:
    """A fold from the md5 of a stable key, the same in any engine."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % folds


def point_pipeline(category: str, numerics: list[str], label: str = "label", rounds: int = 220, depth: int = 3, least: int = 3, step: float = 0.05, seed: int = 42) -> Pipeline:
    """One-hot category (unseen ones are all zeros), numbers, boosted trees. Numbers have no nulls: see fill_medians."""
    return Pipeline(
        stages=[
            StringIndexer(inputCol=category, outputCol="__index", handleInvalid="keep"),
            OneHotEncoder(inputCols=["__index"], outputCols=["__hot"], dropLast=True),
            VectorAssembler(inputCols=["__hot", *numerics], outputCol="features"),
            GBTRegressor(labelCol=label, featuresCol="features", maxIter=rounds, maxDepth=depth, minInstancesPerNode=least, stepSize=step, subsamplingRate=0.85, featureSubsetStrategy="0.8", seed=seed),
        ]
    )


def out_of_fold(df: DataFrame, make_model, fold: str, folds: int) -> DataFrame:
    """Predictions for each fold from a model of the others; make_model(train) gives a transformer."""
    parts = [make_model(df.where(F.col(fold) != k)).transform(df.where(F.col(fold) == k)) for k in range(folds)]
    return reduce(DataFrame.unionByName, parts)


def importances(model: PipelineModel, names: list[str]) -> list[tuple[str, float]]:
    """Gain by input column; the one-hot parts of the category count as one."""
    values = model.stages[-1].featureImportances.toArray()
    hot = len(values) - len(names)
    return [("category", float(values[:hot].sum())), *[(n, float(v)) for n, v in zip(names, values[hot:], strict=True)]]


class LeafQuantiles:
    """Quantiles by a forest's weights: a row's leaf-mates of all trees, each tree's weighing 1 together, are one weighted
    sample, and its quantiles are the row's.

    Labels are counted in BINS ranges of about equal weight, so a leaf is a short histogram, and a row's sample is the mean
    of its leaves'. There are 2^depth leaves a tree at most, which bounds what tasks hold. Within a range values count as
    spread evenly between its least and greatest.
    """

    BINS = 128

    def __init__(self, quantiles: list[float], trees: int = 20, depth: int = 5, seed: int = 42):
        self.quantiles, self.trees, self.depth, self.seed = quantiles, trees, depth, seed

    def fit(self, df: DataFrame, features: str = "features", label: str = "label") -> LeafQuantiles:
        forest = RandomForestRegressor(labelCol=label, featuresCol=features, numTrees=self.trees, maxDepth=self.depth, minInstancesPerNode=10, seed=self.seed, leafCol="__leaf")
        self.model = forest.fit(df)
        edges = df.agg(F.percentile_approx(label, [k / self.BINS for k in range(1, self.BINS)], 10_000).alias("e")).first()["e"] or []
        splits = [float("-inf"), *sorted(set(edges)), float("inf")]
        binned = Bucketizer(splits=splits, inputCol=label, outputCol="__bin").transform(self.model.transform(df).select(F.col(label).cast("double").alias(label), "__leaf"))
        placed = binned.select(F.col("__bin").cast("int").alias("bin"), F.col(label).alias("y"), F.posexplode(vector_to_array("__leaf")).alias("tree", "leaf"))
        # One row per tree, leaf and range: BINS times 2^depth times the trees at most.
        self.table = materialize(placed.groupBy("tree", F.col("leaf").cast("int").alias("leaf"), "bin").agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("low"), F.max("y").alias("high")), "leaves")
        return self

    def _histograms(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tree, leaf, range) shares of each leaf, and the least and greatest value of each range."""
        held = self.table.toArrow()
        tree, leaf, part, n, low, high = (held.column(c).to_numpy() for c in ("tree", "leaf", "bin", "n", "low", "high"))
        shares = np.zeros((int(tree.max()) + 1, int(leaf.max()) + 1, int(part.max()) + 1), np.float32)
        shares[tree, leaf, part] = n
        shares /= np.maximum(shares.sum(-1, keepdims=True), 1)
        least, most = np.full(shares.shape[2], np.inf), np.full(shares.shape[2], -np.inf)
        np.minimum.at(least, part, low)
        np.maximum.at(most, part, high)
        return shares, least, most

    def _quantiles(self) -> Column:
        """An array of a row's quantiles, from its leaves."""
        shares, least, most = self._histograms()
        points = np.array(self.quantiles)

        @F.pandas_udf("array<double>")
        def weighted(leaves: pd.Series) -> pd.Series:
            # Rows that share all their leaves share the quantiles; with few and shallow trees most do.
            every, place = np.unique(np.stack(leaves.to_numpy()).astype(np.int64), axis=0, return_inverse=True) if len(leaves) else (np.zeros((0, 1), np.int64), [])
            out = []
            for k in range(0, len(every), 1000):
                leaf = every[k : k + 1000]
                sample = shares[np.arange(leaf.shape[1]), leaf].mean(1).astype(float)
                upto = np.cumsum(sample, 1)
                upto /= upto[:, -1:]
                for row, own in zip(upto, sample, strict=True):
                    at = np.minimum(np.searchsorted(row, points), len(row) - 1)
                    share = np.clip(1 - (row[at] - points) / np.maximum(own[at], 1e-12), 0, 1)
                    out.append(least[at] + (most[at] - least[at]) * share)
            return pd.Series([out[k] for k in np.ravel(place)], dtype=object)

        return weighted(vector_to_array("__leaf"))

    def add(self, df: DataFrame) -> DataFrame:
        """The rows with q0, q1, ... beside their own columns."""
        quantiles = self._quantiles()
        forest = self.model.copy({self.model.predictionCol: "__forest"})
        found = forest.transform(df).withColumn("__q", quantiles)
        return found.select(*df.columns, *[F.col("__q")[k].alias(f"q{k}") for k in range(len(self.quantiles))])

    def transform(self, df: DataFrame, key: str) -> DataFrame:
        """(key, q0, q1, ...)."""
        return self.add(df).select(key, *[f"q{k}" for k in range(len(self.quantiles))])


def baseline_cv(df: DataFrame, index: str, target: str, fold: str) -> DataFrame:
    """The index as prediction, its median over the other folds where it is null; metrics per fold."""
    medians = medians_without(df, index, fold)
    return A.regression_metrics(df.join(F.broadcast(medians), F.col(fold) == F.col("__f")).withColumn("__p", F.coalesce(index, "__m")), target, "__p", fold)


def medians_without(df: DataFrame, value: str, fold: str) -> DataFrame:
    """(__f, __m): for each fold the median of the other folds' values; rows without a fold are outside of all."""
    return Q.exact_quantiles(df, value, [0.5], [fold], others=True).select(F.col(fold).alias("__f"), F.col("q")[0].alias("__m"))


def best_run(runs: DataFrame, mean: str = "mae_mean", std: str = "mae_std") -> DataFrame:
    return runs.orderBy(mean, std).limit(1)


def lift(model_mae: Column, baseline_mae: Column) -> tuple[Column, Column]:
    """(share by which the error is less than the baseline's, whether it is under a tenth)."""
    v = F.try_divide(baseline_mae - model_mae, baseline_mae)
    return v, v < 0.10


def sweep(df: DataFrame, configs: list[dict], category: str, numerics: list[str], target: str, key: str, folds: int = 5) -> DataFrame:
    """One row per configuration: name, mae_mean, mae_std. Each fit is distributed; configurations follow each other."""
    data = A.fill_medians(model_input(df, category, numerics, target), numerics).withColumn("fold", fold_of(F.col(key), folds))
    out = []
    for config in configs:
        scored = out_of_fold(data, lambda t, c=config: point_pipeline(category, numerics, **c).fit(t), "fold", folds)
        per = A.regression_metrics(scored.withColumn("__p", N.from_log("prediction")), target, "__p", "fold")
        out.append(per.agg(F.avg("mae").alias("mae_mean"), F.stddev_pop("mae").alias("mae_std")).select(F.lit(str(config)).alias("name"), "mae_mean", "mae_std"))
    return reduce(DataFrame.unionByName, out)


def conformal(df: DataFrame, actual: str, low: str, high: str, share: float = 0.5, point: str | None = None) -> DataFrame:
    """One row: n, offset, coverage and width before and after widening by the offset, and the mean absolute error of a
    point prediction where there is one.

    The offset is the score of rank ceil((n + 1) share), not below 0; scores are how far a value lies outside its band.
    That rank's score is selected, not sorted for.
    """
    score = F.greatest(F.col(low) - F.col(actual), F.col(actual) - F.col(high))
    rows = df.select(F.col(actual).alias("y"), F.col(low).alias("lo"), F.col(high).alias("hi"), score.alias("s"), *([F.abs(F.col(actual) - F.col(point)).alias("off")] if point else [])).where("s IS NOT NULL")
    place = lambda n: F.greatest(F.least(F.ceil((n + 1) * share), n), F.lit(1)) - 1
    found = Q.order_statistics(rows, "s", lambda n: [place(n)]).select(F.greatest(F.get("at", F.lit(0)), F.lit(0.0)).alias("offset"))
    wide = rows.crossJoin(F.broadcast(found))
    lo2, hi2 = F.greatest(F.col("lo") - F.col("offset"), F.lit(0.0)), F.col("hi") + F.col("offset")
    inside = lambda a, b: F.avg(F.col("y").between(a, b).cast("double"))
    return wide.agg(
        F.count(F.lit(1)).alias("n"), F.max("offset").alias("offset"), inside(F.col("lo"), F.col("hi")).alias("coverage_raw"),
        F.avg(F.col("hi") - F.col("lo")).alias("width_raw"), inside(lo2, hi2).alias("coverage"), F.avg(hi2 - lo2).alias("width"),
        *([F.avg("off").alias("point_mae")] if point else []),
    )


def predict(df: DataFrame, point: PipelineModel, band: LeafQuantiles | None, key: str) -> DataFrame:
    """Adds predicted_rent_usd and, with a band, fair_rent_p25 and fair_rent_p75. A row gets its band where it is: none is
    shuffled, and keys may be null or come twice."""
    out = point.transform(df).withColumn("predicted_rent_usd", N.from_log("prediction"))
    if band is None:
        return out
    return band.add(out).withColumns({"fair_rent_p25": N.from_log("q0"), "fair_rent_p75": N.from_log("q1")}).drop("q0", "q1")


def flag_overpriced(df: DataFrame, actual: str, predicted: str, p75: str | None = None, dollars: float = 250.0, share: float = 0.10) -> DataFrame:
    """Adds delta_usd, delta_pct, flag_overpriced, flag_reason. Above the band if there is one, else by both margins."""
    d, pct = N.delta(actual, predicted)
    by_delta = F.coalesce((d >= dollars) & (pct >= share), F.lit(False))
    banded = F.col(p75).isNotNull() & F.col(actual).isNotNull() if p75 else F.lit(False)
    above = F.col(actual) > F.col(p75) if p75 else F.lit(False)
    return df.withColumns(
        {
            "delta_usd": F.round(d, 2), "delta_pct": F.round(pct, 4), "flag_overpriced": F.when(banded, above).otherwise(by_delta),
            "flag_reason": F.when(banded, "actual_rent_above_p75").otherwise("delta_pct_exceeds_threshold"),
        }
    )


def placeholder_flags(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Without a model nothing is flagged."""
    d, pct = N.delta(actual, predicted)
    return df.withColumns({"delta_usd": F.round(d, 2), "delta_pct": F.round(pct, 4), "flag_overpriced": F.lit(False), "flag_reason": F.lit("placeholder_model")})


def predict_or_flag(df: DataFrame, predicted: str, p75: str | None, actual: str = "actual_rent_usd") -> DataFrame:
    """Flags where the input has actual rents, else the predictions alone."""
    return flag_overpriced(df, actual, predicted, p75) if actual in df.columns else df


def price_category(actual: Column, p25: Column, p75: Column, point: Column) -> Column:
    edge = 0.05 * (p75 - p25)
    plain = F.when(actual > point * 1.10, "overpriced").when(actual < point * 0.90, "underpriced").otherwise("in_band")
    banded = (
        F.when(actual > p75 * 1.10, "overpriced_clear").when(actual < p25 * 0.90, "underpriced_clear")
        .when((F.abs(actual - p75) <= edge) | (F.abs(actual - p25) <= edge), "edge_case").when(actual.between(p25, p75), "in_band").otherwise("out_of_band_minor")
    )
    return F.when(p25.isNull() | p75.isNull(), plain).otherwise(banded)


def contributions(df: DataFrame, model: PipelineModel, numerics: list[str], key: str, n: int = 5) -> DataFrame:
    """(key, feature, contribution, rank): by how much the prediction changes when a feature is put at its median, the n
    largest of each row. A row is scored with each feature in turn where it is, and never shuffled."""
    made = ["__index", "__hot", "features", "prediction"]
    rows = df.drop(*[c for c in made if c in df.columns]).crossJoin(F.broadcast(A.medians(df, numerics)))
    scored = model.transform(rows).withColumn("__own", N.from_log("prediction")).drop(*made)
    for k, c in enumerate(numerics):
        moved = scored.withColumns({"__kept": F.col(c), c: F.col(f"__{c}")})
        scored = model.transform(moved).withColumns({f"__p{k}": N.from_log("prediction"), c: F.col("__kept")}).drop(*made, "__kept")
    each = F.array(*[F.struct((F.col("__own") - F.col(f"__p{k}")).alias("d"), F.lit(c).alias("feature")) for k, c in enumerate(numerics)])
    size = lambda x: F.abs(x["d"])
    before = lambda x, y: F.when((size(x) > size(y)) | ((size(x) == size(y)) & (x["feature"] < y["feature"])), -1).otherwise(1)
    first = scored.select(key, F.posexplode(F.slice(F.array_sort(each, before), 1, n)).alias("place", "x"))
    return first.select(key, "x.feature", F.col("x.d").alias("contribution"), (F.col("place") + 1).alias("rank"))


def score_units(df: DataFrame, actual: str, predicted: str, p25: str, p75: str, keys: list[str] = C.UNIT_KEYS, position: str = "position", scope: tuple[float, float] = C.SCOPE_RANGE) -> DataFrame:
    """All distinct units in scope, flagged and classified, with how far the rent lies above and below the band, and the
    band's width. Of units that agree in all keys, missing ones included, the first by position counts."""
    once = J.keep_first(in_scope(df, actual, *scope), keys, [position])
    flagged = flag_overpriced(once, actual, predicted, p75)
    return flagged.withColumns(
        {
            "category": price_category(F.col(actual), F.col(p25), F.col(p75), F.col(predicted)),
            "delta_above_p75": F.col(actual) - F.col(p75), "delta_below_p25": F.col(p25) - F.col(actual), "interval_width": F.col(p75) - F.col(p25),
        }
    )


def representative_cases(scored: DataFrame, categories: dict[str, list], zip_col: str = "zip_code", category: str = "category", total: int = 5, backup: dict[str, tuple] | None = None) -> DataFrame:
    """One row for each category in turn, each from a ZIP that isn't used yet, by the order given for it; then rows from
    ZIPs that no chosen row has, up to ``total``. A category without rows takes one from another by an order of its own,
    as ``backup`` (name: (other, order)) says, for example the one whose rent is closest to the band's upper end."""
    chosen = None
    for name, order in categories.items():
        pool = scored.where(F.col(category) == name)
        if backup and name in backup and pool.isEmpty():
            other, order = backup[name]
            pool = scored.where(F.col(category) == other)
        if chosen is not None:
            pool = pool.join(F.broadcast(chosen.select(zip_col)), zip_col, "left_anti")
        one = pool.orderBy(*order).limit(1).select(*scored.columns)
        chosen = one if chosen is None else chosen.unionByName(one)
    have = chosen.count()
    rest = scored.join(F.broadcast(chosen.select(zip_col)), zip_col, "left_anti").orderBy(*next(iter(categories.values()))).limit(max(0, total - have)).select(*scored.columns)
    return chosen.unionByName(rest).limit(total)


def train_select_audit(df: DataFrame, configs: list[dict], category: str, numerics: list[str], target: str, key: str, index: str, folds: int = 5) -> tuple[DataFrame, DataFrame]:
    """The whole training job: every configuration on every variant of the target, the index alone beside them, the best
    of them with its lift over the index; and the audit of the best one's features.

    The first table has a row per run: variant, name, mae_mean, mae_std, best, lift, low_lift. The second is (feature,
    gain, share) of a model of all rows of the best run's variant.
    """
    runs = []
    sets = variants(df, target)
    for name, rows in sets.items():
        runs.append(sweep(rows, configs, category, numerics, target, key, folds).select(F.lit(name).alias("variant"), "name", "mae_mean", "mae_std"))
        plain = baseline_cv(rows.withColumn("__fold", fold_of(F.col(key), folds)), index, target, "__fold")
        runs.append(plain.agg(F.avg("mae").alias("mae_mean"), F.stddev_pop("mae").alias("mae_std")).select(F.lit(name).alias("variant"), F.lit("index").alias("name"), "mae_mean", "mae_std"))
    every = reduce(DataFrame.unionByName, runs)
    # A row per run: variants times configurations.
    rows = [r.asDict() for r in every.collect()]
    best = min((r for r in rows if r["name"] != "index"), key=lambda r: (r["mae_mean"], r["mae_std"]))
    base = next(r for r in rows if r["name"] == "index" and r["variant"] == best["variant"])
    gain = lift(F.lit(best["mae_mean"]), F.lit(base["mae_mean"]))
    mine = (F.col("variant") == best["variant"]) & (F.col("name") == best["name"])
    table = df.sparkSession.createDataFrame([(r["variant"], r["name"], r["mae_mean"], r["mae_std"]) for r in rows], "variant string, name string, mae_mean double, mae_std double")
    report = table.select("*", mine.alias("best"), F.when(mine, gain[0]).alias("lift"), F.when(mine, gain[1]).alias("low_lift"))
    config = next(c for c in configs if str(c) == best["name"])
    data = A.fill_medians(model_input(sets[best["variant"]], category, numerics, target), numerics)
    gains = df.sparkSession.createDataFrame(importances(point_pipeline(category, numerics, **config).fit(data), numerics), "feature string, gain double")
    return report, A.importance_shares(gains, len(numerics) + 1)


def save_bundle(path: str, point: PipelineModel, band: LeafQuantiles | None = None, about: dict | None = None) -> None:
    """The point model, the band's forest and leaves, and a metadata document: what the band's quantiles are, and whatever
    is known of the training, such as its features, rows and metrics."""
    spark = SparkSession.active()
    point.write().overwrite().save(f"{path}/point")
    if band is not None:
        band.model.write().overwrite().save(f"{path}/forest")
        band.table.write.mode("overwrite").parquet(f"{path}/leaves")
    known = {"quantiles": band.quantiles if band is not None else None, "stages": [type(s).__name__ for s in point.stages], **(about or {})}
    spark.createDataFrame([(json.dumps(known),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_metadata(path: str) -> dict:
    return json.loads(SparkSession.active().read.text(f"{path}/metadata", wholetext=True).first()[0])


def load_point(path: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/point")


def load_bundle(path: str, spark: SparkSession, quantiles: list[float] | None = None) -> tuple[PipelineModel, LeafQuantiles | None]:
    """What ``save_bundle`` has saved: the point model and the band, if it has one."""
    quantiles = quantiles or load_metadata(path)["quantiles"]
    if quantiles is None:
        return load_point(path), None
    band = LeafQuantiles(quantiles)
    band.model = RandomForestRegressionModel.load(f"{path}/forest")
    band.table = spark.read.parquet(f"{path}/leaves")
    return load_point(path), band
