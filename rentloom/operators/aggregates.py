"""Aggregates, windows, profiles, audits, imputation and expectations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rentloom.functions import constants as C
from rentloom.functions import numbers as N
from rentloom.functions import text as X
from rentloom.operators import quantiles as Q

# Values that a quantile sketch holds at most on each of its levels.
SKETCH_K = 1000


def category_counts(df: DataFrame, keys: list[str], category: str, groups: dict[str, list[str]], total: str) -> DataFrame:
    """Rows by key: all, and those of each group of categories, and log1p of all. Null keys go."""
    flags = [F.count_if(N.member(category, v)).alias(k) for k, v in groups.items()]
    kept = df.dropna(subset=keys)
    return kept.groupBy(*keys).agg(F.count(F.lit(1)).alias(total), *flags).withColumn(f"{total}_log1p", F.log1p(F.col(total).cast("double")))


def means(df: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    return df.dropna(subset=keys).groupBy(*keys).agg(*[F.avg(m).alias(m) for m in measures])


def top_categories(df: DataFrame, key: str, category: str, n: int = 6) -> DataFrame:
    """(key, category, count, share, rank): the n most frequent categories of each key and their share of all."""
    counts = df.dropna(subset=[key]).groupBy(key, category).agg(F.count(F.lit(1)).alias("count"))
    whole = W.partitionBy(key)
    ranked = counts.withColumns({"share": F.col("count") / F.sum("count").over(whole), "rank": F.row_number().over(whole.orderBy(F.desc("count"), category))})
    return ranked.where(F.col("rank") <= n)


def rolling_means(df: DataFrame, key: str, order: str, measures: list[str], spans: list[int]) -> DataFrame:
    """Means of the last n rows of each key, of fewer at its beginning."""
    w = W.partitionBy(key).orderBy(order)
    return df.withColumns({f"{m}_{n}m": F.avg(m).over(w.rowsBetween(1 - n, 0)) for m in measures for n in spans})


def lag_difference(df: DataFrame, key: str, order: str, measure: str, n: int, name: str) -> DataFrame:
    return df.withColumn(name, F.col(measure) - F.lag(measure, n).over(W.partitionBy(key).orderBy(order)))


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def pearson(x: str, y: str) -> Column:
    """Correlation over rows where both are there; null where one is constant."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
    return F.try_divide(F.covar_samp(a, b), F.nullif(F.stddev_samp(a) * F.stddev_samp(b), F.lit(0.0)))


def null_rates(df: DataFrame) -> DataFrame:
    """(column_name, null_rate), in one pass."""
    one = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns])
    return one.unpivot([], df.columns, "column_name", "null_rate")


def distribution(df: DataFrame, c: str, exact: bool = True) -> DataFrame:
    """One row: n, mean, median, std, min, p10, p25, p75, p90, max. Quantiles are interpolated; for very large inputs
    ask for approximate ones."""
    points = [0.1, 0.25, 0.5, 0.75, 0.9]
    one = df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"), *([] if exact else [F.percentile_approx(c, points, 10_000).alias("q")]))
    if exact:
        one = one.crossJoin(F.broadcast(Q.exact_quantiles(df, c, points)))
    return one.select("n", "mean", "std", "min", "max", *[F.col("q")[k].alias(name) for k, name in enumerate(("p10", "p25", "median", "p75", "p90"))])


def sketch_states(df: DataFrame, by: list[Column], value: str, k: int = SKETCH_K) -> DataFrame:
    """(by, n, low, high, sketch): the state of each key's values, from which any number of keys' quantiles follow. States
    of the same key, of later rows for example, may be kept beside each other: they add up when merged."""
    v = F.col(value).cast("double")
    kept = df.where(v.isNotNull() & ~F.isnan(v))
    return kept.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch"))


def merged_quantiles(states: DataFrame, points: list[float], by: list[str] | None = None, k: int = SKETCH_K) -> DataFrame:
    """(by, n, low, high, q): quantiles from states, without the rows. The rank of each is off by no more than about
    ``sketch_error(k)`` of all rows, in 99 of 100 cases; least and greatest are exact."""
    merged = states.groupBy(*(by or [])).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))
    return merged.select(*(by or []), "n", "low", "high", F.array(*[F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))) for p in points]).alias("q"))


def sketch_error(k: int = SKETCH_K) -> float:
    """The published rank error of such a sketch, as a share of all rows."""
    return 2.296 / k**0.9723


def correlations(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """(feature, pearson): all in one pass."""
    one = df.agg(*[pearson(c, target).alias(c) for c in columns])
    return one.unpivot([], columns, "feature", "pearson").where("pearson IS NOT NULL")


def spearman(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """(feature, spearman) with mean ranks for ties. Ranks come from counts per value, added up range by range."""
    out = []
    for c in columns:
        both = df.where(F.col(c).isNotNull() & F.col(target).isNotNull()).select(F.col(c).cast("double").alias("x"), F.col(target).cast("double").alias("y"))
        for v in ("x", "y"):
            both = both.join(Q.mean_ranks(both, v).select(F.col("v").alias(v), F.col("rank").alias(f"r{v}")), v)
        out.append(both.agg(pearson("rx", "ry").alias("spearman")).select(F.lit(c).alias("feature"), "spearman"))
    return reduce(DataFrame.unionByName, out)


def strongest(correlated: DataFrame, n: int = 10) -> DataFrame:
    return correlated.orderBy(F.desc(F.abs("pearson")), "feature").limit(n)


def near_deterministic(correlated: DataFrame, threshold: float = 0.95) -> DataFrame:
    return correlated.where(F.abs("pearson") >= threshold)


def importance_shares(importances: DataFrame, n: int = 10) -> DataFrame:
    """(feature, gain) with the share of all gain; one row per feature, so a total over all is small."""
    total = importances.agg(F.sum("gain").alias("__t"))
    return importances.crossJoin(F.broadcast(total)).withColumn("share", F.coalesce(F.try_divide("gain", "__t"), F.lit(0.0))).drop("__t").orderBy(F.desc("share"), "feature").limit(n)


def fold_stability(gains: DataFrame, folds: int, n: int = 10) -> DataFrame:
    """(feature, mean, std, cv) over folds; a fold without a feature counts as 0."""
    s, sq = F.sum("gain"), F.sum(F.col("gain") * F.col("gain"))
    mean = s / folds
    out = gains.groupBy("feature").agg(mean.alias("mean"), F.sqrt(F.greatest(sq / folds - mean * mean, F.lit(0.0))).alias("std"))
    return out.withColumn("cv", F.try_divide("std", F.nullif("mean", F.lit(0.0)))).orderBy(F.desc("mean"), "feature").limit(n)


def audit_warnings(deterministic: DataFrame, shares: DataFrame, stability: DataFrame) -> DataFrame:
    """(warning, n) where there is something to warn of."""
    parts = [
        deterministic.agg(F.count(F.lit(1)).alias("n")).select(F.lit("near_deterministic").alias("warning"), "n"),
        shares.where("share >= 0.5").agg(F.count(F.lit(1)).alias("n")).select(F.lit("dominant_feature").alias("warning"), "n"),
        stability.where("cv > 1.0").agg(F.count(F.lit(1)).alias("n")).select(F.lit("unstable_feature").alias("warning"), "n"),
    ]
    return reduce(DataFrame.unionByName, parts).where("n > 0")


def regression_metrics(df: DataFrame, actual: str, predicted: str, fold: str) -> DataFrame:
    """(fold, n, mae, mape, r2)."""
    e = F.col(actual) - F.col(predicted)
    y = F.col(actual)
    one = df.groupBy(fold).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(2.220446049250313e-16))).alias("mape"),
        F.sum(e * e).alias("__sse"),
        F.var_pop(y).alias("__var"),
    )
    return one.withColumn("r2", 1 - F.try_divide("__sse", F.nullif(F.col("__var") * F.col("n"), F.lit(0.0)))).drop("__sse", "__var")


def fold_summary(metrics: DataFrame, names: list[str]) -> DataFrame:
    """(metric, mean, std, half_width, min, max) over folds."""
    long = metrics.unpivot([], names, "metric", "v")
    half = F.when(F.count("v") > 1, 1.96 * F.stddev_samp("v") / F.sqrt(F.count("v"))).otherwise(0.0)
    return long.groupBy("metric").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), half.alias("half_width"), F.min("v").alias("min"), F.max("v").alias("max"))


def interval_coverage(df: DataFrame, actual: str, low: str, high: str) -> DataFrame:
    return df.agg(F.avg(F.col(actual).between(F.col(low), F.col(high)).cast("double")).alias("coverage"), F.avg(F.greatest(F.col(high) - F.col(low), F.lit(0.0))).alias("width"))


class Counters:
    """Counts of what passes the steps of a job, that come with the job itself. A pipeline marks its steps with ``watch``;
    once what it gives has been written or collected, ``rows`` has all counts of that one run."""

    def __init__(self) -> None:
        self._seen: dict[str, Observation] = {}

    def watch(self, df: DataFrame, step: str, **counters: Column) -> DataFrame:
        """The frame; its rows are counted, and those for which each condition holds."""
        if step in self._seen:
            raise ValueError(f"step {step} is watched already")
        self._seen[step] = Observation()
        return df.observe(self._seen[step], F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(k) for k, c in counters.items()])

    def counts(self) -> dict[str, dict[str, int]]:
        """By step and counter; waits for the run."""
        return {step: dict(seen.get) for step, seen in self._seen.items()}

    def rows(self, spark: SparkSession) -> DataFrame:
        """(step, counter, n)."""
        found = [(step, counter, int(n)) for step, of in self.counts().items() for counter, n in of.items()]
        return spark.createDataFrame(found, "step string, counter string, n long")


def watched(df: DataFrame, counters: Counters | None, step: str, **conditions: Column) -> DataFrame:
    """As ``Counters.watch`` where there are counters, else the frame as it is."""
    return df if counters is None else counters.watch(df, step, **conditions)


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"with_{c}") for c in columns])


def profile(df: DataFrame) -> DataFrame:
    return df.summary()


def impute_scores(df: DataFrame, kinds: list[str], key: str = "zip_code") -> DataFrame:
    """<kind>_score: its ZIP's mean where missing, then the mean of the column so filled, half to even; labels follow."""
    known = df.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.avg(f"{k}_score").alias(f"__{k}") for k in kinds])
    filled = df.join(known, key, "left").withColumns({f"{k}_score": F.coalesce(f"{k}_score", f"__{k}") for k in kinds}).drop(*[f"__{k}" for k in kinds])
    overall = filled.agg(*[F.avg(f"{k}_score").alias(f"__{k}") for k in kinds])
    out = filled.crossJoin(F.broadcast(overall)).withColumns({f"{k}_score": F.bround(F.coalesce(f"{k}_score", f"__{k}")) for k in kinds}).drop(*[f"__{k}" for k in kinds])
    return out.withColumns({f"{k}_description": F.coalesce(f"{k}_description", X.score_label(f"{k}_score", k)) if f"{k}_description" in df.columns else X.score_label(f"{k}_score", k) for k in kinds})


def require_complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fails if any of the columns has a null."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    bad = {c: row[c] for c in columns if row[c]}
    if bad:
        raise ValueError(f"nulls: {bad}")
    return df


def expectations(df: DataFrame, rules: dict[str, Column], unique: list[str] | None = None, soft: list[str] = ()) -> DataFrame:
    """(rule, severity, failures) of row rules, all in one pass, and of a unique key. A null result fails a rule."""
    one = df.agg(*[F.count_if(~F.coalesce(r, F.lit(False))).alias(n) for n, r in rules.items()])
    out = one.unpivot([], list(rules), "rule", "failures")
    if unique:
        twice = df.groupBy(*unique).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        out = out.unionByName(twice.agg(F.count(F.lit(1)).alias("failures")).select(F.lit("unique").alias("rule"), "failures"))
    return out.withColumn("severity", F.when(F.col("rule").isin(list(soft)), "soft").otherwise("hard"))


def check_listings(df: DataFrame) -> DataFrame:
    """(rule, failures, severity) of a table of cleaned unit listings: its rows' rules, its header and that it has rows."""
    header = F.lit(0 if df.columns == C.UNIT_COLUMNS else 1).cast("long")
    complete = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in C.UNIT_COLUMNS])
    rules = expectations(complete, listing_rules(), soft=["address_has_zip", "title_not_price"])
    empty = df.agg(F.count_if(F.lit(True)).alias("n")).select(F.lit("not_empty").alias("rule"), (F.col("n") == 0).cast("long").alias("failures"), F.lit("hard").alias("severity"))
    return rules.unionByName(empty).unionByName(empty.select(F.lit("exact_header").alias("rule"), header.alias("failures"), "severity"))


def listing_rules() -> dict[str, Column]:
    """What a row of cleaned unit listings has to satisfy; the last two are wishes."""
    c = F.col
    present = reduce(lambda a, b: a & b, [c(x).isNotNull() for x in C.UNIT_COLUMNS])
    return {
        "no_missing_cell": present,
        "url_shape": c("url").rlike("^https?://[^ ]+/[^ ]+"),
        "price_has_dollar": c("pricing").contains("$"),
        "price_format": c("pricing").rlike(r"^\$[\d,]+\+?$"),
        "unit_label": c("beds_baths").rlike(r"(?i)^(Studio|\d+ Beds?\+?)$"),
        "scraped_at_format": c("scraped_at").rlike(r"^\d{4}-\d{2}-\d{2}"),
        "zip_digits": c("zip_code").rlike(r"^\d{5}$"),
        "title_present": F.trim("title") != "",
        "address_present": F.trim("address") != "",
        "address_has_zip": c("address").rlike(r",\s*CA\s+9\d{4}"),
        "title_not_price": ~F.trim("title").rlike(r"^\$[\d,]+\+?$"),
    }


def fill_medians(df: DataFrame, columns: list[str], by: DataFrame | None = None) -> DataFrame:
    """Nulls as the exact median of a column (of ``by``, the training rows, if given)."""
    known = df if by is None else by
    return df.crossJoin(F.broadcast(medians(known, columns))).withColumns({c: F.coalesce(c, f"__{c}") for c in columns}).drop(*[f"__{c}" for c in columns])


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the exact median of each column c as __c, all from one selection."""
    each = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x"))
    found = Q.exact_quantiles(each.select("x.name", "x.v"), "v", [0.5], ["name"])
    return found.agg(*[F.max(F.when(F.col("name") == c, F.col("q")[0])).alias(f"__{c}") for c in columns])


def distinct_keys(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n_distinct): different values of each column that aren't null."""
    one = df.agg(*[F.count_distinct(c).alias(c) for c in columns])
    return one.unpivot([], columns, "column_name", "n_distinct")


VIOLENCE = {"crime_violent_month_zip": C.VIOLENT, "crime_property_month_zip": C.PROPERTY}
