"""Feature matrices: the extractors' rows joined by series, filled and assembled; models and cross-validation on them."""

from __future__ import annotations

import random
import threading
from collections.abc import Callable, Iterable
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import UnivariateFeatureSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riftline.functions import special
from riftline.functions.moments import over
from riftline.operators import datasets, distribution, embedding, evaluation, evidence, lagged, likelihood, profiles, ranges, regression, shape
from riftline.sources.checkpoints import cut

EXTRACTORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "descriptive": distribution.descriptive,
    "distances": distribution.ecdf_distances,
    "chow": lambda s: lagged.chow(s, lagged.first_lags(2)).select("series_id", "chow_f", "chow_p", "coef_distance"),
    "cusum": lambda s: lagged.cusum(s, lagged.first_lags(2)).drop("n", "k"),
    "diagnostics": lambda s: lagged.diagnostics(s, lagged.first_lags(2)).drop("n"),
    "residuals": lambda s: distribution.ecdf_distances(lagged.period_residuals(s, lagged.first_lags(5))).drop("n0", "n1"),
    "cost": shape.changepoint_cost,
    "volatility": shape.volatility,
    "acf": shape.autocorrelation_distance,
    "acf_period": lambda s: by_period(shape.autocorrelation_summary(s)),
    "pacf": lambda s: lagged.partial_summary(s, 30),
    "likelihood": likelihood.likelihood_ratio,
    "rolling": shape.rolling_boundary,
    "rolling_spread": profiles.rolling_spread_boundary,
    "bands": embedding.band_energies,
    "entropy": shape.permutation_entropy,
    "regularity": embedding.approximate_entropy,
    "factors": embedding.factors,
    "factor_regression": embedding.factor_regression,
    "factor_scan": embedding.factor_scan,
    "characteristics": shape.break_characteristics,
    "reversion": shape.spread_reversion,
    "evidence": evidence.evidence,
    "models": evidence.segment_models,
}


def by_period(rows: DataFrame) -> DataFrame:
    """The columns of both periods side by side, one row a series."""
    columns = [c for c in rows.columns if c not in ("series_id", "period")]
    return rows.groupBy("series_id").agg(*[F.max(F.when(F.col("period") == p, F.col(c))).alias(f"{c}_{p}") for p in (0, 1) for c in columns])


def feature_matrix(series: DataFrame, names: tuple[str, ...] = tuple(EXTRACTORS)) -> DataFrame:
    """All extractors' columns by series; a column's name is prefixed by its extractor's.

    Series are dealt by id once, and grouping, windows and joins on the id keep that layout.
    """
    dealt = cut(series.repartition("series_id"))

    def named(name: str) -> DataFrame:
        f = EXTRACTORS[name](dealt)
        return f.select("series_id", *[F.col(c).cast("double").alias(f"{name}_{c}") for c in f.columns if c != "series_id"])

    return reduce(lambda a, b: a.join(b, "series_id", "full"), map(named, names))


def feature_columns(matrix: DataFrame) -> list[str]:
    return [c for c in matrix.columns if c not in ("series_id", "label", "fold", "weight")]


def filled(matrix: DataFrame, by: str = "median") -> DataFrame:
    """Nulls and non-finite values replaced by the column's median, mean or 0 (0 where a column has no value)."""
    matrix, names = cut(matrix), feature_columns(matrix)
    finite = {c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c)) for c in names}
    if by == "median":
        known = matrix.select([finite[c].alias(c) for c in names])
        found = known.agg(F.count("*").alias("all"))
        values = ranges.with_quantiles(found, known, {f"_{c}": (c, 0.5) for c in names})
        values = values.select(*[F.coalesce(f"_{c}", F.lit(0.0)).alias(f"_{c}") for c in names])
    else:
        rule = {"mean": F.avg, "zero": lambda c: F.lit(0.0)}[by]
        values = matrix.agg(*[F.coalesce(rule(finite[c]), F.lit(0.0)).alias(f"_{c}") for c in names])
    rest = [c for c in matrix.columns if c not in names]
    return matrix.join(F.broadcast(values)).select(*rest, *[F.coalesce(finite[c], F.col(f"_{c}")).alias(c) for c in names])


def rejected(series: DataFrame, matrix: DataFrame) -> DataFrame:
    """Series without a row in the matrix."""
    return series.select("series_id").distinct().join(matrix.select("series_id"), "series_id", "left_anti")


CLASSIFIERS = {
    "gbt": lambda **k: GBTClassifier(labelCol="label", featuresCol="vector", maxIter=k.get("rounds", 20), maxDepth=k.get("depth", 3), stepSize=0.1, seed=42),
    "forest": lambda **k: RandomForestClassifier(labelCol="label", featuresCol="vector", numTrees=k.get("trees", 50), maxDepth=k.get("depth", 5), seed=42),
    # class weights make both classes count alike
    "tuned": lambda **k: GBTClassifier(labelCol="label", featuresCol="vector", weightCol="weight", seed=42, featureSubsetStrategy=str(k.get("featureShare", 1.0)), **{n: v for n, v in k.items() if n != "featureShare"}),
    "tree": lambda **k: DecisionTreeClassifier(labelCol="label", featuresCol="vector", weightCol="weight", maxDepth=k.get("depth", 5), seed=42),
    "bayes": lambda **k: NaiveBayes(labelCol="label", featuresCol="vector", weightCol="weight", modelType="gaussian"),
    "logistic": lambda **k: LogisticRegression(labelCol="label", featuresCol="vector", maxIter=100, regParam=0.01),
}


def fit(matrix: DataFrame, kind: str = "gbt", **parameters):
    """A fitted pipeline on a filled matrix with label; its model can be written and read by Spark's own means."""
    classifier = CLASSIFIERS[kind](**parameters)
    rows = weighted(matrix) if classifier.hasParam("weightCol") and classifier.isDefined("weightCol") else matrix
    return Pipeline(stages=[VectorAssembler(inputCols=feature_columns(matrix), outputCol="vector"), classifier]).fit(rows)


def weighted(matrix: DataFrame) -> DataFrame:
    """Adds weight, with which both classes have half the sum of weights; one row of counts is broadcast."""
    sizes = matrix.agg(F.count("*").alias("_n"), F.count(F.when(F.col("label") == 1, 1)).alias("_p"))
    own = F.when(F.col("label") == 1, F.col("_p")).otherwise(F.col("_n") - F.col("_p"))
    return matrix.join(F.broadcast(sizes)).withColumn("weight", F.col("_n") / (2.0 * own)).drop("_n", "_p")


def predict(model, matrix: DataFrame) -> DataFrame:
    """series_id, label where known, and score between 0 and 1."""
    score = F.greatest(F.least(vector_to_array("probability")[1], F.lit(1.0)), F.lit(0.0))
    kept = [c for c in ("series_id", "label", "fold") if c in matrix.columns]
    return model.transform(matrix).select(*kept, score.alias("score"))


def labelled(series: DataFrame, names: tuple[str, ...] = tuple(EXTRACTORS)) -> DataFrame:
    labels = datasets.labels_of(series).select("series_id", F.col("has_break").cast("double").alias("label"))
    return filled(feature_matrix(series, names).join(labels, "series_id"))


#: Models that learn at once: each is a chain of short jobs, which alone leave most cores idle, and holds its rows in memory.
LEARNERS = 5
_learning = threading.BoundedSemaphore(LEARNERS)


def together(spark: SparkSession, run: Callable, items: Iterable) -> list:
    """Results of ``run`` for each item, in their order; up to LEARNERS items have their jobs at the same time."""
    tasks = [inheritable_thread_target(spark)(partial(run, x)) for x in items]
    with ThreadPool(max(1, min(len(tasks), LEARNERS))) as pool:
        return pool.map(lambda task: task(), tasks, chunksize=1)


def in_folds(matrix: DataFrame, k: int) -> DataFrame:
    """A matrix with each series' fold, in as many partitions as its size asks for: each step of a model is a job over all of them."""
    folds = datasets.stratified_folds(matrix.select("series_id", (F.col("label") == 1).alias("has_break")), k).select("series_id", "fold")
    return cut(matrix.join(folds, "series_id"))


def scored(m: DataFrame, k: int, kind: str, **parameters) -> DataFrame:
    """Scores of each series of a matrix in folds by a model of the other folds; the folds' models learn together."""

    def by_others(f: int) -> DataFrame:
        with _learning:
            model = fit(m.where(F.col("fold") != f).drop("fold"), kind, **parameters)
        return predict(model, m.where(F.col("fold") == f))

    return cut(reduce(DataFrame.unionByName, together(m.sparkSession, by_others, range(k))))


def out_of_folds(matrix: DataFrame, k: int, kinds: tuple[str, ...], **parameters) -> list[DataFrame]:
    """For each kind, scores of each series by a model of the other folds; matrix and folds are made once for all."""
    m = in_folds(cut(matrix) if len(kinds) > 1 else matrix, k)
    return together(m.sparkSession, lambda kind: scored(m, k, kind, **parameters), kinds)


def out_of_fold(matrix: DataFrame, k: int = 3, kind: str = "gbt", **parameters) -> DataFrame:
    """Scores of each series by a model of the other folds."""
    return out_of_folds(matrix, k, (kind,), **parameters)[0]


def fold_gaps(matrix: DataFrame, k: int = 3, kind: str = "forest", **parameters) -> DataFrame:
    """AUC by fold on the rows that a model has learnt from and on the others, and the gap between the two."""
    folds = datasets.stratified_folds(matrix.select("series_id", (F.col("label") == 1).alias("has_break")), k).select("series_id", "fold")
    m = cut(matrix.join(folds, "series_id"))
    parts = []
    for f in range(k):
        model = fit(m.where(F.col("fold") != f).drop("fold"), kind, **parameters)
        train, held = (evaluation.auc(predict(model, m.where(c))).withColumnRenamed("auc", n) for n, c in (("train_auc", F.col("fold") != f), ("held_auc", F.col("fold") == f)))
        parts.append(train.join(F.broadcast(held)).select(F.lit(f).cast("long").alias("fold"), "train_auc", "held_auc", (F.col("train_auc") - F.col("held_auc")).alias("gap")))  # one row each
    return reduce(DataFrame.unionByName, parts)


def fold_auc(scores: DataFrame, k: int) -> DataFrame:
    """AUC by fold."""
    return reduce(DataFrame.unionByName, [evaluation.auc(scores.where(F.col("fold") == f)).withColumn("fold", F.lit(f).cast("long")) for f in range(k)])


def vote(parts: list[DataFrame]) -> DataFrame:
    """Mean of several models' scores."""
    return reduce(DataFrame.unionByName, parts).groupBy("series_id").agg(F.max("label").alias("label"), F.avg("score").alias("score"))


def importances(model, matrix: DataFrame, n: int = 20) -> list[tuple[str, float]]:
    """The n most important features of a fitted tree model."""
    return sorted(zip(feature_columns(matrix), model.stages[-1].featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))[:n]


def stacked(matrix: DataFrame, kinds: tuple[str, ...] = ("forest", "logistic"), k: int = 3) -> DataFrame:
    """Out-of-fold scores of a logistic model whose features are the out-of-fold scores of ``kinds``."""
    held = in_folds(matrix, k)
    base = held.select("series_id", "label", "fold")
    for kind, scores in zip(kinds, together(held.sparkSession, lambda kind: scored(held, k, kind), kinds), strict=True):
        base = base.join(scores.select("series_id", F.col("score").alias(kind)), "series_id")
    return scored(cut(base), k, "logistic")


def calibrated(scores: DataFrame, k: int = 3) -> DataFrame:
    """Scores with folds, each made a probability by an isotonic regression on the other folds."""
    held = cut(scores)
    parts = []
    for f in range(k):
        model = IsotonicRegression(featuresCol="score", labelCol="label").fit(held.where(F.col("fold") != f))
        parts.append(model.transform(held.where(F.col("fold") == f)).select("series_id", "label", "fold", F.col("prediction").alias("score")))
    return reduce(DataFrame.unionByName, parts)


def selected(matrix: DataFrame, how: str = "tree", n: int = 10) -> list[str]:
    """Names of features: tree (importance at least the median), l1 (weights that aren't 0) or univariate (the n best by F test)."""
    names = feature_columns(matrix)
    if how == "tree":
        ranked = importances(fit(matrix, "forest"), matrix, len(names))
        middle = sorted(x for _, x in ranked)[len(ranked) // 2]
        return [c for c, x in ranked if x >= middle and x > 0]
    vectors = VectorAssembler(inputCols=names, outputCol="vector").transform(matrix)
    if how == "l1":
        weights = LogisticRegression(labelCol="label", featuresCol="vector", regParam=0.02, elasticNetParam=1.0).fit(vectors).coefficients.toArray()
        return [c for c, w in zip(names, weights, strict=True) if w != 0]
    chooser = UnivariateFeatureSelector(labelCol="label", featuresCol="vector", outputCol="best", selectionMode="numTopFeatures")
    return [names[i] for i in chooser.setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(n).fit(vectors).selectedFeatures]


def random_search(matrix: DataFrame, tries: int = 3, k: int = 2, seed: int = 42) -> DataFrame:
    """depth, rounds and AUC over all folds of boosted trees with parameters drawn by a seeded generator."""
    draw, held = random.Random(seed), in_folds(matrix, k)
    drawn = [(draw.randint(2, 5), draw.randint(5, 30)) for _ in range(tries)]
    scores = together(held.sparkSession, lambda p: scored(held, k, "gbt", depth=p[0], rounds=p[1]), drawn)
    parts = [evaluation.auc(s).select(F.lit(d).cast("long").alias("depth"), F.lit(r).cast("long").alias("rounds"), "auc") for (d, r), s in zip(drawn, scores, strict=True)]
    return reduce(DataFrame.unionByName, parts)


def at_least(gains: DataFrame, name: str) -> DataFrame:
    """name, above: for each distinct value, how many series without a break (label 0) reach it.

    Equal values are counted before anything is ordered, and counts are accumulated by ranges of values.
    """
    each = gains.where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.when(F.col("label") == 0, 1)).alias("n"))
    return ranges.running(each, name, ["n"], descending=True).select(name, F.col("run_n").alias("above"))


#: Rows up to which a table of counts is broadcast, and shares of equal gains beyond.
BROADCAST_ROWS, SALTS = 500_000, 16


def looked_up(rows: DataFrame, counts: DataFrame, name: str) -> DataFrame:
    """Joins a table of distinct values; rows of equal or null value don't have to meet in one task."""
    counts = cut(counts)
    if counts.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(counts), name, "left")
    salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = F.pmod(F.xxhash64("series_id"), F.lit(SALTS)).cast("int")
    return rows.withColumn("salt", own).join(salted, [name, "salt"], "left").drop("salt")


def null_tests(gains: DataFrame, names: list[str], least: int = 20) -> DataFrame:
    """Where each series' gains lie among those of all series without a break (label 0), by learner and combined.

    With fewer than ``least`` of them the results are null.
    """
    null = F.col("label") == 0
    sums = gains.agg(*[f(F.when(null, F.col(c))).alias(f"{c}_{n}") for c in names for n, f in (("size", F.count), ("mean", F.avg), ("std", F.stddev_samp))])
    x = gains.join(F.broadcast(sums))
    for c in names:
        x = looked_up(x, at_least(gains, c).withColumnRenamed("above", f"{c}_above"), c)
    out = []
    for c in names:
        size = F.col(f"{c}_size")
        share = F.col(f"{c}_above") / size
        known = (size >= least) & F.col(c).isNotNull()
        out += [F.when(known, F.greatest(share, 1 / (size + 1))).alias(f"{c}_p"), F.when(known, over(F.col(c) - F.col(f"{c}_mean"), F.col(f"{c}_std"))).alias(f"{c}_effect"), F.when(known, 1 - share).alias(f"{c}_rank")]
    tested = x.select("series_id", *out)
    fisher = -2 * sum((F.log(f"{c}_p") for c in names), F.lit(0.0))
    smallest = F.array_min(F.array(*[F.col(f"{c}_p") for c in names]))
    bonferroni = F.when(smallest.isNotNull(), F.least(F.lit(1.0), len(names) * smallest))
    return tested.select("*", special.chi2_p(fisher, F.lit(2.0 * len(names))).alias("fisher_p"), bonferroni.alias("bonferroni_p"))


def direction_scores(series: DataFrame, lags: int = 5) -> DataFrame:
    """Chance that a value is above its series' first-period median, from the values before it.

    One logistic model for all series learns on first periods and scores second ones.
    """
    order = regression.ordered()
    middle = series.groupBy("series_id").agg(F.percentile(F.when(F.col("period") == 0, F.col("value")), F.lit(0.5)).alias("m"))
    rows = series.join(middle, "series_id").select("series_id", "t", "period", (F.col("value") > F.col("m")).cast("double").alias("label"), *[(F.lag("value", j).over(order) - F.col("m")).alias(f"lag{j}") for j in range(1, lags + 1)]).na.drop()
    names = [f"lag{j}" for j in range(1, lags + 1)]
    vectors = VectorAssembler(inputCols=names, outputCol="vector").transform(rows)
    model = LogisticRegression(labelCol="label", featuresCol="vector", maxIter=50, regParam=0.001).fit(vectors.where("period = 0"))
    return model.transform(vectors.where("period = 1")).select("series_id", "t", "label", vector_to_array("probability")[1].alias("score"))


# --- null distributions kept between runs ---------------------------------------------------------------------------
def save_nulls(gains: DataFrame, names: list[str], path: str) -> None:
    """For each learner the gains of all series without a break (label 0): how many reach each distinct value, by range of values, and their moments."""
    parts = []
    for c in names:
        x = gains.where((F.col("label") == 0) & F.col(c).isNotNull())
        each = x.groupBy(F.col(c).alias("gain")).agg(F.count("*").alias("n"))
        parts.append(ranges.running(each, "gain", ["n"], descending=True).select(F.lit(c).alias("learner"), "gain", F.col("run_n").alias("above")))
    reduce(DataFrame.unionByName, parts).write.mode("overwrite").partitionBy("learner").parquet(f"{path}/counts")
    null = F.col("label") == 0
    rows = [gains.agg(*[f(F.when(null, F.col(c))).alias(n) for n, f in (("size", F.count), ("mean", F.avg), ("std", F.stddev_samp))]).withColumn("learner", F.lit(c)) for c in names]
    reduce(DataFrame.unionByName, rows).write.mode("overwrite").parquet(f"{path}/moments")


def as_of(gains: DataFrame, name: str, counts: DataFrame) -> DataFrame:
    """name, above: for each distinct gain, the count stored with the least value that is not below it, 0 beyond all.

    Gains and stored values run down together within ranges of values; what a range has no stored value for comes from the
    nearest one above it, of which there is one for each range.
    """
    asked = gains.where(F.col(name).isNotNull()).select(F.col(name).alias("v")).distinct()
    both = counts.select(F.col("gain").alias("v"), F.col("above").alias("n")).unionByName(asked.select("v", F.lit(None).cast("long").alias("n")))
    shares = F.array(*[F.lit(k / ranges.RANGES) for k in range(1, ranges.RANGES)])
    cuts = sorted(set(both.agg(F.percentile_approx("v", shares, F.lit(100 * ranges.RANGES))).first()[0] or []))
    both = both.withColumn("place", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("v"))) if cuts else F.lit(0))
    least = both.where("n IS NOT NULL").groupBy("place").agg(F.max("n").alias("most"))  # the count at the range's least stored value
    higher = both.select("place").distinct().withColumnRenamed("place", "low").join(F.broadcast(least), F.col("place") > F.col("low"), "left")
    beyond = higher.groupBy("low").agg(F.coalesce(F.max("most"), F.lit(0)).alias("beyond")).withColumnRenamed("low", "place")
    down = Window.partitionBy("place").orderBy(F.desc("v"), F.asc_nulls_last("n")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled_ = both.withColumn("seen", F.last("n", ignorenulls=True).over(down)).where("n IS NULL").join(F.broadcast(beyond), "place")
    return filled_.select(F.col("v").alias(name), F.coalesce("seen", "beyond").alias("above"))


def stored_null_tests(gains: DataFrame, names: list[str], path: str, least: int = 20) -> DataFrame:
    """``null_tests`` against a store instead of the table itself: p, effect and rank by learner."""
    spark = gains.sparkSession
    moments = {r["learner"]: r for r in spark.read.parquet(f"{path}/moments").collect()}  # a row for each learner
    counts = spark.read.parquet(f"{path}/counts")
    x, out = gains, []
    for c in names:
        x = looked_up(x, as_of(gains, c, counts.where(F.col("learner") == c)).withColumnRenamed("above", f"{c}_above"), c)
        m = moments[c]
        known = F.col(c).isNotNull() & F.lit(m["size"] >= least)
        share = F.col(f"{c}_above") / F.lit(float(m["size"] or 1))
        out += [F.when(known, F.greatest(share, F.lit(1 / (m["size"] + 1)))).alias(f"{c}_p"), F.when(known, over(F.col(c) - F.lit(m["mean"]), F.lit(m["std"]))).alias(f"{c}_effect"), F.when(known, 1 - share).alias(f"{c}_rank")]
    return x.select("series_id", *out)
