"""Queries that SQL can't express: p-values, grouped numerics, models and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riftline.functions import special
from riftline.functions.moments import rounded
from riftline.functions.moments import over
from riftline.operators import datasets, distribution, evaluation, grouped, lagged, normality, regression, synthetic
from riftline.plans import features, selection
from riftline.plans.series_queries import planted
from riftline.sources.checkpoints import cut, shared_folder
from riftline.sources.series import type_series, user_series
from riftline.streaming.scorer import score_stream


def p_values(series: DataFrame) -> DataFrame:
    """P-values of the two-sample tests, Chow's test and the CUSUM tests of each series, whose rows are numbered and dealt once."""
    series = cut(series.repartition("series_id"))
    t = distribution.student_t(series).select("series_id", special.student_p("t", "df").alias("t_p"))
    w = distribution.welch_t(series).select("series_id", special.student_p("t", "df").alias("welch_p"))
    levene = distribution.levene(series).join(distribution.counts(series).select("series_id", (F.col("n0") + F.col("n1") - 2).cast("double").alias("d2")), "series_id")
    levene = levene.select("series_id", special.f_p("w", F.lit(1.0), "d2").alias("levene_p"))
    u = distribution.mann_whitney(series).select("series_id", special.normal_p("z").alias("u_p"))
    ks = distribution.ecdf_distances(series).select("series_id", special.ks_p("ks", F.col("n0").cast("double"), F.col("n1").cast("double")).alias("ks_p"))
    chow = regression.chow(series).select("series_id", special.f_p("chow_f", F.lit(2.0), "df2").alias("chow_p"))
    cusum = regression.cusum(series).select("series_id", special.normal_p("cusum_t").alias("cusum_p"), special.normal_p("cusumsq_z").alias("cusumsq_p"))
    sizes = distribution.counts(series).select("series_id", *[F.col(f"n{p}").cast("double").alias(f"n{p}") for p in (0, 1)])
    cvm = distribution.cramer_von_mises(series).join(sizes, "series_id").select("series_id", special.cvm_p("cvm", "n0", "n1").alias("cvm_p"))
    jb = regression.jarque_bera(series).select("series_id", special.chi2_p("jb", F.lit(2.0)).alias("jarque_bera_p"))
    out = t
    for part in (w, levene, u, ks, cvm, chow, cusum, jb):
        out = out.join(part, "series_id")
    return out


def model_free_scores(series: DataFrame) -> DataFrame:
    """1 - p of the t test as a score, a half where there is none."""
    t = distribution.student_t(series).select("series_id", special.student_p("t", "df").alias("p"))
    return t.select("series_id", F.coalesce(1 - F.col("p"), F.lit(0.5)).alias("score"))


def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model-free scores of the users' series by way of a stream of files."""
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4()}"
    user_series(spark, sf_dir).repartition(4, "series_id").write.parquet(f"{place}/in")
    query = score_stream(spark, f"{place}/in", "series_id long, t long, value double, period int", f"{place}/out", f"{place}/state", model_free_scores)
    query.awaitTermination()
    return spark.read.parquet(f"{place}/out").select("series_id", "score")


def _grouped(source, function, names):
    return lambda spark, sf_dir: rounded(grouped.per_series(source(spark, sf_dir), function, names))


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of all extractors."""
    return features.labelled(planted(spark, sf_dir))


def cross_validated(kind: str, k: int = 3):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return features.fold_auc(features.out_of_fold(_matrix(spark, sf_dir), k, kind), k)

    return run


def null_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = planted(spark, sf_dir)
    labels = datasets.labels_of(series).select("series_id", F.col("has_break").cast("int").alias("label"))
    gains = grouped.per_series(series, lambda before, after: grouped.segment_gains(before, after, 2), grouped.SEGMENT_GAINS)
    return rounded(features.null_tests(cut(gains.join(labels, "series_id")), grouped.SEGMENT_GAINS))


def chosen_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = cut(_matrix(spark, sf_dir))
    rows = [(how, c) for how in ("tree", "l1", "univariate") for c in features.selected(matrix, how)]
    rows += [("information", c) for c in selection.best_by_information(matrix)]
    return spark.createDataFrame(rows, "how string, feature string")


def augmented_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths, boundaries and means of changed copies of the users' series, one of each kind."""
    parts = [datasets.augmented(user_series(spark, sf_dir), kind, k) for k, kind in enumerate(("shift", "subsample", "noise"))]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rounded(whole.groupBy("series_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("period") == 0, 1)).alias("boundary"), F.avg("value").alias("mean")))


def null_store_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-values of the planted series' gains against a store made of the users' series as they are."""
    place = f"{shared_folder(spark)}/nulls-{uuid.uuid4()}"
    gains = lambda s: cut(_gains(s))
    features.save_nulls(gains(user_series(spark, sf_dir)).withColumn("label", F.lit(0)), GAINS, place)
    return rounded(features.stored_null_tests(gains(planted(spark, sf_dir)), GAINS, place))


GAINS = ["gain_1", "gain_2"]


def _gains(series: DataFrame) -> DataFrame:
    """By how much the mean squared residual of a regression on one lag, and on two, over the whole series exceeds those of both periods."""
    one, two = (lagged.chow(series, lagged.first_lags(k)).select("series_id", over(F.col("rss_full"), F.col("n_full")).alias("a"), (over(F.col("rss_0"), F.col("n_0")) + over(F.col("rss_1"), F.col("n_1"))).alias("b")) for k in (1, 2))
    named = [x.select("series_id", (F.col("a") - F.col("b")).alias(n)) for x, n in ((one, "gain_1"), (two, "gain_2"))]
    return named[0].join(named[1], "series_id")


QUERIES = {
    "normality_tests": lambda spark, sf_dir: rounded(normality.tests(user_series(spark, sf_dir))),
    "null_store": null_store_p_values,
    "adaptive_cusum": lambda spark, sf_dir: rounded(lagged.adaptive(user_series(spark, sf_dir), lagged.cusum)),
    "adaptive_chow": lambda spark, sf_dir: rounded(lagged.adaptive(user_series(spark, sf_dir), lagged.chow)),
    "fold_gaps": lambda spark, sf_dir: features.fold_gaps(_matrix(spark, sf_dir)),
    "five_models_auc": lambda spark, sf_dir: evaluation.auc(features.vote(features.out_of_folds(_matrix(spark, sf_dir), 3, ("gbt", "forest", "logistic", "tree", "bayes")))),
    "augmented_gain": lambda spark, sf_dir: selection.augmented_gain(planted(spark, sf_dir)),
    "tpe_auc": lambda spark, sf_dir: selection.search_trees(_matrix(spark, sf_dir), selection.TRIES, selection.FOLDS),
    "synthetic_ar1": lambda spark, sf_dir: rounded(distribution.descriptive(synthetic.like_first_period(user_series(spark, sf_dir)))),
    "test_p_values": lambda spark, sf_dir: p_values(user_series(spark, sf_dir)),
    "model_free_scores": lambda spark, sf_dir: model_free_scores(planted(spark, sf_dir)),
    "stream_scores": stream_scores,
    "spectral_features": _grouped(user_series, grouped.spectral, grouped.SPECTRAL),
    "pacf_lags": _grouped(user_series, grouped.pacf_profile, grouped.PACF),
    "ssa_components": _grouped(user_series, grouped.singular_spectrum, grouped.SSA),
    "mutual_information": _grouped(user_series, grouped.information, grouped.MI),
    "pelt_break": _grouped(planted, grouped.pelt_first, ["break_at", "segments_cost"]),
    "epps_singleton": _grouped(user_series, grouped.epps_singleton, ["es"]),
    "garch_break": _grouped(user_series, grouped.garch_break, grouped.GARCH),
    "synthetic_null": _grouped(planted, grouped.synthetic_null, grouped.NULLS),
    "linear_autoencoder": _grouped(type_series, grouped.linear_autoencoder, grouped.AUTOENCODER),
    "feature_matrix": lambda spark, sf_dir: rounded(features.filled(features.feature_matrix(planted(spark, sf_dir)))),
    "logistic_cv_auc": cross_validated("logistic"),
    "gbt_cv_auc": cross_validated("gbt"),
    "ml_null": null_p_values,
    "huber_cusum": _grouped(user_series, grouped.huber_cusum, grouped.HUBER),
    "ar_predictability": _grouped(type_series, grouped.predictability, ["r2"]),
    "welch_window": _grouped(type_series, grouped.optimal_window, grouped.WINDOW),
    "best_transform": _grouped(user_series, grouped.transforms, grouped.TRANSFORMS),
    "augmented_profile": augmented_profile,
    "stacked_auc": lambda spark, sf_dir: features.fold_auc(features.stacked(_matrix(spark, sf_dir)), 3),
    "calibrated_scores": lambda spark, sf_dir: features.calibrated(features.out_of_fold(_matrix(spark, sf_dir), 3, "logistic")),
    "cv_metrics": lambda spark, sf_dir: evaluation.fold_metrics(features.out_of_fold(_matrix(spark, sf_dir), 3, "forest")),
    "selected_features": chosen_features,
    "search_auc": lambda spark, sf_dir: features.random_search(_matrix(spark, sf_dir)),
    "direction_auc": lambda spark, sf_dir: evaluation.auc(features.direction_scores(user_series(spark, sf_dir))),
}
