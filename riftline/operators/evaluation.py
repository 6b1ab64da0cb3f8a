"""Measures of scores (series_id, label 0/1, score) against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riftline.functions.moments import over
from riftline.operators.ranges import area_under, running, with_quantiles


def roc_points(scores: DataFrame) -> DataFrame:
    """One row per distinct score, from the highest: rates of true and false positives at that threshold.

    Counts are summed by score first and accumulated by ranges of scores.
    """
    by = scores.groupBy("score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    totals = scores.agg(F.sum("label").alias("all_p"), F.sum(1 - F.col("label")).alias("all_n"))
    run = running(by, "score", ["p", "n"], descending=True)
    return run.join(F.broadcast(totals)).select("score", over(F.col("run_p"), F.col("all_p")).alias("tpr"), over(F.col("run_n"), F.col("all_n")).alias("fpr"))


def auc(scores: DataFrame) -> DataFrame:
    """Area under the ROC curve by average ranks."""
    return area_under(scores.groupBy("score").agg(F.sum("label").cast("double").alias("p"), F.count("*").cast("double").alias("k")), "score")


def confusion(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.groupBy(F.col("label").cast("long").alias("label"), (F.col("score") >= threshold).cast("long").alias("predicted")).agg(F.count("*").alias("n"))


def class_report(scores: DataFrame, threshold: float) -> DataFrame:
    """Precision, recall, F1 and support of each class at a threshold."""
    hit = (F.col("score") >= threshold).cast("int")
    both = scores.select("label", hit.alias("guess")).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("class"))
    g = both.groupBy(F.col("class").cast("long").alias("class")).agg(*[F.count(F.when(c, 1)).alias(k) for k, c in (("tp", (F.col("label") == F.col("class")) & (F.col("guess") == F.col("class"))), ("said", F.col("guess") == F.col("class")), ("support", F.col("label") == F.col("class")))])
    return g.select("class", over(F.col("tp"), F.col("said")).alias("precision"), over(F.col("tp"), F.col("support")).alias("recall"), over(2 * F.col("tp"), F.col("said") + F.col("support")).alias("f1"), "support")


def threshold_sweep(scores: DataFrame, thresholds: list[float]) -> DataFrame:
    """Precision, recall, F1 and coverage at each threshold."""
    each = scores.select("*", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    said = F.col("score") >= F.col("threshold")
    g = each.groupBy("threshold").agg(F.count(F.when(said & (F.col("label") == 1), 1)).alias("tp"), F.count(F.when(said, 1)).alias("said"), F.sum("label").alias("real"), F.count("*").alias("n"))
    return g.select("threshold", over(F.col("tp"), F.col("said")).alias("precision"), over(F.col("tp"), F.col("real")).alias("recall"), over(2 * F.col("tp"), F.col("said") + F.col("real")).alias("f1"), over(F.col("said"), F.col("n")).alias("coverage"))


def joint_firing(features: DataFrame, a: str, b: str, level: float) -> DataFrame:
    """How often two statistics exceed a level alone, together or not at all, with the share of breaks."""
    fires = lambda c: (F.abs(F.col(c)) > level).cast("long")
    return features.groupBy(fires(a).alias(f"{a}_fires"), fires(b).alias(f"{b}_fires")).agg(F.count("*").alias("n"), F.avg(F.col("label").cast("double")).alias("break_rate"))


def cohens_d(features: DataFrame, names: list[str]) -> DataFrame:
    """Difference of the classes' means over their pooled deviation, for each feature, in one pass."""
    of = lambda c, k: F.when(F.col("label") == k, F.col(c))
    one = features.agg(*[f(of(c, k)).alias(f"{c}|{n}{k}") for c in names for k in (0, 1) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    x = lambda c, n: F.col(f"`{c}|{n}`")
    pooled = lambda c: F.sqrt(over((x(c, "n0") - 1) * x(c, "v0") + (x(c, "n1") - 1) * x(c, "v1"), x(c, "n0") + x(c, "n1") - 2))
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), over(x(c, "m1") - x(c, "m0"), pooled(c)).alias("d")) for c in names])).alias("r")).select("r.*")


def signal_buckets(scores: DataFrame) -> DataFrame:
    """Real breaks by quarter (1 weakest) of their scores."""
    real = scores.where((F.col("label") == 1) & F.col("score").isNotNull())
    q = with_quantiles(real.agg(F.count("*").alias("all")), real, {f"q{k}": ("score", k / 4) for k in (1, 2, 3)})
    above = sum(((F.col("score") > F.col(f"q{k}")).cast("long") for k in (1, 2, 3)), F.lit(1).cast("long"))
    return real.join(F.broadcast(q)).groupBy(above.alias("bucket")).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))


def fold_metrics(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision and recall by fold."""
    said, real = F.col("score") >= threshold, F.col("label") == 1
    n = lambda c: F.count(F.when(c, 1))
    return scores.groupBy(F.col("fold").cast("long").alias("fold")).agg(over(n(said == real), F.count("*")).alias("accuracy"), over(n(said & real), n(said)).alias("precision"), over(n(said & real), n(real)).alias("recall"), F.count("*").alias("n"))
