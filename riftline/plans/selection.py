"""Choice of features by mutual information, and of parameters by densities of good and of bad draws."""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riftline.operators import evaluation, ranges
from riftline.plans import features
from riftline.sources.checkpoints import cut


def mutual_information(matrix: DataFrame, names: list[str], bins: int = 10) -> DataFrame:
    """feature, information (nats) between each feature, in ``bins`` bins of equal counts, and the label.

    Bins are divided by exact quantiles (equal values share a bin), nulls are left out; one pass counts all features.
    """
    shares = [k / bins for k in range(1, bins)]
    cells, edges = [], ranges.quantiles(matrix, names, shares).collect()
    for c in names:
        cuts = sorted({r["value"] for r in edges if r["column"] == c})
        bin_ = sum((F.when(F.col(c) > x, 1).otherwise(0) for x in cuts), F.lit(0))
        cells.append(F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("feature"), bin_.alias("bin"))))
    rows = matrix.select("label", F.explode(F.array(*cells)).alias("cell")).where("cell IS NOT NULL AND label IS NOT NULL").groupBy("cell.feature", "cell.bin", "label").agg(F.count("*").cast("double").alias("k"))
    over_ = lambda *by: F.sum("k").over(Window.partitionBy("feature", *by))
    return rows.select("feature", (F.col("k") / over_() * F.log(F.col("k") * over_() / (over_("bin") * over_("label")))).alias("i")).groupBy("feature").agg(F.sum("i").alias("information"))


def best_by_information(matrix: DataFrame, n: int = 10, bins: int = 10) -> list[str]:
    """Names of the n most informative features, ties by name."""
    found = mutual_information(matrix, features.feature_columns(matrix), bins).collect()  # a row for each column
    return [r["feature"] for r in sorted(found, key=lambda r: (-r["information"], r["feature"]))[:n]]


# --- parameters -------------------------------------------------------------------------------------------------------
#: Parameters of boosted trees: range, and whether whole and whether drawn on a logarithmic scale.
SPACE = {
    "maxIter": (5, 60, True, True), "maxDepth": (2, 6, True, False), "stepSize": (0.02, 0.4, False, True), "subsamplingRate": (0.5, 1.0, False, False), "minInstancesPerNode": (1, 20, True, True),
    "minInfoGain": (1e-6, 1e-1, False, True), "maxBins": (16, 64, True, True), "featureShare": (0.3, 1.0, False, False), "minWeightFractionPerNode": (0.0, 0.1, False, False),
}
GOOD, FIRST, CANDIDATES, WIDTH = 0.1, 8, 24, 0.03
#: Tries of a whole search, and folds of each: those of the reference.
TRIES, FOLDS = 20, 5


class Draws:
    """Parameters drawn in unit coordinates: the first ones evenly, later ones where good draws are dense and bad ones aren't.

    A density is a mixture of normal kernels around the draws and an even share; of CANDIDATES points from the good
    one the point with the largest ratio of the two is tried next, each parameter on its own.
    """

    def __init__(self, space: dict, seed: int, first: int = FIRST):
        self.space, self.first, self.random = space, first, random.Random(seed)
        self.tried: list[tuple[dict[str, float], float]] = []

    def _density(self, x: float, centres: list[float]) -> float:
        kernels = sum(math.exp(-0.5 * ((x - c) / WIDTH) ** 2) / (WIDTH * math.sqrt(2 * math.pi)) for c in centres)
        return (1 + kernels) / (1 + len(centres))

    def _point(self, centres: list[float]) -> float:
        k = self.random.randrange(len(centres) + 1)
        if k == len(centres):
            return self.random.random()
        return min(1.0, max(0.0, self.random.gauss(centres[k], WIDTH)))

    def next(self) -> dict[str, float]:
        if len(self.tried) < self.first:
            return {c: self.random.random() for c in self.space}
        ordered = sorted(self.tried, key=lambda t: -t[1])
        n = max(1, math.ceil(GOOD * len(ordered)))
        out = {}
        for c in self.space:
            good, bad = ([u[c] for u, _ in part] for part in (ordered[:n], ordered[n:]))
            points = [self._point(good) for _ in range(CANDIDATES)]
            out[c] = max(points, key=lambda x: self._density(x, good) / self._density(x, bad))
        return out

    def tell(self, unit: dict[str, float], score: float) -> None:
        self.tried.append((unit, score))

    def named(self, unit: dict[str, float]) -> dict[str, float]:
        """Unit coordinates as parameters."""
        out = {}
        for c, (low, high, whole, logarithmic) in self.space.items():
            x = math.exp(math.log(low) + unit[c] * (math.log(high) - math.log(low))) if logarithmic else low + unit[c] * (high - low)
            out[c] = round(x) if whole else x
        return out


def searched(score: Callable[[dict], float], tries: int, seed: int = 42, space: dict = SPACE, first: int = FIRST, each: Callable = map) -> list[tuple[dict, float]]:
    """Parameters tried and their scores (higher is better), in order.

    The first draws don't depend on scores, so ``each``, which is called like map, gets them all at once; later ones come one by one.
    """
    draws = Draws(space, seed, first)
    while (done := len(draws.tried)) < tries:
        units = [draws.next() for _ in range(min(max(1, first - done), tries - done))]
        for unit, s in zip(units, list(each(score, [draws.named(u) for u in units])), strict=True):
            draws.tell(unit, s)
    return [(draws.named(u), s) for u, s in draws.tried]


def search_trees(matrix: DataFrame, tries: int, k: int = 2, seed: int = 42, first: int = FIRST) -> DataFrame:
    """Parameters of boosted trees in the order tried, with the AUC over all folds, which are made once for all tries."""
    held = features.in_folds(matrix, k)

    def score(parameters: dict) -> float:
        return evaluation.auc(features.scored(held, k, "tuned", **parameters)).first()["auc"] or 0.0

    tried = searched(score, tries, seed, first=first, each=partial(features.together, matrix.sparkSession))
    columns = list(SPACE)
    rows = [(n, *[float(p[c]) for c in columns], float(s)) for n, (p, s) in enumerate(tried)]
    return matrix.sparkSession.createDataFrame(rows, "try long, " + ", ".join(f"`{c}` double" for c in columns) + ", auc double")


def augmented_gain(series: DataFrame, names: tuple[str, ...] = tuple(features.EXTRACTORS), copies: int = 1, k: int = 3, kind: str = "forest") -> DataFrame:
    """AUC by fold of models that learn on the series alone, and on them with changed copies of them; both are scored on unchanged series.

    A copy is in the fold of the series that it was made from, so no fold is scored by a model that has seen a copy of its series.
    """
    from riftline.operators import datasets

    labels = cut(datasets.labels_of(series))
    folds = cut(datasets.stratified_folds(labels, k).select(F.col("series_id").cast("string").alias("source"), "fold", F.col("has_break").cast("double").alias("label")))
    plain = series.select(F.col("series_id").cast("string").alias("series_id"), "t", "value", "period")
    parts = [plain, *[datasets.augmented(series.select("series_id", "t", "value", "period"), kind_, c) for c in range(copies) for kind_ in ("noise",)]]
    matrix = features.filled(features.feature_matrix(reduce(DataFrame.unionByName, parts), names))
    m = cut(matrix.withColumn("source", F.regexp_replace("series_id", "_aug[0-9]+$", "")).join(folds, "source").withColumn("copy", F.col("series_id") != F.col("source")).drop("source"))
    out = []
    for which, rows in (("baseline", m.where("NOT copy")), ("augmented", m)):
        for f in range(k):
            model = features.fit(rows.where(F.col("fold") != f).drop("fold", "copy"), kind)
            scored = features.predict(model, m.where((F.col("fold") == f) & ~F.col("copy")).drop("copy"))
            out.append(evaluation.auc(scored).select(F.lit(which).alias("training"), F.lit(f).cast("long").alias("fold"), "auc"))
    return reduce(DataFrame.unionByName, out)
