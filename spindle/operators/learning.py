"""Classification of embeddings: resampling, classifiers, cross-validation."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .joins import ranked as numbered
from .measures import scores
from .nearest import Cells
from .tall import each, total

CLASSIFIERS = {
    "logistic": lambda seed: LogisticRegression(maxIter=100),
    "forest": lambda seed: RandomForestClassifier(numTrees=50, seed=seed),
    "svm": lambda seed: OneVsRest(classifier=LinearSVC(maxIter=50)),
}
#: Numbers in the blocks of rows that the classes fitted at once keep, by which up to ``AT_ONCE`` classes are; never under ``LEAST_AT_ONCE``.
KEPT_NUMBERS, AT_ONCE, LEAST_AT_ONCE = 1_000_000_000, 10, 4
#: Numbers of a partition at least: every pass over the rows is a job, whose tasks cost more than small partitions' sums.
PART_NUMBERS = 2_000_000


def resampled(rows: DataFrame, method: str, k: int = 5, seed: int = 0) -> DataFrame:
    """``rows`` (id, x, y) balanced: ros, rus, smote, borderline_smote, adasyn, tomek, enn, smote_tomek, smote_enn or class_weight.

    Made rows are numbered downwards from below every id, and below 0.
    """
    if method == "class_weight":
        n = rows.groupBy("y").agg(F.count("*").alias("n"))
        t = n.agg(F.sum("n").alias("t"), F.count("*").alias("k"))
        return rows.join(F.broadcast(n.join(F.broadcast(t)).select("y", (F.col("t") / (F.col("k") * F.col("n"))).alias("weight"))), "y")
    if method in ("smote_tomek", "smote_enn"):
        return resampled(written(resampled(rows, "smote", k, seed), "smote"), method.split("_")[1], k, seed)
    if method in ("tomek", "enn"):
        near = written(_neighbours(rows, rows, 1 if method == "tomek" else 3, same=False), "near")
        if method == "tomek":  # both of a pair of nearest neighbours of different classes go
            pair = near.join(near.select(F.col("other").alias("id"), F.col("id").alias("other"), F.lit(True).alias("mutual")), ["id", "other"]).where("y <> other_y")
            bad = pair.select("id")
        else:
            bad = near.groupBy("id").agg(F.avg((F.col("y") == F.col("other_y")).cast("double")).alias("agree")).where("agree < 0.5").select("id")
        return rows.join(bad.distinct(), "id", "left_anti")
    n = rows.groupBy("y").agg(F.count("*").alias("n"))
    ends = n.agg(F.max("n").alias("most"), F.min("n").alias("least"))
    order = F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("id", F.lit(seed)), "id"))
    ranked = rows.join(F.broadcast(n), "y").join(F.broadcast(ends)).withColumn("r", order)
    if method == "rus":
        return ranked.where("r <= least").select(*rows.columns)
    whole = F.floor((F.col("most") - F.col("r")) / F.col("n")).cast("int")  # copies besides the row itself
    if method == "ros":
        return ranked.withColumn("c", F.explode(F.sequence(F.lit(0), whole))).select(*rows.columns)
    grown = written(ranked.withColumn("c", F.explode(F.sequence(F.lit(0), whole))).where("c > 0").select("id", "c", "x", "y"), "grown")
    asking = grown.where("c = 1").select("id", "x", "y")  # no other row's neighbours are asked for
    if method in ("borderline_smote", "adasyn"):
        foreign = _neighbours(rows, asking, k, same=False).groupBy("id").agg(F.avg((F.col("y") != F.col("other_y")).cast("double")).alias("foreign"))
        hard = written(foreign.where("foreign >= 0.5" if method == "borderline_smote" else "foreign > 0").select("id"), "hard")
        grown, asking = grown.join(hard, "id", "left_semi"), asking.join(hard, "id", "left_semi")
    near = written(_neighbours(rows, asking, k, same=True).select("id", "rank", "other"), "near")
    options = near.groupBy("id").agg(F.count("*").alias("options"))
    pick = (F.pmod(F.xxhash64("id", "c", F.lit(seed)), F.col("options").cast("int")) + 1).cast("int")
    picked = grown.join(options, "id").withColumn("rank", pick).join(near, ["id", "rank"]).join(rows.select(F.col("id").alias("other"), F.col("x").alias("ox")), "other")
    u = F.pmod(F.xxhash64("id", "c", F.lit(seed + 1)), F.lit(1 << 20)) / (1 << 20)
    new = picked.select("id", "c", F.zip_with("x", "ox", lambda a, b: a + u * (b - a)).alias("x"), "y")
    first = min(rows.agg(F.min("id")).first()[0] or 0, 0)
    new = numbered(new, "place", "id", "c").select((F.lit(first - 1) - F.col("place")).alias("id"), "x", "y")
    return rows.select("id", "x", "y").unionByName(new)


def _neighbours(rows: DataFrame, asking: DataFrame, k: int, same: bool) -> DataFrame:
    """(id, y, other, other_y, rank): of those ``asking`` the nearest ``rows``, of the same class only if ``same``; searched by pivot cells."""
    near = Cells(rows.select("id", "x", "y"), "y" if same else None).nearest(asking, k).select("id", "other", "rank")
    return near.join(rows.select("id", "y"), "id").join(rows.select(F.col("id").alias("other"), F.col("y").alias("other_y")), "other").select("id", "y", "other", "other_y", "rank")


def random_features(train: DataFrame, width: int = 512, gamma: float | None = None, seed: int = 0):
    """A function of rows (id, x, y) that puts ``width`` random Fourier features of the Gaussian kernel in place of x.

    Dot products of them come near exp(-gamma |x - y|^2); gamma is 1 / (dimensions * variance of the
    training rows' components) unless it is given.
    """
    first = train.select(F.size("x")).first()
    d = first[0] if first else 0
    if gamma is None:
        n, s, q = total(train, lambda x: [x.size, x.sum(), (x**2).sum()], (3,), "x")
        gamma = 1 / max(d * (q / max(n, 1) - (s / max(n, 1)) ** 2), 1e-12) if d else 1.0
    rng = np.random.default_rng(seed)
    w, turn = rng.standard_normal((d, width)) * np.sqrt(2 * gamma), rng.uniform(0, 2 * np.pi, width)
    return lambda rows: each(rows.select("id", "y", "x"), lambda x: np.cos(x @ w + turn) * np.sqrt(2 / width), "x", keep=("id", "y"), out=("x",))


def classified(train: DataFrame, test: DataFrame, method: str = "logistic", seed: int = 0) -> DataFrame:
    """``test`` (id, x, y) with predicted, by a classifier of ``train``; "rbf" is "svm" on random features of the Gaussian kernel."""
    if method == "rbf":
        features = random_features(train, seed=seed)
        return classified(features(train), features(test), "svm", seed)
    vec = lambda d: d.select("id", array_to_vector("x").alias("features"), F.col("y").cast("double").alias("label"), F.col("y"))
    fitted = CLASSIFIERS[method](seed)
    if isinstance(fitted, OneVsRest):
        # A class's fit is a row of some 50 short jobs that leave most cores idle, and no class waits for another.
        n, d = train.agg(F.count("*"), F.max(F.size("x"))).first()
        fitted.setParallelism(classes_at_once(n * (d or 1)))
        train = train.coalesce(max(1, -(-n * (d or 1) // PART_NUMBERS)))
    return fitted.fit(vec(train)).transform(vec(test)).select("id", "y", F.col("prediction").cast("int").alias("predicted"))


def classes_at_once(numbers: int) -> int:
    """How many classes are fitted at once on rows of so many ``numbers``: each fit keeps a copy of its own."""
    return max(LEAST_AT_ONCE, min(AT_ONCE, KEPT_NUMBERS // max(numbers, 1)))


def cross_validated(rows: DataFrame, method: str = "logistic", folds: int = 5, seed: int = 0) -> DataFrame:
    """(fold, accuracy, ...): rows are dealt to folds within their class."""
    order = F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("id", F.lit(seed)), "id"))
    dealt = rows.withColumn("fold", F.pmod(order, F.lit(folds)))
    out = None
    for f in range(folds):
        one = scores(classified(dealt.where(F.col("fold") != f), dealt.where(F.col("fold") == f), method, seed)).withColumn("fold", F.lit(f))
        out = one if out is None else out.unionByName(one)
    return out
