"""Classes are fitted at once, with the results of one after the other."""

import numpy as np
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from spindle.operators import learning


def test_classes_fitted_at_once_predict_the_same(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(4 * (i % 2), 1.0, 2)], i % 2) for i in range(40)]
    data = spark.createDataFrame(rows, "id long, x array<double>, y int").repartition(4, "id")
    vec = data.coalesce(1).select("id", array_to_vector("x").alias("features"), F.col("y").cast("double").alias("label"))
    alone = OneVsRest(classifier=LinearSVC(maxIter=50)).fit(vec).transform(vec).select("id", F.col("prediction").cast("int"))
    asked, parts, plain = [], [], OneVsRest.fit

    def fit(self, df):
        asked.append(self.getParallelism())
        parts.append(df.rdd.getNumPartitions())
        return plain(self, df)

    monkeypatch.setattr(OneVsRest, "fit", fit)
    got = learning.classified(data, data, "svm").select("id", "predicted")
    assert asked == [learning.AT_ONCE] and parts == [1]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, alone.collect()))


def test_fewer_classes_at_once_on_many_rows():
    assert [learning.classes_at_once(n) for n in (0, 10**8, 2 * 10**8, 3 * 10**8, 10**12)] == [10, 10, 5, 4, 4]
