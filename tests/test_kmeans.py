import random

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector

from placescore.operators import kmeans


def _frame(spark, rows, parts):
    return spark.createDataFrame(list(enumerate(rows)), "key long, x array<double>").repartition(parts)


def _cost(rows, centres):
    return float(((np.array(rows)[:, None, :] - centres[None]) ** 2).sum(axis=2).min(axis=1).sum())


def test_costs_are_true_no_worse_than_spark_ml_and_independent_of_partitions(spark):
    rnd = random.Random(2)
    hubs = [[rnd.gauss(0, 6) for _ in range(3)] for _ in range(12)]
    rows = [[h + rnd.gauss(0, 1.5) for h in rnd.choice(hubs)] for _ in range(900)]
    df = _frame(spark, rows, 5)
    got = kmeans.fit(df, "key", "x", (3, 8), 6, 42)
    again = kmeans.fit(_frame(spark, rows, 2), "key", "x", (3, 8), 6, 42)
    z = df.withColumn("z", array_to_vector("x")).cache()
    for k, m in got.items():
        assert m.cost == pytest.approx(_cost(rows, m.centres)) and m.sizes.sum() == len(rows)
        assert again[k].start == m.start and np.allclose(again[k].centres, m.centres)
        other = min(KMeans(k=k, seed=42 + s, featuresCol="z", maxIter=300, tol=1e-4).fit(z).summary.trainingCost for s in range(6))
        assert m.cost <= other * 1.02
        # Each centre is the mean of its points (up to the tolerance).
        at = ((np.array(rows)[:, None, :] - m.centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert all(np.allclose(np.array(rows)[at == c].mean(axis=0), m.centres[c], atol=1e-3) for c in range(k))


def test_passes_do_not_grow_with_the_number_of_starts(spark, monkeypatch):
    rows = [[float(v % 13), float(v * v % 17)] for v in range(300)]
    df, count, plain = _frame(spark, rows, 3), [0], kmeans._sums

    def counted(*args):
        count[0] += 1
        return plain(*args)

    monkeypatch.setattr(kmeans, "_sums", counted)
    kmeans.fit(df, "key", "x", (2, 4), 1, 1)
    one, count[0] = count[0], 0
    kmeans.fit(df, "key", "x", (2, 4), 8, 1)
    assert count[0] <= 2 * one + 20


def test_few_distinct_points_ties_and_no_points(spark):
    df = _frame(spark, [[1.0, 1.0]] * 40 + [[2.0, 5.0]] * 10, 4)
    m = kmeans.fit(df, "key", "x", (5,), 3, 0)[5]
    assert m.cost == 0 and sorted(m.sizes) == [10, 40]
    with pytest.raises(ValueError, match="no units"):
        kmeans.fit(_frame(spark, [[1.0]], 1).filter("key < 0"), "key", "x", (2,), 2, 0)
