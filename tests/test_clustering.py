"""All starts in one scan against MLlib, and the invariants of the models."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.linalg import Vectors

from riskloom.operators import clustering as K
from riskloom.sources.files import CURRENCY_TO_USD, currency_frames


@pytest.fixture(scope="module")
def points(spark):
    draw = np.random.default_rng(5)
    middle = draw.normal(0, 6, (4, 3))
    rows = [(Vectors.dense(middle[i % 4] + draw.normal(0, 1 + i % 3, 3)),) for i in range(1200)]
    return spark.createDataFrame(rows, ["components"]).repartition(5).cache()


def test_cost_is_that_of_the_best_single_fit(spark, points):
    rows = K.as_arrays(points)
    candidates = K.fit_many(rows, [2, 3, 4], starts=6)
    assert all(c.done for c in candidates)
    for k in (2, 3, 4):
        single = min(KMeans(k=k, seed=s, maxIter=300, tol=1e-6, featuresCol="components").fit(points).summary.trainingCost for s in range(6))
        best = K.best_of(candidates, k)
        assert best.cost <= single * 1.0001
        model = K.as_model(best, spark)
        assert np.allclose(sorted(map(tuple, model.clusterCenters())), sorted(map(tuple, best.centres)))
        data = np.array([r.x for r in rows.collect()])
        far = ((data[:, None] - best.centres) ** 2).sum(axis=2)
        assert far.min(axis=1).sum() == pytest.approx(best.cost, rel=1e-6)
        assert np.allclose([data[far.argmin(axis=1) == i].mean(axis=0) for i in range(k)], best.centres, atol=1e-5)


def test_silhouettes_equal_those_of_mllib(spark, points):
    rows = K.as_arrays(points)
    best = [K.best_of(K.fit_many(rows, [k], 2), k) for k in (2, 4)]
    for model, value in zip(best, K.silhouettes(rows, best)):
        placed = K.as_model(model, spark).transform(points)
        assert value == pytest.approx(ClusteringEvaluator(featuresCol="components", predictionCol="raw_cluster").evaluate(placed), abs=1e-6)


def test_jobs_do_not_grow_with_the_number_of_models(spark, points):
    rows, calls, scan = K.as_arrays(points), [], K._one_scan
    try:
        K._one_scan = lambda p, c: calls.append(len(c)) or scan(p, c)
        candidates = K.fit_many(rows, [2, 5], starts=8, iterations=7)
    finally:
        K._one_scan = scan
    assert len(candidates) == 16 and calls[0] == 16 and len(calls) <= 7 and calls == sorted(calls, reverse=True)


def test_fewer_points_than_clusters(spark):
    rows = spark.createDataFrame([(Vectors.dense([1.0, 2.0]),)] * 5 + [(Vectors.dense([3.0, 2.0]),)], ["components"])
    found = K.k_sweep(rows, [2, 3], starts=2).collect()
    assert [round(r.inertia, 9) for r in found] == [0.0, 0.0]
    assert sorted(map(tuple, K.fit_kmeans(rows, 3, 2).clusterCenters())) == [(1.0, 2.0), (3.0, 2.0)]


def test_rows_from_the_driver_start_no_python_workers(spark, monkeypatch):
    """A list given to `createDataFrame` is a Python RDD: a second set of workers, kept beside those of the scans."""
    seen = []

    class Watched(KMeans):
        def fit(self, dataset, params=None):
            seen.append(dataset)
            return super().fit(dataset, params)

    monkeypatch.setattr(K, "KMeans", Watched)
    model = K.as_model(K.Candidate(2, 0, np.array([[0.0, 1.0], [2.0, 5.0]])), spark)
    assert sorted(map(tuple, model.clusterCenters())) == [(0.0, 1.0), (2.0, 5.0)]
    countries, rates = currency_frames(spark)
    assert {r.currency: r.usd_rate for r in rates.collect()} == CURRENCY_TO_USD and countries.count() == 6
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (*seen, countries, rates)]
    assert len(plans) == 3 and all("LocalRelation" in p and "RDD" not in p for p in plans), plans
