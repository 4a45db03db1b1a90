"""Customer groups: scaling, one-hot, principal components and K-means as one MLlib pipeline."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import (PCA, ElementwiseProduct, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer,
                                VectorAssembler)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.contracts import CUSTOMER_FEATURES, validate
from riskloom.operators.scaling import MAX_GROUP_ROWS, exact_quantiles
from riskloom.session import materialize, small_table

# Model inputs and sizes.
LOG_COLUMNS = ["credit_score", "income_usd", "Deuda_usd", "Activos_financieros_usd"]
NUMERIC_COLUMNS = ["Edad"]
CATEGORY_COLUMNS = ["country", "education_level"]
INPUT_COLUMNS = ["customer_id", *NUMERIC_COLUMNS, *LOG_COLUMNS, *CATEGORY_COLUMNS]
N_COMPONENTS, N_CLUSTERS, N_STARTS, SEED = 6, 3, 10, 42
START_SAMPLE = 10_000           # points that first centres are drawn from
ROWS_AT_ONCE = 4096
# A missing category seen in training is a category of its own.
MISSING = "(missing)"


def require_inputs(features: DataFrame) -> None:
    missing = [c for c in INPUT_COLUMNS if c not in features.columns]
    if missing:
        raise KeyError(f"missing customer columns {missing}")


def _prepare_sql() -> SQLTransformer:
    parts = [f"log1p({c}) AS log_{c}" for c in LOG_COLUMNS]
    parts += [f"cast({c} AS double) AS num_{c}" for c in NUMERIC_COLUMNS]
    parts += [f"coalesce({c}, '{MISSING}') AS cat_{c}" for c in CATEGORY_COLUMNS]
    return SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")


def preprocessing_stages(rows: int) -> list:
    """log1p and standardisation of the skewed amounts, standardisation of age, one-hot categories.

    StandardScaler divides by the sample deviation; the factor turns that into the population one.
    Categories are numbered alphabetically; one not seen in training becomes a zero vector.
    """
    factor = (rows / (rows - 1)) ** 0.5 if rows > 1 else 1.0
    numeric = [f"log_{c}" for c in LOG_COLUMNS] + [f"num_{c}" for c in NUMERIC_COLUMNS]
    indexed = [f"idx_{c}" for c in CATEGORY_COLUMNS]
    encoded = [f"hot_{c}" for c in CATEGORY_COLUMNS]
    return [
        _prepare_sql(),
        VectorAssembler(inputCols=numeric, outputCol="numeric_raw"),
        StandardScaler(inputCol="numeric_raw", outputCol="numeric_sample", withMean=True, withStd=True),
        ElementwiseProduct(inputCol="numeric_sample", outputCol="numeric_scaled",
                           scalingVec=Vectors.dense([factor] * len(numeric))),
        StringIndexer(inputCols=[f"cat_{c}" for c in CATEGORY_COLUMNS], outputCols=indexed, handleInvalid="keep",
                      stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True),
        VectorAssembler(inputCols=["numeric_scaled", *encoded], outputCol="features"),
    ]


def fit_preprocessor(features: DataFrame) -> PipelineModel:
    return Pipeline(stages=preprocessing_stages(features.count())).fit(features)


def feature_names(preprocessor: PipelineModel) -> list[str]:
    """Names of the positions of the feature vector."""
    indexer = next(s for s in preprocessor.stages if s.__class__.__name__ == "StringIndexerModel")
    names = [f"log_numeric__{c}" for c in LOG_COLUMNS] + [f"numeric__{c}" for c in NUMERIC_COLUMNS]
    for column, labels in zip(CATEGORY_COLUMNS, indexer.labelsArray):
        names += [f"categorical__{column}_{label}" for label in labels]
    return names


def fit_pca(preprocessed: DataFrame, components: int, width: int):
    return PCA(k=min(components, width), inputCol="features", outputCol="components").fit(preprocessed)


@dataclass
class Candidate:
    """One K-means model while it is fitted: number of clusters, number of the start, centres and sum of squared distances."""

    k: int
    start: int
    centres: np.ndarray
    cost: float = math.inf
    done: bool = False


def as_arrays(points: DataFrame) -> DataFrame:
    """The components as (x array<double>), written once for all scans."""
    return materialize(points.select(vector_to_array("components").alias("x")), "points")


def _first_centres(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++: each further centre is drawn with a chance that grows with the squared distance to those chosen."""
    draw = np.random.default_rng(seed)
    centres = [sample[draw.integers(len(sample))]]
    near = ((sample - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k:
        if near.sum() <= 0:
            centres.append(centres[0])                          # fewer different points than centres
            continue
        centres.append(sample[draw.choice(len(sample), p=near / near.sum())])
        near = np.minimum(near, ((sample - centres[-1]) ** 2).sum(axis=1))
    return np.array(centres)


def _points_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    column = batch.column(0)
    whole = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    for at in range(0, len(whole), ROWS_AT_ONCE):
        yield whole[at:at + ROWS_AT_ONCE]


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1), 0.0)


def _one_scan(points: DataFrame, candidates: list[Candidate]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every centre of all candidates: points, sum of the points, of their squares and of their squared distances.

    One job: each task sums over its rows for all candidates and sends one row per centre.
    """
    centres = np.concatenate([c.centres for c in candidates])
    first = np.cumsum([0] + [c.k for c in candidates])
    width = centres.shape[1]
    names = ["n", "squares", "cost", *[f"s{i}" for i in range(width)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(centres), 3 + width))
        for batch in batches:
            for x in _points_of(batch):
                far = _distances(x, centres)
                squares = (x * x).sum(axis=1)
                for a, b in zip(first[:-1], first[1:]):
                    near = far[:, a:b].argmin(axis=1)
                    values = [np.ones(len(x)), squares, far[np.arange(len(x)), a + near], *x.T]
                    for column, value in enumerate(values):
                        sums[a:b, column] += np.bincount(near, value, b - a)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centres))), *[pa.array(np.ascontiguousarray(c)) for c in sums.T]], ["centre", *names])

    partial = points.mapInArrow(run, "centre bigint, " + ", ".join(f"{n} double" for n in names))
    rows = partial.groupBy("centre").agg(*[F.sum(n).alias(n) for n in names]).orderBy("centre").collect()     # one row per centre
    found = np.array([[r[n] for n in names] for r in rows])
    return found[:, 0], found[:, 3:], found[:, 1], found[:, 2]


def fit_many(points: DataFrame, ks: Iterable[int], starts: int = N_STARTS, seed: int = SEED, tolerance: float = 1e-6,
             iterations: int = 300) -> list[Candidate]:
    """All starts of all numbers of clusters together: one scan of the points per iteration, whatever their number.

    `points` is a written table (x array<double>). First centres come from the START_SAMPLE points with the smallest
    hashes. A candidate whose centres do not move any more leaves the scans.
    """
    sample = np.array([r["x"] for r in points.orderBy(F.xxhash64("x"), "x").limit(START_SAMPLE).collect()])
    candidates = [Candidate(k, start, _first_centres(sample, k, seed + start)) for k in ks for start in range(starts)]
    for _ in range(iterations):
        active = [c for c in candidates if not c.done]
        if not active:
            break
        n, sums, _, costs = _one_scan(points, active)
        at = 0
        for c in active:
            part, at = slice(at, at + c.k), at + c.k
            held = n[part] > 0
            moved = np.where(held[:, None], sums[part] / np.maximum(n[part], 1)[:, None], c.centres)       # an empty one stays
            c.done = bool((((moved - c.centres) ** 2).sum(axis=1) <= tolerance ** 2).all())
            c.centres, c.cost = moved, float(costs[part].sum())
    return candidates


def best_of(candidates: list[Candidate], k: int) -> Candidate:
    return min((c for c in candidates if c.k == k), key=lambda c: (c.cost, c.start))


def as_model(candidate: Candidate, spark) -> KMeansModel:
    """The MLlib model with these centres: fitted to the centres themselves, each of which is a cluster of its own."""
    centres = small_table(spark, [(c.tolist(),) for c in np.unique(candidate.centres, axis=0)], "x array<double>").select(
        array_to_vector("x").alias("components"))
    return KMeans(k=candidate.k, initMode="random", maxIter=1, seed=SEED, featuresCol="components", predictionCol="raw_cluster").fit(centres)


def fit_kmeans(points: DataFrame, k: int = N_CLUSTERS, starts: int = N_STARTS, seed: int = SEED) -> KMeansModel:
    """Best of several starts by the sum of squared distances."""
    return as_model(best_of(fit_many(as_arrays(points), [k], starts, seed), k), points.sparkSession)


def silhouettes(points: DataFrame, models: list[Candidate]) -> list[float]:
    """Mean silhouette of squared distances of each model, all in two scans.

    The mean squared distance of a point to a cluster follows from the cluster's count, sum and sum of squares. A
    point alone in its cluster counts as 0, as does everything with a single cluster.
    """
    n, sums, squares, _ = _one_scan(points, models)
    centres = np.concatenate([m.centres for m in models])
    first = np.cumsum([0] + [m.k for m in models])
    total = n[:first[1]].sum()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(models))
        for batch in batches:
            for x in _points_of(batch):
                far = _distances(x, centres)
                with np.errstate(divide="ignore", invalid="ignore"):
                    mean = (x * x).sum(axis=1)[:, None] + (squares - 2 * x @ sums.T) / n
                    for i, (a, b) in enumerate(zip(first[:-1], first[1:])):
                        rows, own = np.arange(len(x)), far[:, a:b].argmin(axis=1)
                        inside = mean[rows, a + own] * n[a + own] / (n[a + own] - 1)
                        others = np.where((np.arange(a, b) == (a + own)[:, None]) | (n[a:b] == 0), np.inf, mean[:, a:b]).min(axis=1)
                        value = (others - inside) / np.maximum(others, inside)
                        found[i] += np.where((n[a + own] > 1) & np.isfinite(others), value, 0.0).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(models))), pa.array(found)], ["model", "total"])

    rows = points.mapInArrow(run, "model bigint, total double").groupBy("model").agg(F.sum("total").alias("total")).orderBy("model").collect()
    return [r["total"] / total for r in rows]


def _relabel(model: KMeansModel) -> SQLTransformer:
    """Stable cluster numbers: by the first coordinates of the centre."""
    order = sorted(range(len(model.clusterCenters())), key=lambda i: tuple(model.clusterCenters()[i]))
    cases = " ".join(f"WHEN {old} THEN {new}" for new, old in enumerate(order))
    return SQLTransformer(statement=f"SELECT *, CASE raw_cluster {cases} END AS cluster FROM __THIS__")


def fit_components(features: DataFrame, components: int = N_COMPONENTS) -> PipelineModel:
    """Preprocessing and principal components, without clusters."""
    require_inputs(features)
    preprocessor = fit_preprocessor(features)
    prepared = preprocessor.transform(features).select("features")
    return PipelineModel(stages=[*preprocessor.stages, fit_pca(prepared, components, len(feature_names(preprocessor)))])


def fit_customer_clusters(features: DataFrame, components: int = N_COMPONENTS, clusters: int = N_CLUSTERS,
                          seed: int = SEED, starts: int = N_STARTS, checked: bool = False) -> PipelineModel:
    """The whole model as one pipeline: features in, `cluster` out.

    `checked` skips the contract for features that have just passed it.
    """
    if not checked:
        require_inputs(features)
        validate(features, CUSTOMER_FEATURES)
    preprocessor = fit_components(features, components)
    *stages, pca = preprocessor.stages
    prepared = PipelineModel(stages=stages).transform(features).select("features")
    kmeans = fit_kmeans(pca.transform(prepared).select("components"), clusters, starts, seed)
    return PipelineModel(stages=[*stages, pca, kmeans, _relabel(kmeans)])


def pca_stage(model: PipelineModel):
    return next(s for s in model.stages if s.__class__.__name__ == "PCAModel")


def explained_variance(model: PipelineModel) -> float:
    return float(sum(pca_stage(model).explainedVariance))


def assign_clusters(model: PipelineModel, features: DataFrame, checked: bool = False) -> DataFrame:
    """customer_id and cluster of every row; no rows give no rows."""
    require_inputs(features)
    if not checked:
        validate(features, CUSTOMER_FEATURES)
    return model.transform(features).select("customer_id", F.col("cluster").cast("int").alias("cluster"))


def k_sweep(points: DataFrame, ks: Iterable[int] = range(2, 11), starts: int = N_STARTS, seed: int = SEED) -> DataFrame:
    """(k, inertia, silhouette) for several numbers of clusters; one small row per k."""
    ks, rows = list(ks), as_arrays(points)
    candidates = fit_many(rows, ks, starts, seed)
    best = [best_of(candidates, k) for k in ks]
    found = [(m.k, m.cost, float(s)) for m, s in zip(best, silhouettes(rows, best))]
    return points.sparkSession.createDataFrame(found, "k int, inertia double, silhouette double")


def variance_table(model: PipelineModel, spark) -> DataFrame:
    """Explained variance per component and its running total."""
    total, rows = 0.0, []
    for i, share in enumerate(pca_stage(model).explainedVariance, start=1):
        total += float(share)
        rows.append((f"PC{i}", float(share), total))
    return spark.createDataFrame(rows, "component string, explained_variance double, cumulative_variance double")


def contributions(model: PipelineModel, names: list[str], spark) -> DataFrame:
    """Share in percent of every feature in every component, from the squared loadings."""
    loadings = pca_stage(model).pc.toArray() ** 2
    shares = loadings / loadings.sum(axis=0) * 100
    rows = [(f"PC{c + 1}", name, float(shares[i, c])) for c in range(shares.shape[1]) for i, name in enumerate(names)]
    return spark.createDataFrame(rows, "component string, feature string, contribution_pct double")


# --- description of the clusters ---------------------------------------------------------------
def cluster_distribution(clusters: DataFrame) -> DataFrame:
    """Customers and percentage per cluster."""
    counts = clusters.groupBy("cluster").agg(F.countDistinct("customer_id").alias("customers"))
    total = F.sum("customers").over(Window.partitionBy())      # one row per cluster here
    return counts.withColumn("percentage", F.col("customers") / total * 100)


def numeric_profile(features: DataFrame, clusters: DataFrame, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Mean and median of age, score, income, debt and assets per cluster."""
    names = {"age": "Edad", "credit_score": "credit_score", "income_usd": "income_usd", "debt_usd": "Deuda_usd",
             "assets_usd": "Activos_financieros_usd"}
    data = clusters.join(features.select("customer_id", *[F.col(c).cast("double").alias(n) for n, c in names.items()]),
                         "customer_id")
    totals = data.groupBy("cluster").agg(F.countDistinct("customer_id").alias("customers"),
                                         *[F.avg(n).alias(f"mean_{n}") for n in names])
    long = data.unpivot(["cluster"], list(names), "feature", "value")
    medians = exact_quantiles(long, ["cluster", "feature"], "value", {"median": 0.5}, max_group_rows)
    wide = medians.groupBy("cluster").pivot("feature", list(names)).agg(F.first("median"))
    return totals.join(wide.select("cluster", *[F.col(n).alias(f"median_{n}") for n in names]), "cluster")


def segment_share(clusters: DataFrame, segments: DataFrame) -> DataFrame:
    """Percentage of every segment within each cluster, in long form."""
    counts = (clusters.join(segments.select("customer_id", "segment"), "customer_id")
                      .filter(F.col("segment").isNotNull())
                      .groupBy("cluster", "segment").agg(F.count(F.lit(1)).alias("customers")))
    total = F.sum("customers").over(Window.partitionBy("cluster"))   # one row per segment here
    return counts.select("cluster", "segment", (F.col("customers") / total * 100).alias("percentage"))


def segment_crosstab(clusters: DataFrame, segments: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The same as a table with one column per segment."""
    shares = segment_share(clusters, segments)
    table = shares.groupBy("cluster").pivot("segment", names).agg(F.first("percentage"))
    return table.na.fill(0.0)


def baseline_coverage(clusters: DataFrame, behavior: DataFrame) -> DataFrame:
    """Every clustered customer with the behaviour found for it, and whether there was any."""
    joined = clusters.join(behavior, "customer_id", "left")
    return joined.withColumn("has_baseline_activity", F.coalesce(F.col("num_transacciones") > 0, F.lit(False)))


def cluster_activity(clusters: DataFrame, behavior: DataFrame) -> DataFrame:
    """Customers and active customers per cluster, and their ratio."""
    active = behavior.select("customer_id", F.lit(1).alias("_active")).distinct()
    counts = clusters.join(active, "customer_id", "left").groupBy("cluster").agg(
        F.countDistinct("customer_id").alias("total_customers"), F.count("_active").alias("active_customers"))
    return counts.withColumn("active_customer_ratio", F.col("active_customers") / F.col("total_customers"))
