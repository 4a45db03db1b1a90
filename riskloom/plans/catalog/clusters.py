"""Clustering, compared with SQL by what must hold for any fit, and descriptions of given clusters."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from riskloom.functions.numbers import history_window
from riskloom.operators import clustering as K
from riskloom.operators import fingerprints as prints
from riskloom.plans import lifecycle as L
from riskloom.plans.bridge import BankTables
from riskloom.plans.catalog.behavior import recent_behavior
from riskloom.plans.catalog.common import AS_OF, BASELINE, RECENT, inside
from riskloom.plans.catalog.features import feature_rows
from riskloom.plans.catalog.registry import query, rounded, view
from riskloom.plans.catalog.sources import scratch
from riskloom.session import small_table
from riskloom.sources.tables import customers_latest


def preprocessed(t: BankTables):
    features = feature_rows(t)
    model = K.fit_preprocessor(features)
    return features, model, model.transform(features)


def fitted(t: BankTables):
    features = feature_rows(t)
    return features, K.fit_customer_clusters(features, checked=True)


@query("ml_log_scale", """
SELECT customer_id, (ln(1 + credit_score) - avg(ln(1 + credit_score)) OVER ()) / stddev_pop(ln(1 + credit_score)) OVER () AS credit_score,
       (ln(1 + income_usd) - avg(ln(1 + income_usd)) OVER ()) / stddev_pop(ln(1 + income_usd)) OVER () AS income_usd,
       (ln(1 + "Deuda_usd") - avg(ln(1 + "Deuda_usd")) OVER ()) / stddev_pop(ln(1 + "Deuda_usd")) OVER () AS debt_usd,
       (ln(1 + "Activos_financieros_usd") - avg(ln(1 + "Activos_financieros_usd")) OVER ())
       / stddev_pop(ln(1 + "Activos_financieros_usd")) OVER () AS assets_usd FROM customer_features""",
       rounds=["credit_score", "income_usd", "debt_usd", "assets_usd"])
def ml_log_scale(t: BankTables):
    _, _, rows = preprocessed(t)
    scaled = vector_to_array("numeric_scaled")
    names = ["credit_score", "income_usd", "debt_usd", "assets_usd"]
    return rounded(rows.select("customer_id", *[scaled[i].alias(n) for i, n in enumerate(names)]))


@query("ml_scale", """
SELECT customer_id, ("Edad" - avg("Edad") OVER ()) / stddev_pop("Edad") OVER () AS age FROM customer_features""", rounds=["age"])
def ml_scale(t: BankTables):
    _, _, rows = preprocessed(t)
    return rounded(rows.select("customer_id", vector_to_array("numeric_scaled")[len(K.LOG_COLUMNS)].alias("age")))


EDUCATION = ["(missing)", "Posgrado", "Primaria", "Secundaria", "Universitaria"]


@query("ml_one_hot", "SELECT customer_id, " + ", ".join(
    f"(coalesce(education_level, '(missing)') = '{e}')::INT::DOUBLE AS education_{i}" for i, e in enumerate(EDUCATION))
       + " FROM customer_features")
def ml_one_hot(t: BankTables):
    _, _, rows = preprocessed(t)
    hot = vector_to_array("hot_education_level")
    return rows.select("customer_id", *[hot[i].alias(f"education_{i}") for i in range(len(EDUCATION))])


@query("ml_preprocessor", """
SELECT count(*) AS customers, 5 + count(DISTINCT country) + count(DISTINCT coalesce(education_level, '(missing)')) AS width
FROM customer_features""")
def ml_preprocessor(t: BankTables):
    features, model, rows = preprocessed(t)
    sizes = rows.select(F.size(vector_to_array("features")).alias("n"))
    return sizes.groupBy().agg(F.count(F.lit(1)).alias("customers"), F.max("n").cast("bigint").alias("width"))


def point_rows(rows, *extra):
    """The components of every row as columns x0, x1, ..."""
    wide = rows.select(*extra, vector_to_array("components").alias("x"))
    width = wide.select(F.max(F.size("x"))).first()[0]
    return wide.select(*extra, *[F.col("x")[i].alias(f"x{i}") for i in range(width)]), [f"x{i}" for i in range(width)]


# Every scaled number has variance 1 and a category with share p has p(1-p), which the components only turn.
@query("ml_pca", """
SELECT customers, width, 5 + (SELECT sum(p * (1 - p)) FROM (
  SELECT count(*) / (SELECT count(*) FROM customer_features) AS p FROM customer_features GROUP BY country
  UNION ALL SELECT count(*) / (SELECT count(*) FROM customer_features) FROM customer_features GROUP BY education_level) c) AS total_variance,
  true AS uncorrelated, true AS descending
FROM (SELECT count(*) AS customers, 5 + count(DISTINCT country) + count(DISTINCT coalesce(education_level, '(missing)')) AS width FROM customer_features) f""",
       rounds=["total_variance"])
def ml_pca(t: BankTables):
    """All components of the features: together they have the variance of the features, each is apart from the others."""
    _, model, rows = preprocessed(t)
    width = len(K.feature_names(model))
    points, names = point_rows(K.fit_pca(rows, width, width).transform(rows))
    far = [F.abs(F.covar_pop(a, b)) for i, a in enumerate(names) for b in names[:i]]
    spread = [F.var_pop(n) for n in names]
    found = points.agg(F.count(F.lit(1)).alias("customers"), sum(spread[1:], spread[0]).alias("total_variance"), F.greatest(*far).alias("far"),
                       F.forall(F.array(*[b - a for a, b in zip(spread, spread[1:])]), lambda d: d < 1e-9).alias("descending"))
    return rounded(found.select("customers", F.lit(width).cast("bigint").alias("width"), "total_variance", (F.col("far") < 1e-6).alias("uncorrelated"), "descending"))


@query("ml_kmeans", """
SELECT count(*) AS customers, 3 AS clusters, true AS centres_are_means, true AS ordered FROM customer_features""")
def ml_kmeans(t: BankTables):
    """Every centre is the mean of its customers, and clusters are numbered by their centres."""
    features, model = fitted(t)
    points, names = point_rows(model.transform(features), "raw_cluster", "cluster")
    means = points.groupBy("raw_cluster", "cluster").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(n) for n in names]).alias("mean"))
    centres = small_table(t.spark, [(i, [float(x) for x in c]) for i, c in enumerate(model.stages[-2].clusterCenters())],
                          "raw_cluster int, centre array<double>")
    met = means.join(centres, "raw_cluster").withColumn("off", F.array_max(F.transform(F.arrays_zip("mean", "centre"), lambda p: F.abs(p["mean"] - p["centre"]))))
    by_number = F.array_sort(F.collect_list(F.struct("cluster", "centre")))
    return met.agg(F.sum("n").alias("customers"), F.count(F.lit(1)).cast("int").alias("clusters"), (F.max("off") < 1e-4).alias("centres_are_means"),
                   (F.transform(by_number, lambda r: r["centre"]) == F.array_sort(F.collect_list("centre"))).alias("ordered"))


@query("assign_clusters", "SELECT customer_id, true AS nearest FROM customer_features")
def assign_clusters(t: BankTables):
    """The cluster of every customer is that of the nearest centre."""
    features, model = fitted(t)
    assigned = K.assign_clusters(model, features, checked=True)
    points, names = point_rows(model.transform(features), "customer_id")
    centres = sorted(tuple(map(float, c)) for c in model.stages[-2].clusterCenters())
    far = [sum((F.pow(F.col(n) - x, 2) for n, x in zip(names, c)), F.lit(0.0)) for c in centres]
    least = F.array_position(F.array(*far), F.least(*far)) - 1
    return points.join(assigned, "customer_id").select("customer_id", (F.col("cluster") == least).alias("nearest"))


@query("k_sweep", """
SELECT k::INT AS k, true AS falls, true AS below_total, true AS in_range FROM range(2, 11) r(k)""")
def k_sweep(t: BankTables):
    """More clusters leave less distance, which never exceeds that to one common centre."""
    _, model, rows = preprocessed(t)
    points = K.fit_pca(rows, K.N_COMPONENTS, len(K.feature_names(model))).transform(rows).select("components")
    wide, names = point_rows(points)
    total = wide.agg(sum((F.var_pop(n) for n in names[1:]), F.var_pop(names[0])) * F.count(F.lit(1))).scalar()
    before = F.lag("inertia").over(Window.orderBy("k"))
    return K.k_sweep(points).select("k", F.coalesce(F.col("inertia") < before, F.lit(True)).alias("falls"), (F.col("inertia") < total).alias("below_total"),
                                    F.col("silhouette").between(0.0, 1.0).alias("in_range"))


@query("pca_variance_table", "SELECT 'PC' || (i + 1) AS component, true AS adds_up, true AS is_share FROM range(6) r(i)")
def pca_variance_table(t: BankTables):
    """The share of each component is its variance over that of all features."""
    features = feature_rows(t)
    model = K.fit_components(features)
    rows = model.transform(features)
    points, names = point_rows(rows)
    whole, all_names = point_rows(rows.select(F.col("features").alias("components")))
    total = whole.agg(sum((F.var_pop(n) for n in all_names[1:]), F.var_pop(all_names[0])).alias("v")).first()["v"]
    shares = points.agg(*[(F.var_pop(n) / total).alias(f"PC{i + 1}") for i, n in enumerate(names)]).unpivot([], [f"PC{i + 1}" for i in range(len(names))], "component", "own")
    upto = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)
    return K.variance_table(model, t.spark).join(shares, "component").select(
        "component", (F.abs(F.col("cumulative_variance") - F.sum("explained_variance").over(upto)) < 1e-9).alias("adds_up"),
        (F.abs(F.col("explained_variance") - F.col("own")) < 1e-6).alias("is_share"))


@query("pca_contributions", """
SELECT 'PC' || (i + 1) AS component, 5 + (SELECT count(DISTINCT country) + count(DISTINCT coalesce(education_level, '(missing)')) FROM customer_features) AS features,
       100.0::DOUBLE AS total FROM range(6) r(i)""", rounds=["total"])
def pca_contributions(t: BankTables):
    model = K.fit_components(feature_rows(t))
    shares = K.contributions(model, K.feature_names(model), t.spark)
    return rounded(shares.groupBy("component").agg(F.countDistinct("feature").alias("features"), F.sum("contribution_pct").alias("total")))


@query("cluster_distribution", """
SELECT cluster, count(DISTINCT customer_id) AS customers, count(DISTINCT customer_id) / sum(count(DISTINCT customer_id)) OVER () * 100
       AS percentage FROM clusters GROUP BY cluster""", rounds=["percentage"])
def cluster_distribution(t: BankTables):
    return rounded(K.cluster_distribution(t.clusters))


NUMERIC = {"age": "Edad", "credit_score": "credit_score", "income_usd": "income_usd", "debt_usd": "Deuda_usd",
           "assets_usd": "Activos_financieros_usd"}


@query("cluster_numeric_profile", "SELECT cluster, count(DISTINCT customer_id) AS customers, " + ", ".join(
    [f'avg("{c}") AS mean_{n}' for n, c in NUMERIC.items()] + [f'quantile_cont("{c}"::DOUBLE, 0.5) AS median_{n}' for n, c in NUMERIC.items()])
       + " FROM clusters JOIN customer_features USING (customer_id) GROUP BY cluster",
       rounds=[f"{s}_{n}" for s in ("mean", "median") for n in NUMERIC], digits=4)
def cluster_numeric_profile(t: BankTables):
    return rounded(K.numeric_profile(feature_rows(t), t.clusters), 4)


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("segment_crosstab", "SELECT cluster, " + ", ".join(
    f"count(*) FILTER (WHERE segment = '{s}') / count(segment) * 100 AS \"{s}\"" for s in SEGMENTS)
       + " FROM clusters JOIN customers_newest USING (customer_id) GROUP BY cluster", rounds=SEGMENTS)
def segment_crosstab(t: BankTables):

    return rounded(K.segment_crosstab(t.clusters, customers_latest(t.customers), SEGMENTS))


@query("baseline_coverage", """
SELECT customer_id, cluster, b.num_transacciones, coalesce(b.num_transacciones > 0, false) AS has_baseline_activity
FROM clusters LEFT JOIN baseline_behavior b USING (customer_id)""")
def baseline_coverage(t: BankTables):
    rows = K.baseline_coverage(t.clusters, recent_behavior(t, BASELINE))
    return rows.select("customer_id", "cluster", "num_transacciones", "has_baseline_activity")


@query("cluster_activity", """
SELECT cluster, count(DISTINCT customer_id) AS total_customers, count(b.num_transacciones) AS active_customers,
       count(b.num_transacciones) / count(DISTINCT customer_id) AS active_customer_ratio
FROM clusters LEFT JOIN recent_behavior b USING (customer_id) GROUP BY cluster""", rounds=["active_customer_ratio"])
def cluster_activity(t: BankTables):
    return rounded(K.cluster_activity(t.clusters, recent_behavior(t, RECENT)))


FINGERPRINTED = ['channel', 'currency', 'customer_id', 'product_id', 'transaction_id', 'transaction_status']
_ROW = " || ".join(f"coalesce(length({c})::VARCHAR || ':' || {c}, '~')" for c in FINGERPRINTED)
_LANES = ", ".join(f"sum(('0x' || substr(d, {1 + 8 * i}, 8))::BIGINT)::HUGEINT AS lane{i}" for i in range(8))


@query("fingerprint", f"""
SELECT substr(sha256(concat_ws('#', n, {", ".join(f"lane{i}" for i in range(8))})), 1, 16) AS fingerprint
FROM (SELECT count(*) AS n, {_LANES} FROM (SELECT sha256({_ROW}) AS d FROM transactions) h) s""")
def fingerprint(t: BankTables):
    """The sums of two parts added up, after rows that were added by mistake are taken away."""
    rows = t.transactions.select(*FINGERPRINTED)
    odd = F.col("transaction_id").endswith("7")
    sums = prints.combined(prints.content_sums(rows.filter(odd)), prints.content_sums(rows), prints.content_sums(rows.filter(~odd)))
    return prints.fingerprint_of(prints.without(sums, prints.content_sums(rows)))


def inputs(t: BankTables) -> L.BankInputs:
    return L.BankInputs(t.customers, t.products, t.transactions)


view("early_active", f"""
SELECT DISTINCT customer_id FROM transactions WHERE {inside(history_window("2024-01-20"))} AND customer_id IN (SELECT customer_id FROM customer_features)
  AND amount IS NOT NULL AND currency IS NOT NULL AND transaction_status IN ('Approved', 'Declined', 'Pending', 'Reversed')""")


@query("train_run", """
SELECT count(*) AS customers, 3 AS clusters, (SELECT count(*) FROM early_active) AS active, 54 AS profiles, true AS quartiles_ordered FROM customer_features""")
def train_run(t: BankTables):
    """What a training run records, against the tables; profiles are three clusters by eighteen metrics."""
    model = L.train(inputs(t), "2024-01-20")
    m = model.metadata
    ordered = (F.col("p25") <= F.col("median")) & (F.col("median") <= F.col("p75")) & (F.col("p75") <= F.col("p95")) & (F.col("mad") >= 0)
    return model.profiles.agg(F.lit(sum(m["cluster_sizes"].values())).cast("bigint").alias("customers"), F.countDistinct("cluster").cast("int").alias("clusters"),
                              F.lit(m["n_customers_with_activity"]).cast("bigint").alias("active"), F.count(F.lit(1)).cast("int").alias("profiles"),
                              F.bool_and(F.coalesce(ordered, F.lit(True))).alias("quartiles_ordered"))


def same_scores(a: Column, b: Column) -> Column:
    """Equal but for the order of additions. Rounding first would tell two scores apart that lie on either side of a
    half, however close they are."""
    exact = [a[n].eqNullSafe(b[n]) for n in ("cluster", "n_suspicious", "suspicious_features")]
    x, y = a["anomaly_score"], b["anomaly_score"]
    close = x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= F.greatest(F.lit(1.0), F.abs(x)) * 1e-9, F.lit(False))
    return exact[0] & exact[1] & exact[2] & close


@query("model_store", """
SELECT customer_id, 5 AS n_features, true AS same FROM recent_behavior WHERE customer_id IN (SELECT customer_id FROM customer_features)""")
def model_store(t: BankTables):
    """Train, save, find the newest, load it and score the days after the training, as the model in memory does."""
    models = scratch(t, "models")
    trained = L.train(inputs(t), "2024-01-20")
    L.save_model(trained, models)
    loaded = L.load_model(t.spark, L.latest_model_folder(t.spark, models))
    fresh, stored = (L.score_as_of(inputs(t), m, AS_OF, recent_days=7).summary.select("customer_id", "n_features", F.struct(
        "cluster", "anomaly_score", "n_suspicious", "suspicious_features").alias("found")) for m in (trained, loaded))
    return stored.join(fresh.select("customer_id", F.col("found").alias("other")), "customer_id").select(
        "customer_id", "n_features", same_scores(F.col("found"), F.col("other")).alias("same"))
