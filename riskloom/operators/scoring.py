"""Robust profiles per cluster and the deviation of each customer's recent behaviour from them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.contracts import BEHAVIOR_SCORES, CLUSTER_PROFILES, CUSTOMER_SCORES, validate, write_valid
from riskloom.operators.scaling import MAX_GROUP_ROWS, exact_quantiles, oversized_groups
from riskloom.session import materialize, materialize_counted

# Scored metrics, limit of a usual deviation, and factors from MAD and IQR to a
# standard deviation.
SCORED_METRICS = ["num_transacciones_monthly", "monto_total_usd_monthly", "monto_promedio_usd", "monto_mediano_usd",
                  "monto_maximo_usd"]
SUSPICIOUS_DEVIATION = 3.0
MAD_TO_STD, IQR_TO_STD = 1.4826, 1.349
DEFAULT_MIN_SUSPICIOUS = 4

QUARTILES = {"median": 0.5, "p25": 0.25, "p75": 0.75, "p95": 0.95}
PROFILE_COLUMNS = ["cluster", "feature", "count", "mean", "median", "p25", "p75", "p95", "mad"]
DETAIL_COLUMNS = ["customer_id", "cluster", "feature", "value", "cluster_median", "cluster_p25", "cluster_p75",
                  "deviation_score", "is_suspicious"]


def long_behavior(behavior: DataFrame, clusters: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(customer_id, cluster, feature, value) for the customers with a cluster and with activity."""
    present = [m for m in metrics if m in behavior.columns]
    wide = clusters.select("customer_id", "cluster").join(
        behavior.select("customer_id", *[F.col(m).cast("double").alias(m) for m in present]), "customer_id")
    return wide.unpivot(["customer_id", "cluster"], present, "feature", "value")


def cluster_profiles(behavior: DataFrame, clusters: DataFrame, metrics: Sequence[str],
                     max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Count, mean, median, quartiles, p95 and MAD of each metric per cluster.

    There are only a few clusters, so each group grows with the customers: the long table is
    written once and groups beyond `max_group_rows` get their quantiles by rank.
    """
    keys = ["cluster", "feature"]
    values = long_behavior(behavior, clusters, metrics).filter(F.col("value").isNotNull()).drop("customer_id")
    values, rows = materialize_counted(values, "profile-values")
    large, _ = oversized_groups(values, keys, max_group_rows, rows)
    totals = {"count": F.count(F.lit(1)), "mean": F.avg("value")}
    if large is None:
        totals |= {n: F.percentile("value", F.lit(p)) for n, p in QUARTILES.items()}
    centers = values.groupBy(*keys).agg(*[c.alias(n) for n, c in totals.items()])
    if large is not None:
        centers = centers.join(exact_quantiles(values, keys, "value", QUARTILES, max_group_rows), keys)
    # One row per cluster and metric: small by construction.
    centers = materialize(centers, "profile-centers")
    distances = values.join(F.broadcast(centers.select(*keys, "median")), keys).select(
        *keys, F.abs(F.col("value") - F.col("median")).alias("distance"))
    spread = exact_quantiles(distances, keys, "distance", {"mad": 0.5}, max_group_rows, rows)
    return write_valid(centers.join(spread, keys).select(*PROFILE_COLUMNS), CLUSTER_PROFILES, "profiles")[0]


def robust_deviation(value: Column, median: Column, mad: Column, p25: Column, p75: Column) -> Column:
    """Distance from the median in robust standard deviations: by the MAD, else by the IQR.

    Without any spread an equal value gives 0 and a different one infinity; null gives null.
    """
    distance, iqr = F.abs(value - median), p75 - p25
    return (F.when(value.isNull(), F.lit(None).cast("double"))
             .when(mad > 0, distance / (mad * MAD_TO_STD))
             .when(iqr > 0, distance / (iqr / IQR_TO_STD))
             .when(value == median, F.lit(0.0))
             .otherwise(F.lit(math.inf)))


def score_detail(behavior: DataFrame, clusters: DataFrame, profiles: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row per customer and metric that has a profile.

    The profiles hold one row per cluster and metric, so their join is always a broadcast.
    """
    references = profiles.select("cluster", "feature", F.col("median").alias("cluster_median"),
                                 F.col("p25").alias("cluster_p25"), F.col("p75").alias("cluster_p75"), "mad")
    joined = long_behavior(behavior, clusters, metrics).join(F.broadcast(references), ["cluster", "feature"])
    deviation = robust_deviation(F.col("value"), F.col("cluster_median"), F.col("mad"), F.col("cluster_p25"),
                                 F.col("cluster_p75"))
    scored = joined.withColumn("deviation_score", deviation)
    return scored.withColumn("is_suspicious", F.coalesce(F.col("deviation_score") >= SUSPICIOUS_DEVIATION, F.lit(False))
                             ).select(*DETAIL_COLUMNS)


def score_summary(detail: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean finite deviation, number of metrics and the suspicious ones in metric order.

    Each customer has one row per metric, so the collected list is as short as the metrics.
    """
    position = F.array_position(F.lit(list(metrics)), F.col("feature"))
    finite = F.when(F.col("deviation_score") < F.lit(math.inf), F.col("deviation_score"))
    flagged = F.collect_list(F.when(F.col("is_suspicious"), F.struct(position.alias("at"), "feature")))
    return (detail.groupBy("customer_id", "cluster").agg(
        F.avg(finite).alias("anomaly_score"), F.count(F.lit(1)).cast("int").alias("n_features"),
        F.count_if("is_suspicious").cast("int").alias("n_suspicious"), flagged.alias("_flagged"))
        .withColumn("suspicious_features", F.transform(F.array_sort("_flagged"), lambda f: f["feature"]))
        .drop("_flagged"))


def score_customers(behavior: DataFrame, clusters: DataFrame, profiles: DataFrame, metrics: Sequence[str]
                    ) -> tuple[DataFrame, DataFrame]:
    """(detail, summary) with their contracts; the detail is written once for both."""
    validate(profiles, CLUSTER_PROFILES)
    detail, _ = write_valid(score_detail(behavior, clusters, profiles, metrics), BEHAVIOR_SCORES, "score-detail", known_unique=False)
    summary, _ = write_valid(score_summary(detail, metrics), CUSTOMER_SCORES, "score-summary", known_unique=False)
    return detail, summary


def queue_score() -> Column:
    """Share of the metrics that are suspicious."""
    return F.col("n_suspicious") / F.col("n_features")


def flagged_customers(summary: DataFrame, min_suspicious: int = DEFAULT_MIN_SUSPICIOUS) -> DataFrame:
    return summary.filter(F.col("n_suspicious") >= min_suspicious).withColumn("anomaly_score", queue_score())


def run_summary(summary: DataFrame) -> DataFrame:
    """How many customers have each number of suspicious metrics."""
    return summary.groupBy("n_suspicious").agg(F.count(F.lit(1)).alias("customers"))


def unusual_behavior(behavior: DataFrame, clusters: DataFrame, profiles: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """The exploratory form of the scores: every metric, flag `is_unusual`, and the overall mean."""
    detail = score_detail(behavior, clusters, profiles, metrics).withColumnRenamed("is_suspicious", "is_unusual")
    finite = F.when(F.col("deviation_score") < F.lit(math.inf), F.col("deviation_score"))
    return detail.groupBy("customer_id", "cluster").agg(
        F.count(F.lit(1)).alias("n_features"), F.count_if("is_unusual").alias("n_unusual"),
        F.avg(finite).alias("overall_score"))
