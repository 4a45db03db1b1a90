"""Evaluation of scores against the fraud label on held-out windows.

The label is used here only. Every metric is an aggregation or a running sum, keyed by `window`,
so one window or many windows take the same plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.numbers import DayWindow
from riskloom.operators.scaling import MAX_GROUP_ROWS, latest_rows, running_before, small_side, union_all
from riskloom.session import materialize, materialize_counted

# Rule scores that raise an alert.
RULE_THRESHOLDS = (30, 60)
THRESHOLDS = (1, 2, 3, 4, 5)
REPORT_COLUMNS = ["window", "method", "threshold", "metric", "value"]


def window_labels(transactions: DataFrame, window: DayWindow) -> DataFrame:
    """Per customer in the window: any labelled fraud and the highest model score."""
    inside = transactions.filter(window.contains(F.col("transaction_date"))).select(
        "transaction_id", "transaction_date", "customer_id", "is_fraud", "fraud_score")
    unique = latest_rows(inside, ["transaction_id"], "transaction_date",
                         [F.col("customer_id"), F.col("is_fraud"), F.col("fraud_score")])
    return unique.groupBy("customer_id").agg(F.bool_or(F.coalesce("is_fraud", F.lit(False))).alias("has_fraud"),
                                             F.max("fraud_score").alias("max_fraud_score"))


def pseudo_random(identifier: Column, seed: int) -> Column:
    """A number in [0, 1) fixed by id and seed."""
    digest = F.left(F.md5(F.concat(identifier.cast("string"), F.lit(f"#{seed}"))), F.lit(13))
    return F.conv(digest, 16, 10).cast("double") / float(2**52)


def ranked(data: DataFrame, scores: dict[str, str], weight: str | None = None, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Every row of every window under every score (method -> column), with what ranks before it.

    One table and one sort for all windows and methods, of which every ranking metric is an aggregate. A missing
    score ranks below all others, equal scores go by customer id. Long rankings are scanned in chunks.
    """
    w = F.lit(1.0) if weight is None else F.col(weight)
    methods = F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).cast("double").alias("score")) for m, c in scores.items()])
    long = data.select("window", "customer_id", "has_fraud", w.alias("w"), F.inline(methods))
    hit = F.col("has_fraud")
    ordered, rows = materialize_counted(long.select(
        "window", "method", "customer_id", "has_fraud", F.col("score").isNull().cast("int").alias("missing"),
        F.coalesce(-F.col("score"), F.lit(0.0)).alias("down"), F.when(hit, F.col("w")).otherwise(0.0).alias("pos"),
        F.when(hit, 0.0).otherwise(F.col("w")).alias("neg")), "ranking")
    placed = running_before(ordered, ["window", "method"], [F.col("missing"), F.col("down"), F.col("customer_id")],
                            {"pos": F.col("pos"), "neg": F.col("neg"), "rows": F.lit(1)}, max_group_rows=max_group_rows, rows=rows)
    return materialize(placed, "ranked")


def ranking_of(placed: DataFrame) -> DataFrame:
    """Average precision and ROC-AUC per window and method of a `ranked` table; null when a window has a single
    class. Equal scores form one step."""
    steps = placed.groupBy("window", "method", "missing", "down").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.min("before_pos").alias("before_pos"), F.min("before_neg").alias("before_neg"))
    reached_pos, reached_neg = F.col("before_pos") + F.col("pos"), F.col("before_neg") + F.col("neg")
    totals = steps.groupBy("window", "method").agg(
        F.sum("pos").alias("p"), F.sum("neg").alias("n"),
        F.sum(F.col("pos") * F.try_divide(reached_pos, reached_pos + reached_neg)).alias("_ap"),
        F.sum(F.col("neg") * (F.col("before_pos") + F.col("pos") / 2)).alias("_auc"))
    both = (F.col("p") > 0) & (F.col("n") > 0)
    return totals.select("window", "method",
                         F.when(both, F.bround(F.col("_ap") / F.col("p"), 4)).alias("average_precision"),
                         F.when(both, F.bround(F.col("_auc") / (F.col("p") * F.col("n")), 4)).alias("roc_auc"))


def precision_of(placed: DataFrame, ks: DataFrame) -> DataFrame:
    """Share of fraud among the k highest scores per window and method of a `ranked` table, for rows (window, threshold, k).
    k = 0 gives null."""
    ks, n = materialize_counted(ks, "ranking-sizes")
    methods = placed.select("window", "method").distinct()
    inside = placed.join(small_side(ks, n), "window").filter(F.col("before_rows") < F.col("k"))
    found = inside.groupBy("window", "method", "threshold").agg(
        F.bround(F.avg(F.col("has_fraud").cast("double")), 4).alias("precision_at_k"))
    return ks.join(methods, "window").join(found, ["window", "method", "threshold"], "left").select(
        "window", "method", "threshold", "k", "precision_at_k")


def ranking_metrics(data: DataFrame, score: str, weight: str | None = None, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """`ranking_of` a single score."""
    return ranking_of(ranked(data, {"score": score}, weight, max_group_rows)).drop("method")


def flag_metrics(data: DataFrame, flagged: Column, keys: list[str], weight: str | None = None) -> DataFrame:
    """Flagged, true positives, precision, recall, F1 and lift, optionally weighted."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    flag, hit = F.coalesce(flagged, F.lit(False)), F.col("has_fraud")
    none = F.lit(0.0)
    sums = data.groupBy(*keys).agg(
        F.sum(w).alias("_n"), F.sum(F.when(hit, w).otherwise(none)).alias("_pos"),
        F.sum(F.when(flag, w).otherwise(none)).alias("_flagged"), F.sum(F.when(flag & hit, w).otherwise(none)).alias("_tp"))
    precision = F.coalesce(F.try_divide(F.col("_tp"), F.col("_flagged")), none)
    recall = F.coalesce(F.try_divide(F.col("_tp"), F.col("_pos")), none)
    base = F.try_divide(F.col("_pos"), F.col("_n"))
    rated = sums.withColumns({"_p": precision, "_r": recall, "_base": base})
    f1 = F.coalesce(F.try_divide(F.col("_p") * F.col("_r") * 2, F.col("_p") + F.col("_r")), none)
    return rated.select(*keys, F.bround("_flagged", 0).cast("bigint").alias("flagged"),
                        F.bround("_tp", 0).cast("bigint").alias("true_positives"),
                        F.bround("_p", 4).alias("precision"), F.bround("_r", 4).alias("recall"),
                        F.bround(f1, 4).alias("f1"),
                        F.bround(F.try_divide(F.col("_p"), F.when(F.col("_base") > 0, F.col("_base"))), 2).alias("lift"))


def at_thresholds(data: DataFrame, score: str, thresholds=THRESHOLDS, weight: str | None = None) -> DataFrame:
    """`flag_metrics` of score >= threshold for several thresholds."""
    levels = F.explode(F.array(*[F.lit(t) for t in thresholds]))
    return flag_metrics(data.withColumn("threshold", levels), F.col(score) >= F.col("threshold"),
                        ["window", "threshold"], weight)


def precision_at_k(data: DataFrame, score: str, ks: DataFrame, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """`precision_of` a single score."""
    return precision_of(ranked(data, {"score": score}, None, max_group_rows), ks).drop("method")


def cluster_rank_score() -> Column:
    """Number of suspicious metrics, then the mean deviation as a bounded tie-break."""
    return F.col("n_suspicious") + F.least(F.coalesce("anomaly_score", F.lit(0.0)), F.lit(99.0)) / 100


def evaluation_data(summary: DataFrame, labels: DataFrame, window_name: str, seed: int = 42) -> DataFrame:
    """One row per scored customer with activity: label and the scores that are compared."""
    joined = summary.select("customer_id", "cluster", "anomaly_score", "n_features", "n_suspicious").join(labels, "customer_id")
    return joined.withColumns({
        "window": F.lit(window_name), "cluster_score": cluster_rank_score(),
        "bank_score": F.col("max_fraud_score").cast("double"), "random_score": pseudo_random(F.col("customer_id"), seed)})


def rules_scores(customers: DataFrame, scored: DataFrame, window: DayWindow) -> DataFrame:
    """Highest rule score of each given customer inside the window; 0 without transactions."""
    best = (scored.filter(window.contains(F.col("timestamp"))).groupBy(F.col("customer").alias("customer_id"))
                  .agg(F.max("rule_score").alias("_best")))
    return customers.select("customer_id").join(best, "customer_id", "left").select(
        "customer_id", F.coalesce("_best", F.lit(0)).cast("double").alias("rule_score"))


def weighted_sample(data: DataFrame, negatives: int | None, seed: int = 42) -> DataFrame:
    """All customers with fraud and `negatives` others, which stand for all others by their weight.

    None takes every customer with weight 1. Others are chosen by the hash of id and seed.
    """
    if negatives is None:
        return data.withColumn("weight", F.lit(1.0))
    positive, other = data.filter("has_fraud"), data.filter(~F.col("has_fraud"))
    order = [F.md5(F.concat(F.col("customer_id"), F.lit(f"#{seed}"))), F.col("customer_id")]
    chosen = other.orderBy(*order).limit(negatives)
    total = other.agg(F.count(F.lit(1)).cast("double")).scalar()
    share = total / F.least(total, F.lit(float(negatives)))
    return positive.withColumn("weight", F.lit(1.0)).unionByName(chosen.withColumn("weight", share))


def rules_baseline(sample: DataFrame, scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ranking, threshold metrics) of the rules on a weighted sample."""
    data = materialize(sample.join(scores, "customer_id"), "rules-baseline")
    return ranking_metrics(data, "rule_score", "weight"), at_thresholds(data, "rule_score", RULE_THRESHOLDS, "weight")


def long_rows(frame: DataFrame, method: str | Column, metrics: list[str], threshold: str | None = None) -> DataFrame:
    name = method if isinstance(method, Column) else F.lit(method)
    level = F.lit(None).cast("int") if threshold is None else F.col(threshold).cast("int")
    wide = frame.select("window", name.alias("method"), level.alias("threshold"),
                        *[F.col(m).cast("double").alias(m) for m in metrics])
    return wide.unpivot(["window", "method", "threshold"], metrics, "metric", "value")


FLAG_METRICS = ["flagged", "true_positives", "precision", "recall", "f1", "lift"]


def report_rows(data: DataFrame, with_random: bool = True) -> DataFrame:
    """(window, method, threshold, metric, value) of all methods. `data` should be a written table."""
    counts = data.groupBy("window").agg(F.count(F.lit(1)).alias("customers"),
                                        F.count_if("has_fraud").alias("positives"),
                                        F.bround(F.avg(F.col("has_fraud").cast("double")), 5).alias("base_rate"))
    flags = materialize(at_thresholds(data, "n_suspicious"), "flags")
    methods = {"cluster_model": "cluster_score", "fraud_score": "bank_score"}
    if with_random:
        methods["random"] = "random_score"
    placed = ranked(data, methods)
    parts = [long_rows(counts, "data", ["customers", "positives", "base_rate"]),
             long_rows(flags, "cluster_model", FLAG_METRICS, "threshold"),
             long_rows(ranking_of(placed), F.col("method"), ["average_precision", "roc_auc"])]
    if with_random:
        ks = flags.select("window", "threshold", F.col("flagged").alias("k"))
        found = precision_of(placed.filter("method <> 'cluster_model'"), ks)
        parts.append(long_rows(found, F.col("method"), ["precision_at_k"], "threshold"))
    return union_all(parts).select(*REPORT_COLUMNS)


def sample_rows(sample: DataFrame) -> DataFrame:
    """Report rows with the sizes of the weighted sample that the rules were evaluated on."""
    sizes = sample.groupBy("window").agg(F.count(F.lit(1)).alias("sample_customers"), F.count_if(~F.col("has_fraud")).alias("sampled_negatives"))
    return long_rows(sizes, "rules", ["sample_customers", "sampled_negatives"])


def pooled(data: DataFrame) -> DataFrame:
    """All windows as one."""
    return data.withColumn("window", F.lit("pooled"))
