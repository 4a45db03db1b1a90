"""Evaluation of scores against the label."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from riskloom.operators import evaluation as V
from riskloom.operators import scoring as S
from riskloom.operators.analysis import monitor_high_risk
from riskloom.operators.behavior import dedup_transactions
from riskloom.operators.scaling import union_all
from riskloom.plans import lifecycle as L
from riskloom.plans.bridge import BankTables
from riskloom.plans.catalog.behavior import recent_behavior
from riskloom.plans.catalog.clusters import inputs
from riskloom.plans.catalog.common import AS_OF, EARLIER, HELD_OUT_DAYS, LATER, RECENT, SCORED, inside
from riskloom.plans.catalog.registry import query, rounded, view
from riskloom.plans.catalog.rules import SETTINGS, analysed, scored
from riskloom.plans.catalog.scores import profiles, summary
from riskloom.plans.catalog.sources import scratch
from riskloom.session import materialize
from riskloom.sinks import append_audit, audit_records, write_report
from riskloom.sources.logical import product_labels

view("window_labels", f"""
SELECT customer_id, bool_or(coalesce(is_fraud, false)) AS has_fraud, max(fraud_score) AS max_fraud_score
FROM (SELECT * FROM transactions WHERE {inside(RECENT)}
      QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY transaction_date DESC) = 1) GROUP BY customer_id""")
RANDOM = "('0x' || left(md5({0} || '#42'), 13))::BIGINT / 4503599627370496.0"
view("evaluated", f"""
SELECT '{AS_OF}' AS window, s.*, l.has_fraud, l.max_fraud_score AS bank_score,
       s.n_suspicious + least(coalesce(s.anomaly_score, 0), 99) / 100 AS cluster_score, {RANDOM.format('customer_id')} AS random_score
FROM score_summary s JOIN window_labels l USING (customer_id)""")


def evaluated(t: BankTables):
    labels = V.window_labels(t.transactions, RECENT)
    return materialize(V.evaluation_data(summary(t), labels, AS_OF), "evaluated")


@query("window_labels", "SELECT * FROM window_labels")
def window_labels(t: BankTables):
    return V.window_labels(t.transactions, RECENT)


# Ranking metrics over single transactions: a window per country and a score with many equal values and some nulls.
view("ranked_transactions", """
SELECT transaction_country AS window, transaction_id AS customer_id, is_fraud AS has_fraud,
       CASE WHEN fraud_score < 10 THEN NULL ELSE floor(fraud_score / 3) + amount / 1000 END AS score, 1.0 + (coalesce(fraud_score, 0) % 3) AS weight
FROM transactions QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY transaction_date DESC) = 1""")


def ranked_transactions(t: BankTables):
    score = F.when(F.col("fraud_score") >= 10, F.floor(F.col("fraud_score") / 3) + F.col("amount") / 1000)
    rows = dedup_transactions(t.transactions).select(
        F.col("transaction_country").alias("window"), F.col("transaction_id").alias("customer_id"),
        F.col("is_fraud").alias("has_fraud"), score.alias("score"), (F.coalesce("fraud_score", F.lit(0.0)) % 3 + 1.0).alias("weight"))
    return materialize(rows, "ranked")


def ranking_sql(source: str, score: str, weight: str = "1.0") -> str:
    """Average precision and ROC-AUC of each window."""
    return f"""
SELECT "window", round_even(sum(pos * reached_pos / (reached_pos + reached_neg)) / sum(pos), 4) AS average_precision,
       round_even(sum(neg * (reached_pos - pos / 2)) / (sum(pos) * sum(neg)), 4) AS roc_auc
FROM (SELECT *, sum(pos) OVER w AS reached_pos, sum(neg) OVER w AS reached_neg FROM (
        SELECT "window", {score} AS step, sum(CASE WHEN has_fraud THEN {weight} ELSE 0.0 END)::DOUBLE AS pos,
               sum(CASE WHEN has_fraud THEN 0.0 ELSE {weight} END)::DOUBLE AS neg FROM {source} GROUP BY ALL) g
      WINDOW w AS (PARTITION BY "window" ORDER BY step DESC NULLS LAST)) c
GROUP BY "window" """


@query("average_precision", f"SELECT \"window\", average_precision FROM ({ranking_sql('ranked_transactions', 'score', 'weight')}) r")
def average_precision(t: BankTables):
    return V.ranking_metrics(ranked_transactions(t), "score", "weight").select("window", "average_precision")


@query("roc_auc", f"SELECT \"window\", roc_auc FROM ({ranking_sql('ranked_transactions', 'score', 'weight')}) r")
def roc_auc(t: BankTables):
    return V.ranking_metrics(ranked_transactions(t), "score", "weight").select("window", "roc_auc")


def flags_sql(source: str, score: str, thresholds, weight: str = "1.0") -> str:
    """Flag metrics at several thresholds."""
    rows = " UNION ALL ".join(f"SELECT *, {x} AS threshold, coalesce({score} >= {x}, false) AS flag, {weight} AS w FROM {source}"
                              for x in thresholds)
    return f"""
SELECT "window", threshold, round_even(flagged, 0)::BIGINT AS flagged, round_even(tp, 0)::BIGINT AS true_positives,
       round_even(p, 4) AS precision, round_even(r, 4) AS recall, round_even(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1,
       round_even(p / nullif(positives / n, 0), 2) AS lift
FROM (SELECT *, coalesce(tp / nullif(flagged, 0), 0) AS p, coalesce(tp / nullif(positives, 0), 0) AS r FROM (
  SELECT "window", threshold, sum(w)::DOUBLE AS n, coalesce(sum(w) FILTER (WHERE has_fraud), 0)::DOUBLE AS positives,
         coalesce(sum(w) FILTER (WHERE flag), 0)::DOUBLE AS flagged, coalesce(sum(w) FILTER (WHERE flag AND has_fraud), 0)::DOUBLE AS tp
  FROM ({rows}) x GROUP BY "window", threshold) s) m"""


@query("flag_metrics", flags_sql("ranked_transactions", "score", (5, 15, 25, 32), "weight"))
def flag_metrics(t: BankTables):
    return V.at_thresholds(ranked_transactions(t), "score", (5, 15, 25, 32), "weight")


view("top_sizes", """SELECT DISTINCT transaction_country AS "window", unnest([1, 2, 3]) AS threshold FROM transactions""")
K_CASE = "CASE threshold WHEN 1 THEN 0 WHEN 2 THEN 10 ELSE 40 END"


@query("precision_at_k", f"""
SELECT "window", threshold, {K_CASE} AS k, (SELECT round_even(avg(has_fraud::INT), 4) FROM (
  SELECT *, row_number() OVER (PARTITION BY "window" ORDER BY score DESC NULLS LAST, customer_id) AS nth FROM ranked_transactions) r
  WHERE r."window" = s."window" AND nth <= {K_CASE}) AS precision_at_k FROM top_sizes s""")
def precision_at_k(t: BankTables):
    rows = ranked_transactions(t)
    sizes = F.explode(F.array(*[F.struct(F.lit(i).alias("threshold"), F.lit(k).alias("k")) for i, k in ((1, 0), (2, 10), (3, 40))]))
    ks = rows.select("window").distinct().select("window", sizes.alias("s")).select("window", "s.threshold", "s.k")
    return V.precision_at_k(rows, "score", ks)


@query("cluster_rank_score", "SELECT customer_id, n_suspicious + least(coalesce(anomaly_score, 0), 99) / 100 AS score FROM score_summary",
       rounds=["score"])
def cluster_rank_score(t: BankTables):
    return rounded(summary(t).select("customer_id", V.cluster_rank_score().alias("score")))


view("best_rule_scores", f"""
SELECT e.customer_id, coalesce(max(s.rule_score), 0)::DOUBLE AS rule_score FROM evaluated e
LEFT JOIN (SELECT * FROM scored_tx WHERE {inside(RECENT, 'timestamp')}) s ON s.customer = e.customer_id GROUP BY e.customer_id""")


@query("rules_scores", "SELECT * FROM best_rule_scores")
def rules_scores(t: BankTables):
    return V.rules_scores(evaluated(t), scored(t), RECENT)


NEGATIVES = 20
view("weighted_sample", f"""
SELECT *, 1.0 AS weight FROM evaluated WHERE has_fraud UNION ALL
SELECT * FROM (SELECT *, (SELECT count(*) FROM evaluated WHERE NOT has_fraud) / {NEGATIVES}.0 AS weight FROM evaluated WHERE NOT has_fraud
               ORDER BY md5(customer_id || '#42'), customer_id LIMIT {NEGATIVES})""")
view("rules_sample", "SELECT * FROM weighted_sample JOIN best_rule_scores USING (customer_id)")
view("rules_everyone", "SELECT *, 1.0 AS weight FROM evaluated JOIN best_rule_scores USING (customer_id)")


def _rules(t: BankTables, negatives):
    rows = evaluated(t)
    sample = V.weighted_sample(rows, negatives)
    ranking, levels = V.rules_baseline(sample, V.rules_scores(rows, scored(t), RECENT))
    return levels.join(ranking, "window")


def _rules_sql(source: str) -> str:
    return f"""SELECT * FROM ({flags_sql(source, 'rule_score', (30, 60), 'weight')}) f
JOIN ({ranking_sql(source, 'rule_score', 'weight')}) r USING ("window")"""


@query("rules_baseline", _rules_sql("rules_sample"))
def rules_baseline(t: BankTables):
    return _rules(t, NEGATIVES)


@query("rules_baseline_all", _rules_sql("rules_everyone"))
def rules_baseline_all(t: BankTables):
    return _rules(t, None)


def long_sql(body: str, method: str, metrics, threshold: str = "NULL") -> str:
    return " UNION ALL ".join(f"SELECT \"window\", '{method}' AS method, {threshold}::INT AS threshold, '{m}' AS metric, {m}::DOUBLE AS value FROM ({body}) q"
                              for m in metrics)


def report_sql(source: str, with_random: bool = True) -> str:
    counts = f"""SELECT "window", count(*) AS customers, count(*) FILTER (WHERE has_fraud) AS positives,
                 round_even(avg(has_fraud::INT), 5) AS base_rate FROM {source} GROUP BY "window" """
    flags = flags_sql(source, "n_suspicious", (1, 2, 3, 4, 5))
    parts = [long_sql(counts, "data", ["customers", "positives", "base_rate"]), long_sql(flags, "cluster_model", V.FLAG_METRICS, "threshold")]
    methods = {"cluster_model": "cluster_score", "fraud_score": "bank_score", "random": "random_score"}
    for method, column in methods.items():
        if with_random or method != "random":
            parts.append(long_sql(ranking_sql(source, column), method, ["average_precision", "roc_auc"]))
    for method in ("fraud_score", "random") if with_random else ():
        top = f"""SELECT f."window", f.threshold, round_even(avg(CASE WHEN nth <= f.flagged THEN r.has_fraud::INT END), 4) AS precision_at_k
                  FROM ({flags}) f JOIN (SELECT *, row_number() OVER (PARTITION BY "window" ORDER BY {methods[method]} DESC NULLS LAST, customer_id)
                  AS nth FROM {source}) r USING ("window") GROUP BY ALL"""
        parts.append(long_sql(top, method, ["precision_at_k"], "threshold"))
    return " UNION ALL ".join(parts)


@query("evaluate_window", report_sql("evaluated"))
def evaluate_window(t: BankTables):
    return V.report_rows(evaluated(t))


# Two held-out windows, each with its own scores and labels.
for _name, _window in (("earlier", EARLIER), ("later", LATER)):
    view(f"{_name}_labels", f"""
SELECT customer_id, bool_or(coalesce(is_fraud, false)) AS has_fraud, max(fraud_score) AS max_fraud_score
FROM (SELECT * FROM transactions WHERE {inside(_window)} QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY transaction_date DESC) = 1)
GROUP BY customer_id""")
    view(f"{_name}_evaluated", f"""
SELECT '{_window.last_day}' AS window, s.*, l.has_fraud, l.max_fraud_score AS bank_score,
       s.n_suspicious + least(coalesce(s.anomaly_score, 0), 99) / 100 AS cluster_score, {RANDOM.format('customer_id')} AS random_score
FROM {_name}_summary s JOIN {_name}_labels l USING (customer_id)""")
view("evaluated_windows", "SELECT * FROM earlier_evaluated UNION ALL SELECT * FROM later_evaluated")
view("evaluated_pooled", """SELECT * REPLACE ('pooled' AS "window") FROM evaluated_windows""")


def evaluated_windows(t: BankTables):
    parts, usual = [], profiles(t)
    for window in (EARLIER, LATER):
        _, found = S.score_customers(recent_behavior(t, window), t.clusters, usual, SCORED)
        parts.append(V.evaluation_data(found, V.window_labels(t.transactions, window), window.last_day.isoformat()))
    return materialize(union_all(parts), "evaluated-windows")


@query("evaluate_pooled", report_sql("evaluated_pooled", with_random=False))
def evaluate_pooled(t: BankTables):
    return V.report_rows(V.pooled(evaluated_windows(t)), with_random=False)


@query("evaluation_report", report_sql("evaluated_windows") + " UNION ALL " + report_sql("evaluated_pooled", with_random=False))
def evaluation_report(t: BankTables):
    """Windows and pool, written as a report and read back."""
    rows = evaluated_windows(t)
    report = union_all([V.report_rows(rows), V.report_rows(V.pooled(rows), with_random=False)])
    folder = scratch(t, "reports")
    write_report(materialize(report, "report"), folder, "evaluation")
    return t.spark.read.parquet(f"{folder}/evaluation.parquet")


# What does not depend on the fitted clusters: sizes, positives, and the rules on every customer.
for _name, _window in (("earlier", EARLIER), ("later", LATER)):
    view(f"{_name}_rules", f"""
SELECT '{_window.last_day}' AS window, customer_id, has_fraud, 1.0 AS weight,
       coalesce((SELECT max(rule_score) FROM scored_tx s WHERE s.customer = l.customer_id AND {inside(_window, 'timestamp')}), 0)::DOUBLE AS rule_score
FROM {_name}_labels l WHERE customer_id IN (SELECT customer_id FROM customer_features) AND customer_id IN (SELECT customer_id FROM {_name}_behavior)""")
view("held_out_rules", "SELECT * FROM earlier_rules UNION ALL SELECT * FROM later_rules")
view("held_out_all", """SELECT * FROM held_out_rules UNION ALL SELECT * REPLACE ('pooled' AS "window") FROM held_out_rules""")
_COUNTS = """SELECT "window", count(*) AS customers, count(*) FILTER (WHERE has_fraud) AS positives, round_even(avg(has_fraud::INT), 5) AS base_rate,
 count(*) AS sample_customers, count(*) FILTER (WHERE NOT has_fraud) AS sampled_negatives FROM held_out_all GROUP BY "window" """


@query("evaluate_held_out", " UNION ALL ".join([
    long_sql(_COUNTS, "data", ["customers", "positives", "base_rate"]), long_sql(_COUNTS, "rules", ["sample_customers", "sampled_negatives"]),
    long_sql(ranking_sql("held_out_all", "rule_score", "weight"), "rules", ["average_precision", "roc_auc"]),
    long_sql(flags_sql("held_out_all", "rule_score", (30, 60), "weight"), "rules", V.FLAG_METRICS, "threshold")]))
def evaluate_held_out(t: BankTables):
    """Train on the first days, evaluate on two later windows. The rows of the fitted clusters are left to the tests."""
    model = L.train(inputs(t), "2024-01-10")
    days = [w.last_day.isoformat() for w in (EARLIER, LATER)]
    report = L.evaluate(inputs(t), model, days, rules_negatives=None, recent_days=HELD_OUT_DAYS, settings=SETTINGS)
    return report.filter("method IN ('data', 'rules')")


@query("audit_log", """
SELECT 'monitor' AS source, customer AS customer_id, true AS demo_mode, string_agg(id, ',' ORDER BY rank) AS transactions, count(*) AS shown
FROM (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY score DESC, timestamp, id) AS rank FROM analysis_tx
      WHERE score >= 60) a WHERE rank <= 5 GROUP BY customer""")
def audit_log(t: BankTables):
    """Alerts of all customers appended in two writes and read back."""
    top = materialize(monitor_high_risk(analysed(t), product_labels(t.products), SETTINGS), "high-risk")
    records = audit_records(top, "monitor", dt.datetime(2024, 2, 1, 12, 0), True)
    path = scratch(t, "audit")
    append_audit(path, records.filter(F.col("customer_id") < "C00000050"))
    append_audit(path, records.filter(F.col("customer_id") >= "C00000050"))
    read = t.spark.read.schema("source string, customer_id string, demo_mode boolean, transactions array<string>").json(path)
    return read.select("source", "customer_id", "demo_mode", F.array_join("transactions", ",").alias("transactions"),
                       F.size("transactions").cast("bigint").alias("shown"))
