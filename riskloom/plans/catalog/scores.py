"""Profiles, deviation scores and the operational tables of a scoring run.

The clusters are a fixed stand-in here, so that the SQL twins see the same ones.
"""

from __future__ import annotations

import datetime as dt

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from riskloom import sinks
from riskloom.operators import alerts as AL
from riskloom.operators import contracts as C
from riskloom.operators import scoring as S
from riskloom.operators.cases import queue_state
from riskloom.operators.scaling import union_all
from riskloom.plans import lifecycle
from riskloom.plans.bridge import BankTables
from riskloom.plans.catalog.behavior import recent_behavior
from riskloom.plans.catalog.common import ALL_METRICS, AS_OF, BASELINE, RECENT, SCORED, VERSION
from riskloom.plans.catalog.contracts import _counts, below, infinite, required
from riskloom.plans.catalog.registry import query, rounded, view
from riskloom.plans.catalog.sources import scratch
from riskloom.plans.lifecycle import ScoringResult

DAY = dt.date.fromisoformat(AS_OF)
MIN_FLAGGED = 2
DETAIL = [c for c in S.DETAIL_COLUMNS]
DETAIL_DOUBLES = ["value", "cluster_median", "cluster_p25", "cluster_p75", "deviation_score"]


def profiles(t: BankTables):
    return S.cluster_profiles(recent_behavior(t, BASELINE), t.clusters, ALL_METRICS)


def detail(t: BankTables, metrics=SCORED):
    return S.score_detail(recent_behavior(t, RECENT), t.clusters, profiles(t), metrics)


def summary(t: BankTables):
    return S.score_summary(detail(t), SCORED)


def joined(df):
    return df.withColumn("suspicious_features", F.array_join("suspicious_features", ","))


@query("cluster_profiles", f"SELECT {', '.join(S.PROFILE_COLUMNS)} FROM profiles",
       rounds=["mean", "median", "p25", "p75", "p95", "mad"], digits=8)
def cluster_profiles(t: BankTables):
    return rounded(profiles(t), 8)


@query("robust_deviation", """
SELECT customer_id, feature, CASE WHEN mad = 0 AND p25 = p75 AND value <> median THEN NULL ELSE deviation_score END
       AS deviation_score, deviation_score = 'inf'::DOUBLE AS is_infinite
FROM (SELECT d.*, median, mad, p25, p75 FROM score_detail_all d JOIN profiles p USING (cluster, feature)) s""",
       rounds=["deviation_score"])
def robust_deviation(t: BankTables):
    rows = detail(t, ALL_METRICS).select("customer_id", "feature", "deviation_score")
    infinite_value = F.col("deviation_score") == F.lit(float("inf"))
    return rounded(rows.withColumn("is_infinite", infinite_value).withColumn(
        "deviation_score", F.when(~infinite_value, F.col("deviation_score"))))


@query("score_detail", f"SELECT {', '.join(DETAIL)} FROM score_detail", rounds=DETAIL_DOUBLES)
def score_detail(t: BankTables):
    return rounded(detail(t))


@query("score_summary", "SELECT * FROM score_summary", rounds=["anomaly_score"])
def score_summary(t: BankTables):
    return rounded(joined(summary(t)))


view("flagged_rows", f"""
SELECT * REPLACE (n_suspicious / n_features AS anomaly_score) FROM score_summary WHERE n_suspicious >= {MIN_FLAGGED}""")


@query("queue_score", "SELECT customer_id, n_suspicious / n_features AS queue_score FROM score_summary", rounds=["queue_score"])
def queue_score(t: BankTables):
    return rounded(summary(t).select("customer_id", S.queue_score().alias("queue_score")))


@query("flagged_customers", "SELECT * FROM flagged_rows", rounds=["anomaly_score"])
def flagged_customers(t: BankTables):
    return rounded(joined(S.flagged_customers(summary(t), MIN_FLAGGED)))


@query("run_summary", "SELECT n_suspicious, count(*) AS customers FROM score_summary GROUP BY n_suspicious")
def run_summary(t: BankTables):
    return S.run_summary(summary(t))


@query("notebook_score", """
SELECT customer_id, cluster, count(*) AS n_features, count(*) FILTER (WHERE is_suspicious) AS n_unusual,
       avg(deviation_score) FILTER (WHERE deviation_score < 'inf'::DOUBLE) AS overall_score
FROM score_detail_all GROUP BY customer_id, cluster""", rounds=["overall_score"])
def notebook_score(t: BankTables):
    return rounded(S.unusual_behavior(recent_behavior(t, RECENT), t.clusters, profiles(t), ALL_METRICS))


def given_model(t: BankTables) -> lifecycle.TrainedModel:
    """A model of the life cycle whose pipeline deals the given clusters and whose profiles are the given ones."""
    t.clusters.createOrReplaceTempView("given_clusters")
    dealt = SQLTransformer(statement="SELECT f.*, c.cluster FROM __THIS__ f JOIN given_clusters c ON c.customer_id = f.customer_id")
    return lifecycle.TrainedModel(PipelineModel(stages=[dealt]), profiles(t), t.clusters, {"model_version": "clusters_20231231", "as_of": "2023-12-31"})


@query("score_as_of", """
SELECT customer_id, cluster, feature, value, deviation_score, is_suspicious FROM score_detail WHERE customer_id IN (SELECT customer_id FROM customer_features)""",
       rounds=["value", "deviation_score"])
def score_as_of(t: BankTables):
    """The whole step of the life cycle: features, clusters, behaviour of the window, scores."""
    bank = lifecycle.BankInputs(t.customers, t.products, t.transactions)
    found = lifecycle.score_as_of(bank, given_model(t), AS_OF, SCORED, RECENT.days).detail
    return rounded(found.select("customer_id", "cluster", "feature", "value", "deviation_score", "is_suspicious"))


# --- contracts of the score tables, with planted errors -------------------------------------------
view("odd_profiles", """
SELECT cluster - 1 AS cluster, feature, count, mean, p75 AS p25, median, p25 AS p75, p95,
       CASE WHEN feature = 'monto_p95_usd' THEN -mad ELSE mad END AS mad FROM profiles""")


@query("contract_cluster_profiles", _counts("odd_profiles", [
    *required("cluster"), infinite("cluster"), below("cluster", 0), *required("feature", "count"), infinite("count"),
    below("count", 1), *[r for n in ("median", "p25", "p75") for r in (*required(n), infinite(n))], *required("mad"),
    infinite("mad"), below("mad", 0), ("p25 > p75", "p25 > p75")])
       + " UNION ALL SELECT 'duplicado en [''cluster'', ''feature'']', 0")
def contract_cluster_profiles(t: BankTables):
    odd = profiles(t).select(
        (F.col("cluster") - 1).alias("cluster"), "feature", "count", "mean", F.col("p75").alias("p25"), "median",
        F.col("p25").alias("p75"), "p95",
        F.when(F.col("feature") == "monto_p95_usd", -F.col("mad")).otherwise(F.col("mad")).alias("mad"))
    return C.rule_counts(odd, C.CLUSTER_PROFILES)


view("odd_details", """
SELECT customer_id, cluster - 2 AS cluster, nullif(feature, 'monto_mediano_usd') AS feature,
       CASE WHEN customer_id LIKE '%3' THEN -deviation_score ELSE deviation_score END AS deviation_score FROM score_detail
UNION ALL SELECT customer_id, cluster, feature, deviation_score + 1 FROM score_detail WHERE customer_id LIKE '%4'""")


@query("contract_behavior_scores", _counts("odd_details", [
    *required("customer_id", "cluster"), infinite("cluster"), below("cluster", 0), *required("feature"),
    below("deviation_score", 0)]) + """
UNION ALL SELECT 'duplicado en [''customer_id'', ''feature'']', count(*) FILTER (WHERE nth > 1 AND NOT
  (cluster < 0 OR feature IS NULL OR coalesce(deviation_score < 0, false)))
FROM (SELECT *, row_number() OVER (PARTITION BY customer_id, feature ORDER BY cluster, deviation_score NULLS FIRST) AS nth
      FROM odd_details)""")
def contract_behavior_scores(t: BankTables):
    rows = detail(t).select("customer_id", "cluster", "feature", "deviation_score")
    odd = rows.select("customer_id", (F.col("cluster") - 2).alias("cluster"),
                      F.nullif(F.col("feature"), F.lit("monto_mediano_usd")).alias("feature"),
                      F.when(F.col("customer_id").endswith("3"), -F.col("deviation_score"))
                      .otherwise(F.col("deviation_score")).alias("deviation_score"))
    again = rows.filter(F.col("customer_id").endswith("4")).withColumn("deviation_score", F.col("deviation_score") + 1)
    return C.rule_counts(odd.unionByName(again), C.BEHAVIOR_SCORES, [F.col("cluster"), F.col("deviation_score")])


@query("contract_customer_scores", _counts("""(
SELECT *, CASE WHEN customer_id LIKE '%2' THEN 6 ELSE n_suspicious END AS odd_count FROM score_summary) s""", [
    *required("customer_id", "cluster"), infinite("cluster"), below("cluster", 0), infinite("anomaly_score"),
    below("anomaly_score", 0), *required("n_features"), infinite("n_features"), below("n_features", 1),
    ("n_suspicious: nulo", "odd_count IS NULL"), ("n_suspicious: infinito", "false"), ("n_suspicious: < 0", "odd_count < 0"),
    ("n_suspicious > n_features", "odd_count > n_features")]) + " UNION ALL SELECT 'duplicado en [''customer_id'']', 0")
def contract_customer_scores(t: BankTables):
    odd = summary(t).withColumn("n_suspicious", F.when(F.col("customer_id").endswith("2"), 6).otherwise(F.col("n_suspicious")))
    return C.rule_counts(odd, C.CUSTOMER_SCORES)


# --- operational tables ------------------------------------------------------------------------
def operations(t: BankTables) -> sinks.Operations:
    return sinks.Operations(t.spark, scratch(t, "operations"))


def result(t: BankTables, day: dt.date = DAY) -> ScoringResult:
    rows, totals = S.score_customers(recent_behavior(t, RECENT), t.clusters, profiles(t), SCORED)
    return ScoringResult(day, VERSION, t.clusters, rows, totals, SCORED)


@query("ops_schemas", f"""
SELECT 'anomaly_queue' AS name, 4 AS columns, count(*) AS rows FROM score_summary WHERE n_suspicious >= 4
UNION ALL SELECT 'behavior_anomalies', 11, count(*) FROM score_detail UNION ALL SELECT 'customer_anomaly', 8, count(*) FROM score_summary
UNION ALL SELECT 'customer_cluster', 4, count(*) FROM clusters UNION ALL SELECT 'scoring_runs', 12, 1
UNION ALL SELECT * FROM (VALUES ('case_transactions', 3, 0), ('case_updates', 4, 0), ('escalations', 12, 0), ('fraud_cases', 14, 0),
  ('queue_outcomes', 6, 0)) s(name, columns, rows)""")
def ops_schemas(t: BankTables):
    """The tables that a scoring run creates and fills, read back with their fixed schemas."""
    ops = operations(t)
    ops.setup()
    sinks.write_results(ops, result(t))
    counts = [ops.read(name).agg(F.lit(name).alias("name"), F.lit(len(ops.read(name).columns)).alias("columns"), F.count(F.lit(1)).alias("rows"))
              for name in sorted(sinks.SCHEMAS)]
    return union_all(counts)


@query("replace_run", f"""
SELECT DATE '{AS_OF}' AS as_of, '{VERSION}' AS model_version, customer_id, cluster FROM clusters WHERE cluster <> 0
UNION ALL SELECT DATE '2024-01-29', '{VERSION}', customer_id, cluster FROM clusters WHERE cluster = 0""")
def replace_run(t: BankTables):
    """Two runs; one is repeated with other rows, a third is repeated with none."""
    ops = operations(t)
    earlier = DAY - dt.timedelta(days=1)
    ops.replace_run("customer_cluster", t.clusters, DAY, VERSION)
    ops.replace_run("customer_cluster", t.clusters.filter("cluster = 0"), earlier, VERSION)
    ops.replace_run("customer_cluster", t.clusters, DAY, "otro")
    ops.replace_run("customer_cluster", t.clusters.filter("cluster <> 0"), DAY, VERSION)
    ops.replace_run("customer_cluster", t.clusters.filter("cluster > 9"), DAY, "otro")
    return ops.read("customer_cluster")


view("queued", f"""
SELECT customer_id, TIMESTAMP '{AS_OF}' AS detected_at, '{VERSION}' AS model_name, anomaly_score FROM flagged_rows""")


@query("enqueue_once", "SELECT * FROM queued", rounds=["anomaly_score"])
def enqueue_once(t: BankTables):
    """Half of the customers first, then all of them twice: everyone is queued once."""
    ops = operations(t)
    rows = sinks.queue_rows(summary(t), DAY, VERSION, MIN_FLAGGED)
    ops.enqueue_once(rows.filter(F.col("customer_id") < "C00000075"))
    ops.enqueue_once(rows)
    ops.enqueue_once(rows)
    return rounded(ops.read("anomaly_queue"))


RUN = f"""
SELECT DATE '{AS_OF}' AS as_of, '{VERSION}' AS model_version, (SELECT count(*) FROM clusters) AS n_customers,
       (SELECT count(*) FROM score_summary) AS n_scored, (SELECT count(*) FROM flagged_rows) AS n_flagged"""


@query("scoring_run_row", RUN + f", (SELECT count(*) FROM flagged_rows) AS n_enqueued, {MIN_FLAGGED} AS min_suspicious, 'ok' AS status")
def scoring_run_row(t: BankTables):
    ops = operations(t)
    sinks.write_results(ops, result(t), MIN_FLAGGED)
    return ops.read("scoring_runs").select("as_of", "model_version", "n_customers", "n_scored", "n_flagged", "n_enqueued",
                                           "min_suspicious", "status")


@query("write_results", """
SELECT 'customer_cluster' AS name, customer_id, 'cluster' AS detail, cluster::DOUBLE AS value FROM clusters
UNION ALL SELECT 'behavior_anomalies', customer_id, feature, CASE WHEN deviation_score < 'inf'::DOUBLE THEN deviation_score END FROM score_detail
UNION ALL SELECT 'customer_anomaly', customer_id, n_suspicious || ':' || suspicious_features, anomaly_score FROM score_summary
UNION ALL SELECT 'anomaly_queue', customer_id, 'modelo', anomaly_score FROM queued
UNION ALL SELECT 'scoring_runs', NULL, 'ok', (SELECT count(*) FROM score_summary)::DOUBLE FROM range(2)""", rounds=["value"])
def write_results(t: BankTables):
    """A run that is repeated: its rows are replaced, nobody is queued again, two run rows remain."""
    ops = operations(t)
    scores = result(t)
    sinks.write_results(ops, scores, MIN_FLAGGED)
    sinks.write_results(ops, scores, MIN_FLAGGED)
    finite = F.when(F.col("deviation_score") < float("inf"), F.col("deviation_score"))
    shown = {"customer_cluster": (F.lit("cluster"), F.col("cluster")), "behavior_anomalies": (F.col("feature"), finite),
             "customer_anomaly": (F.concat(F.col("n_suspicious").cast("string"), F.lit(":"), F.col("suspicious_features")), F.col("anomaly_score")),
             "anomaly_queue": (F.lit("modelo"), F.col("anomaly_score")), "scoring_runs": (F.col("status"), F.col("n_scored"))}
    key = {"scoring_runs": F.lit(None).cast("string")}
    return rounded(union_all([ops.read(n).select(F.lit(n).alias("name"), key.get(n, F.col("customer_id")).alias("customer_id"),
                                                 d.alias("detail"), v.cast("double").alias("value")) for n, (d, v) in shown.items()]))


# Two runs per customer, the later one with other counts for some.
view("anomaly_runs", f"""
SELECT DATE '{AS_OF}' AS as_of, '{VERSION}' AS model_version, * FROM score_summary WHERE customer_id NOT LIKE '%6'
UNION ALL SELECT DATE '2023-12-31', '{VERSION}', * REPLACE (5 AS n_suspicious, 'monto_total_usd_monthly,otra' AS suspicious_features)
FROM score_summary""")


def anomaly_runs(t: BankTables):
    now = joined(summary(t))
    columns = [F.lit(DAY).alias("as_of"), F.lit(VERSION).alias("model_version")]
    old = now.withColumns({"n_suspicious": F.lit(5), "suspicious_features": F.lit("monto_total_usd_monthly,otra")})
    return now.filter(~F.col("customer_id").endswith("6")).select(*columns, "*").unionByName(
        old.select(F.lit(dt.date(2023, 12, 31)).alias("as_of"), F.lit(VERSION).alias("model_version"), "*"))


view("latest_anomaly", """
SELECT customer_id, as_of, model_version, n_features, n_suspicious, suspicious_features FROM anomaly_runs
QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY as_of DESC, model_version DESC) = 1""")


@query("latest_customer_anomaly", "SELECT * FROM latest_anomaly")
def latest_customer_anomaly(t: BankTables):
    return joined(AL.latest_customer_anomaly(anomaly_runs(t)))


@query("customer_alert", f"""
SELECT customer_id, true AS unusual_activity_detected, '{AL.MESSAGE_ES}' AS message_es, '{AL.MESSAGE_PT}' AS message_pt,
       cast(as_of AS VARCHAR) AS reviewed_period_end, '{AL.INSTRUCTION.replace("'", "''")}' AS instruction
FROM latest_anomaly WHERE n_suspicious >= {MIN_FLAGGED}""")
def customer_alert(t: BankTables):
    return AL.customer_alerts(AL.latest_customer_anomaly(anomaly_runs(t)), MIN_FLAGGED)


LABEL_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in AL.METRIC_LABELS.items())


@query("staff_note", f"""
SELECT customer_id, 'Alerta de comportamiento (' || model_version || ', 30 días hasta ' || cast(as_of AS VARCHAR) || '): '
       || n_suspicious || ' de ' || n_features || ' métricas fuera de lo habitual para su segmento: '
       || array_to_string(list_transform(string_split(suspicious_features, ','), lambda f: CASE f {LABEL_CASE} ELSE f END), ', ')
       || '. Uso interno: no compartir con el cliente que se le perfila por segmento.' AS note
FROM latest_anomaly WHERE n_suspicious >= {MIN_FLAGGED}""")
def staff_note(t: BankTables):
    return AL.staff_notes(AL.latest_customer_anomaly(anomaly_runs(t)), MIN_FLAGGED)


@query("flagged_pool", f"""
SELECT customer_id, n_suspicious, anomaly_score FROM anomaly_runs
WHERE as_of = (SELECT max(as_of) FROM anomaly_runs) AND n_suspicious >= 1
ORDER BY n_suspicious DESC, anomaly_score DESC, customer_id LIMIT 25""", rounds=["anomaly_score"])
def flagged_pool(t: BankTables):
    return rounded(AL.flagged_pool(anomaly_runs(t), 1, 25))


@query("queue_state", """
SELECT customer_id, detected_at, model_name, anomaly_score,
       CASE WHEN customer_id LIKE '%1' THEN 'not_found' END AS result FROM queued""", rounds=["anomaly_score"])
def queue_state_query(t: BankTables):
    queue = sinks.queue_rows(summary(t), DAY, VERSION, MIN_FLAGGED)
    done = queue.filter(F.col("customer_id").endswith("1")).select(
        "customer_id", "detected_at", "model_name", F.lit(DAY).cast("timestamp_ntz").alias("processed_at"),
        F.lit(None).cast("string").alias("case_id"), F.lit("not_found").alias("result"))
    return rounded(queue_state(queue, done).drop("processed_at", "case_id"))
