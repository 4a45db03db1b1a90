"""The rules one by one, their total, and the questions asked about scored transactions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.numbers import haversine_km
from riskloom.operators import analysis as A
from riskloom.operators import rules as R
from riskloom.operators.alerts import customer_alerts, latest_customer_anomaly
from riskloom.plans.bridge import BankTables
from riskloom.plans.catalog.common import ANALYSIS_DAYS, BURST_MINUTES, VERSION
from riskloom.plans.catalog.registry import query, rounded, view
from riskloom.sources.logical import (has_usd_amount, history, latest_profiles, logical_transactions, model_score_scale,
                                      product_labels)

SETTINGS = R.with_burst(BURST_MINUTES)


def scored(t: BankTables, keep_hits: bool = False) -> DataFrame:
    return R.score_transactions(t.transactions, SETTINGS, keep_hits=keep_hits)


def hits(t: BankTables) -> DataFrame:
    logical = logical_transactions(t.transactions)
    return R.rule_hits(R.logical_facts(logical, has_usd_amount(t.transactions), SETTINGS), SETTINGS)


def analysed(t: BankTables) -> DataFrame:
    return A.analyze_window(scored(t), ANALYSIS_DAYS)


def hit_query(key: str, name: str, shown: str) -> None:
    """One rule: the transactions it fires on, with the facts that explain it."""
    columns = ["id", "customer", *shown.split()]
    doubles = [c for c in columns if c in ("amt_mean", "amt_std", "travel_km", "travel_hours")]

    @query(key, f"SELECT {', '.join(columns)} FROM rule_hits WHERE hit_{name}", rounds=doubles)
    def run(t: BankTables) -> DataFrame:
        return rounded(hits(t).filter(f"hit_{name}").select(*columns))


hit_query("rule_amount", "amount", "amount_usd amt_n amt_mean amt_std")
hit_query("rule_new_country", "country", "country prior_n")
hit_query("rule_new_city", "city", "city prior_n")
hit_query("rule_new_category", "category", "category amount_usd prior_n")
hit_query("rule_night", "night", "timestamp prior_n")
hit_query("rule_burst", "burst", "timestamp")
hit_query("rule_declines", "declines", "timestamp")
hit_query("rule_travel", "travel", "travel_km travel_hours")


@query("burst_counts", "SELECT id, cast(recent_n AS BIGINT) AS recent_n, cast(recent_declines AS BIGINT) AS recent_declines FROM rule_facts")
def burst_counts(t: BankTables):
    return hits(t).select("id", F.col("recent_n").cast("bigint").alias("recent_n"),
                          F.col("recent_declines").cast("bigint").alias("recent_declines"))


@query("haversine", """
SELECT transaction_id, 6371.0 * 2 * asin(sqrt(pow(sin((radians(latitude) - radians(4.6)) / 2), 2) + cos(radians(4.6))
       * cos(radians(latitude)) * pow(sin((radians(longitude) - radians(-74.1)) / 2), 2))) AS km FROM transactions""",
       rounds=["km"])
def haversine(t: BankTables):
    km = haversine_km(F.lit(4.6), F.lit(-74.1), F.col("latitude"), F.col("longitude"))
    return rounded(t.transactions.select("transaction_id", km.alias("km")))


@query("in_person", """
SELECT transaction_id, channel, coalesce(channel, '') = '' OR lower(trim(channel)) IN ('atm', 'branch', 'pos') AS in_person
FROM (SELECT transaction_id, CASE WHEN transaction_id LIKE '%9' THEN NULL WHEN transaction_id LIKE '%8' THEN '' ELSE channel END
      AS channel FROM transactions) c""")
def in_person(t: BankTables):
    rows = t.transactions.select("transaction_id", F.when(F.col("transaction_id").like("%9"), None).when(
        F.col("transaction_id").like("%8"), "").otherwise(F.col("channel")).alias("channel"))
    return rows.withColumn("in_person", R.in_person(F.col("channel")))


@query("comparable_amount", """
SELECT transaction_id, amount_usd AS with_usd_column, amount AS without_usd_column FROM transactions""")
def comparable_amount(t: BankTables):
    choices = {True: R.comparable_amount(has_usd_amount(t.transactions)),
               False: R.comparable_amount(has_usd_amount(t.transactions.drop("amount_usd")))}
    return t.transactions.select("transaction_id", choices[True].alias("with_usd_column"),
                                 choices[False].alias("without_usd_column"))


@query("rule_total", "SELECT id, customer, rule_score, model_score, score, level FROM scored_tx")
def rule_total(t: BankTables):
    return scored(t).select("id", "customer", "rule_score", "model_score", "score", "level")


@query("risk_level", """
SELECT level, count(*) AS rows, min(score) AS lowest, max(score) AS highest FROM (
  SELECT CASE WHEN fraud_score >= 60 THEN 'high' WHEN fraud_score >= 30 THEN 'medium' ELSE 'low' END AS level,
         fraud_score AS score FROM transactions) s GROUP BY level""")
def risk_level(t: BankTables):
    rows = t.transactions.select(R.risk_level(F.col("fraud_score")).alias("level"), F.col("fraud_score").alias("score"))
    return rows.groupBy("level").agg(F.count(F.lit(1)).alias("rows"), F.min("score").alias("lowest"),
                                     F.max("score").alias("highest"))


@query("rule_reasons", """
SELECT id, array_to_string(reasons, ' | ') AS reasons FROM scored_tx WHERE len(reasons) > 0""")
def rule_reasons(t: BankTables):
    return scored(t).filter(F.size("reasons") > 0).select("id", F.array_join("reasons", " | ").alias("reasons"))


@query("score_since", """
SELECT id, customer, rule_score, score FROM scored_tx WHERE timestamp >= DATE '2024-01-20'""")
def score_since(t: BankTables):
    return R.score_since(scored(t), dt.date(2024, 1, 20)).select("id", "customer", "rule_score", "score")


@query("analyze_window", "SELECT id, customer, timestamp, score, level FROM analysis_tx")
def analyze_window(t: BankTables):
    return analysed(t).select("id", "customer", "timestamp", "score", "level")


view("recent_rows", """
SELECT *, count(*) OVER (PARTITION BY customer) AS total_in_window, row_number() OVER (PARTITION BY customer ORDER BY timestamp DESC, id DESC) AS rank
FROM (SELECT *, max(timestamp) OVER (PARTITION BY customer) AS last_transaction FROM tx_history_rows) h
WHERE timestamp >= last_transaction - INTERVAL 5 DAY""")


@query("recent_transactions", """
SELECT customer, rank, id, timestamp, amount, merchant, status, total_in_window, last_transaction FROM recent_rows WHERE rank <= 20""")
def recent_transactions(t: BankTables):
    rows = A.recent_transactions(history(logical_transactions(t.transactions)), days=5, limit=20)
    return rows.select("customer", "rank", "id", "timestamp", "amount", "merchant", "status", "total_in_window", "last_transaction")


# Empty fields are left out.
_JSON = " || ".join(f"coalesce('\"{f}\":' || to_json({'strftime(timestamp, ' + chr(39) + '%Y-%m-%d %H:%M' + chr(39) + ')' if f == 'timestamp' else f}) || ',', '')"
                    for f in A.SHOWN_FIELDS)


@query("transaction_json", f"""
SELECT customer, rank, '{{' || rtrim({_JSON}, ',') || '}}' AS transaction FROM recent_rows WHERE rank <= 5""")
def transaction_json(t: BankTables):
    rows = A.recent_transactions(history(logical_transactions(t.transactions)), days=5, limit=5)
    return rows.select("customer", "rank", A.transaction_json().alias("transaction"))


view("assessment", """
SELECT customer, count(*) AS transactions_analyzed, count(*) FILTER (WHERE score >= 30) AS suspicious_count,
       CASE WHEN max(score) >= 60 THEN 'high' WHEN max(score) >= 30 THEN 'medium' ELSE 'low' END AS max_level,
       max(customer_last) AS until FROM analysis_tx GROUP BY customer""")
TOP = """
SELECT a.customer, rank, id, score, level, array_to_string(reasons, ' | ') AS reasons, card FROM (
  SELECT *, row_number() OVER (PARTITION BY customer ORDER BY score DESC, timestamp, id) AS rank FROM analysis_tx
  WHERE score >= {0}) a LEFT JOIN labels_of_products p ON p.product_id = a.product WHERE rank <= {1}"""


@query("assess_risk", """
SELECT a.*, CASE WHEN customer LIKE '%7' THEN '2024-01-30' END AS behavior_alert_until FROM assessment a""")
def assess_risk(t: BankTables):
    """With a behaviour alert for some customers."""
    flagged = t.customers.filter(F.col("customer_id").endswith("7")).select("customer_id").distinct().select(
        "customer_id", F.lit(dt.date(2024, 1, 30)).alias("as_of"), F.lit(VERSION).alias("model_version"), F.lit(5).alias("n_features"),
        F.lit(5).alias("n_suspicious"), F.lit("monto_total_usd").alias("suspicious_features"))
    return A.risk_assessment(analysed(t), SETTINGS, customer_alerts(latest_customer_anomaly(flagged)))


def _top_columns(top: DataFrame) -> DataFrame:
    return top.select("customer", "rank", "id", "score", "level", F.array_join("reasons", " | ").alias("reasons"), "card")


@query("assess_risk_details", TOP.format(30, 10))
def assess_risk_details(t: BankTables):
    return _top_columns(A.top_suspicious(analysed(t), product_labels(t.products), SETTINGS.suspicious, 10))


@query("monitor_high_risk", TOP.format(60, 5))
def monitor_high_risk(t: BankTables):
    return _top_columns(A.monitor_high_risk(analysed(t), product_labels(t.products), SETTINGS))


@query("top_signal_customers", """
SELECT customer, count(*) AS tx_count, max(model_score) AS max_model_score,
       count(*) FILTER (WHERE fraud_label IN ('true', '1', 'yes', 'y', 't')) AS labeled_fraud
FROM logical_tx WHERE timestamp >= (SELECT max(timestamp) FROM logical_tx) - INTERVAL 20 DAY GROUP BY customer
ORDER BY labeled_fraud DESC NULLS LAST, max_model_score DESC NULLS LAST, customer LIMIT 15""")
def top_signal_customers(t: BankTables):
    return A.top_signal_customers(t.transactions, days=20)


view("evaluation_customers", """
WITH c AS (SELECT customer, bool_or(fraud_label = 'true') AS has_fraud FROM logical_tx GROUP BY customer HAVING count(*) >= 10)
SELECT * FROM (SELECT * FROM c WHERE has_fraud ORDER BY md5(customer || '#42'), customer LIMIT 30)
UNION ALL SELECT * FROM (SELECT * FROM c WHERE NOT has_fraud ORDER BY md5(customer || '#42'), customer LIMIT 30)""")


@query("rules_evaluation_sample", "SELECT customer, has_fraud FROM evaluation_customers")
def rules_evaluation_sample(t: BankTables):
    return A.evaluation_sample(t.transactions, 60)


def _signals(source: str) -> str:
    cells = [f"SELECT '{s}' AS signal, {th}.0::DOUBLE AS threshold, count(*) FILTER (WHERE {c} >= {th}) AS alerts, "
             f"count(*) FILTER (WHERE {c} >= {th} AND fraud_label = 'true') AS true_positives, "
             f"count(*) FILTER (WHERE fraud_label = 'true') AS positives FROM {source}"
             for s, c in (("rules", "rule_score"), ("model", "model_score"), ("combined", "score")) for th in (30, 60)]
    return (f"SELECT *, coalesce(true_positives / nullif(alerts, 0), 0) AS precision, "
            f"coalesce(true_positives / nullif(positives, 0), 0) AS recall FROM ({' UNION ALL '.join(cells)}) s")


@query("rules_evaluation", _signals("(SELECT * FROM scored_tx WHERE customer IN (SELECT customer FROM evaluation_customers)) s"),
       rounds=["precision", "recall"])
def rules_evaluation(t: BankTables):
    sample = A.evaluation_sample(t.transactions, 60)
    return rounded(A.rules_evaluation(R.score_transactions(t.transactions, SETTINGS, sample), SETTINGS))


@query("rules_evaluation_all", _signals("scored_tx"), rounds=["precision", "recall"])
def rules_evaluation_all(t: BankTables):
    return rounded(A.rules_evaluation(scored(t), SETTINGS))


MESSAGE = "Hola Ana, detectamos actividad inusual en tu cuenta y queremos confirmar que fuiste tú."


@query("alert_text", f"""
WITH high AS (
  SELECT a.*, p.card FROM (
    SELECT *, row_number() OVER (PARTITION BY customer ORDER BY score DESC, timestamp, id) AS rank FROM analysis_tx
    WHERE score >= 60) a LEFT JOIN labels_of_products p ON p.product_id = a.product WHERE rank <= 5),
lines AS (
  SELECT customer, string_agg(format('- {{}} | {{:,.2f}} {{}} | {{}}{{}}', strftime(timestamp, '%Y-%m-%d %H:%M'), amount, currency,
         concat_ws(' ', coalesce(nullif(merchant, ''), nullif(category, '')), nullif(city, '')),
         coalesce(' | ' || card, '')), chr(10) ORDER BY rank) AS body FROM high GROUP BY customer),
people AS (SELECT * FROM customers QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY last_updated DESC) = 1)
SELECT customer, concat_ws(chr(10), 'Hola ' || coalesce(first_name, last_name, 'cliente') || ',', '',
  'Detectamos actividad inusual en tu cuenta y queremos confirmar que fuiste tú.', '', 'Transacciones en revisión:', body, '',
  'Si no reconoces estas transacciones, bloquea tu tarjeta desde la app o comunícate con la línea oficial de su banco.',
  'Su banco nunca te pedirá contraseñas, PIN, CVV ni códigos por este medio.') AS alert
FROM lines LEFT JOIN people ON customer_id = customer""")
def alert_text(t: BankTables):
    top = A.monitor_high_risk(analysed(t), product_labels(t.products), SETTINGS)
    return A.alert_text(top, latest_profiles(t.customers), MESSAGE)


@query("tx_model_scale", "SELECT id, model_score * 1.0 AS model_score FROM logical_tx")
def tx_model_scale(t: BankTables):
    rows = logical_transactions(t.transactions)
    return rows.select("id", (F.col("model_score") * model_score_scale(rows).scalar()).alias("model_score"))
