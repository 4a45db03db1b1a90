"""Transaction behaviour over date windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.numbers import history_window
from riskloom.operators import behavior as B
from riskloom.operators import contracts as C
from riskloom.operators.scaling import union_all
from riskloom.plans.bridge import BankTables
from riskloom.plans.catalog.common import BASELINE, BEHAVIOR_DOUBLES, HISTORY, MONTHLY_DOUBLES, RECENT, inside
from riskloom.plans.catalog.contracts import _counts, above, below, infinite, required
from riskloom.plans.catalog.registry import query, rounded, view
from riskloom.sources.tables import transactions_in_window


def cleaned(t: BankTables, window=RECENT):
    """Unique, complete and valid transactions of a window."""
    rows = B.clean_amounts(transactions_in_window(t.transactions, window))
    return C.valid_rows(rows, C.RAW_TRANSACTIONS.rows_only())


def recent_behavior(t: BankTables, window=RECENT):
    return B.window_behavior(transactions_in_window(t.transactions, window), window, unique=True)


def _totals(t: BankTables, *groups):
    prepared = B.calendar_columns(cleaned(t))
    return rounded(B.aggregate(prepared, {name: c for g in groups for name, c in g.items()}), 8)


@query("select_window", f"""
SELECT 'recent' AS name, count(*) AS rows, max(transaction_date) AS last FROM transactions WHERE {inside(RECENT)}
UNION ALL SELECT 'baseline', count(*), max(transaction_date) FROM transactions WHERE {inside(BASELINE)}
UNION ALL SELECT 'history', count(*), max(transaction_date) FROM transactions WHERE {inside(HISTORY)}""")
def select_window(t: BankTables):
    parts = [B.select_window(t.transactions, w).agg(F.count(F.lit(1)).alias("rows"), F.max("transaction_date").alias("last"))
             .select(F.lit(n).alias("name"), "rows", "last")
             for n, w in (("recent", RECENT), ("baseline", BASELINE), ("history", HISTORY))]
    return union_all(parts)


@query("notebook_windows", """
WITH bounds AS (SELECT max(transaction_date) AS e, max(transaction_date) - INTERVAL 6 DAY AS s FROM transactions)
SELECT customer_id, CASE WHEN transaction_date BETWEEN s AND e THEN 'recent' ELSE 'baseline' END AS period, count(*) AS rows
FROM transactions, bounds
WHERE transaction_date BETWEEN s AND e
   OR transaction_date BETWEEN s - INTERVAL 1 DAY - INTERVAL 12 MONTH + INTERVAL 1 DAY AND s - INTERVAL 1 DAY
GROUP BY ALL""")
def notebook_windows(t: BankTables):
    rows = B.split_by_latest_moment(t.transactions, recent_days=7)
    return rows.groupBy("customer_id", "period").agg(F.count(F.lit(1)).alias("rows"))


@query("dedup_transactions", """
SELECT transaction_id, transaction_date, customer_id, amount FROM transactions
QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY transaction_date DESC) = 1""")
def dedup_transactions(t: BankTables):
    return B.dedup_transactions(t.transactions).select("transaction_id", "transaction_date", "customer_id", "amount")


@query("tx_calendar_columns", """
SELECT transaction_id, transaction_date, cast(hour(transaction_date) AS INT) AS transaction_hour,
       cast(isodow(transaction_date) - 1 AS INT) AS transaction_weekday, isodow(transaction_date) >= 6 AS is_weekend,
       hour(transaction_date) < 6 OR hour(transaction_date) >= 22 AS is_night,
       cast(year(transaction_date) * 100 + month(transaction_date) AS INT) AS transaction_month,
       transaction_status = 'Approved' AS is_approved FROM transactions""")
def tx_calendar_columns(t: BankTables):
    return B.calendar_columns(t.transactions).select(
        "transaction_id", "transaction_date", "transaction_hour", "transaction_weekday", "is_weekend", "is_night",
        "transaction_month", "is_approved")


@query("behavior_counts", """
SELECT customer_id, num_transacciones, num_dias_activos, num_meses_activos, num_productos, num_tipos_transaccion, num_monedas,
       num_paises_transaccion, num_ciudades_transaccion FROM recent_totals""")
def behavior_counts(t: BankTables):
    return _totals(t, B.count_metrics())


@query("behavior_amounts", """
SELECT customer_id, monto_total_usd, monto_promedio_usd, monto_mediano_usd, monto_maximo_usd, monto_p95_usd, monto_std_usd
FROM recent_totals""", rounds=BEHAVIOR_DOUBLES[:6], digits=8)
def behavior_amounts(t: BankTables):
    quantiles = {n: F.percentile("amount_usd", F.lit(p)) for n, p in B.QUANTILES.items()}
    return _totals(t, B.amount_metrics(), quantiles)


@query("behavior_shares", """
SELECT customer_id, porcentaje_fin_semana, porcentaje_nocturnas, tasa_aprobacion, porcentaje_amount_usd_faltante
FROM recent_totals""",
       rounds=BEHAVIOR_DOUBLES[6:10], digits=8)
def behavior_shares(t: BankTables):
    return _totals(t, B.share_metrics())


@query("behavior_frequency", f"""
SELECT customer_id, num_transacciones, num_transacciones / 1.0 AS transacciones_promedio_mes,
       num_transacciones / num_meses_activos AS transacciones_promedio_mes_activo,
       num_transacciones / num_dias_activos AS transacciones_por_dia_activo FROM recent_totals""",
       rounds=["transacciones_promedio_mes", "transacciones_promedio_mes_activo", "transacciones_por_dia_activo"])
def behavior_frequency(t: BankTables):
    counts = B.aggregate(B.calendar_columns(cleaned(t)), B.count_metrics())
    return rounded(B.frequency_metrics(counts, RECENT.months_touched).select(
        "customer_id", "num_transacciones", "transacciones_promedio_mes", "transacciones_promedio_mes_activo",
        "transacciones_por_dia_activo"))


@query("period_inferred", """
SELECT (year(max(o_orderdate)) - year(min(o_orderdate))) * 12 + month(max(o_orderdate)) - month(min(o_orderdate)) + 1 AS months
FROM orders""")
def period_inferred(t: BankTables):
    rows = t.base("orders").select(F.col("o_orderdate").alias("transaction_date"))
    return B.months_in_data(rows).select(F.col("months").cast("bigint").alias("months"))


@query("dominant_type", """
SELECT t.customer_id, d.tipo_transaccion_dominante, d.count_dominante / t.num_transacciones AS participacion_tipo_dominante
FROM recent_totals t LEFT JOIN recent_dominant d USING (customer_id)""", rounds=["participacion_tipo_dominante"])
def dominant_type(t: BankTables):
    rows = cleaned(t)
    counts = rows.groupBy("customer_id").agg(F.count("transaction_id").alias("num_transacciones"))
    return rounded(B.add_dominant_type(counts, rows).drop("num_transacciones"))


FULL = "customer_id, " + ", ".join(B.BEHAVIOR_COLUMNS[1:])


@query("build_transaction_behavior", f"SELECT {FULL} FROM history_behavior", rounds=BEHAVIOR_DOUBLES, digits=8)
def build_transaction_behavior(t: BankTables):
    return rounded(B.build_transaction_behavior(transactions_in_window(t.transactions, HISTORY), HISTORY, unique=True), 8)


@query("normalize_behavior_period", f"SELECT customer_id, {', '.join(MONTHLY_DOUBLES)} FROM baseline_behavior",
       rounds=MONTHLY_DOUBLES)
def normalize_behavior_period(t: BankTables):
    behavior = B.build_transaction_behavior(transactions_in_window(t.transactions, BASELINE), BASELINE, unique=True)
    return rounded(B.normalize_period(behavior, BASELINE.days).select("customer_id", *MONTHLY_DOUBLES))


@query("window_behavior", f"SELECT {FULL}, {', '.join(MONTHLY_DOUBLES)} FROM recent_behavior",
       rounds=BEHAVIOR_DOUBLES + MONTHLY_DOUBLES, digits=8)
def window_behavior(t: BankTables):
    return rounded(recent_behavior(t), 8)


# Yearly figures of a second source with a long history: orders as transactions, one row per order.
ORDER_DOUBLES = ["monto_total_usd", "monto_promedio_usd", "monto_mediano_usd", "monto_p95_usd"]


@query("behavior_long_history", """
SELECT cast(o_custkey AS VARCHAR) AS customer_id, count(*) AS num_transacciones,
       count(DISTINCT date_trunc('month', o_orderdate)) AS num_meses_activos, sum(o_totalprice) AS monto_total_usd,
       avg(o_totalprice) AS monto_promedio_usd, quantile_cont(o_totalprice, 0.5) AS monto_mediano_usd,
       quantile_cont(o_totalprice, 0.95) AS monto_p95_usd
FROM orders WHERE o_orderdate >= DATE '2000-07-01' AND o_orderdate < DATE '2001-07-01' GROUP BY o_custkey""",
       rounds=ORDER_DOUBLES)
def behavior_long_history(t: BankTables):

    window = history_window("2001-06-30")
    rows = t.base("orders").select(
        F.col("o_orderkey").cast("string").alias("transaction_id"), F.col("o_orderdate").alias("transaction_date"),
        F.col("o_custkey").cast("string").alias("customer_id"), F.col("o_totalprice").alias("amount"),
        F.lit("USD").alias("currency"), F.lit(None).cast("string").alias("product_id"),
        F.lit("Order").alias("transaction_type"), F.lit(None).cast("double").alias("amount_usd"),
        F.lit(None).cast("string").alias("transaction_country"), F.lit(None).cast("string").alias("transaction_city"),
        F.lit("Approved").alias("transaction_status"))
    behavior = B.build_transaction_behavior(B.select_window(rows, window), window)
    return rounded(behavior.select("customer_id", "num_transacciones", "num_meses_activos", *ORDER_DOUBLES))


# Contract of a behaviour table with planted errors.
view("odd_behavior", """
SELECT customer_id, CASE WHEN customer_id LIKE '%7' THEN 0 ELSE num_transacciones END AS num_transacciones, num_dias_activos,
       CASE WHEN customer_id LIKE '%5' THEN 'inf'::DOUBLE ELSE monto_total_usd END AS monto_total_usd, monto_promedio_usd,
       porcentaje_fin_semana * 2 AS porcentaje_fin_semana, porcentaje_nocturnas, -tasa_aprobacion AS tasa_aprobacion,
       participacion_tipo_dominante FROM recent_behavior""")


@query("contract_transaction_behavior", _counts("odd_behavior", [
    *required("customer_id", "num_transacciones"), infinite("num_transacciones"), below("num_transacciones", 1),
    *required("num_dias_activos"), infinite("num_dias_activos"), below("num_dias_activos", 1), infinite("monto_total_usd"),
    infinite("monto_promedio_usd"), *[r for n in C.SHARE_METRICS for r in (infinite(n), below(n, 0), above(n, 1))]])
       + " UNION ALL SELECT 'duplicado en [''customer_id'']', 0")
def contract_transaction_behavior(t: BankTables):
    behavior = recent_behavior(t)
    ends = F.col("customer_id").endswith
    odd = behavior.withColumns({
        "num_transacciones": F.when(ends("7"), 0).otherwise(F.col("num_transacciones")),
        "monto_total_usd": F.when(ends("5"), F.lit(float("inf"))).otherwise(F.col("monto_total_usd")),
        "porcentaje_fin_semana": F.col("porcentaje_fin_semana") * 2, "tasa_aprobacion": -F.col("tasa_aprobacion")})
    return C.rule_counts(odd, C.TRANSACTION_BEHAVIOR)
