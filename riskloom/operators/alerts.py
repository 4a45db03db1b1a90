"""What the customer may read and what the staff reads about a behaviour score.

Customers must not learn how they are grouped or measured: their alert is built from constants and
the date of the reviewed period only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.scaling import top_rows
from riskloom.operators.scoring import DEFAULT_MIN_SUSPICIOUS

# Messages to the customer, the instruction that goes with them, and metric names for staff.
MESSAGE_ES = "Hemos detectado un comportamiento sospechoso en su actividad bancaria."
MESSAGE_PT = "Detectamos um comportamento suspeito na sua atividade bancária."
INSTRUCTION = ("Share only this message, in the customer's language, and ask them to review their recent activity. "
               "Do not explain how it was detected and do not mention segments, groups, profiles, comparisons with "
               "other customers, metrics, thresholds or scores.")
METRIC_LABELS = {
    "num_transacciones_monthly": "número de transacciones del mes",
    "monto_total_usd_monthly": "monto total del mes",
    "monto_promedio_usd": "monto promedio por transacción",
    "monto_mediano_usd": "monto mediano por transacción",
    "monto_maximo_usd": "monto de la transacción más alta",
}


def latest_customer_anomaly(customer_anomaly: DataFrame) -> DataFrame:
    """Latest run of every customer; the comma-joined metrics become an array."""
    newest = top_rows(customer_anomaly, ["customer_id"], [F.col("as_of").desc(), F.col("model_version").desc()])
    metrics = F.filter(F.split(F.coalesce("suspicious_features", F.lit("")), ","), lambda m: m != "")
    return newest.select("customer_id", "as_of", "model_version", "n_features", "n_suspicious",
                         metrics.alias("suspicious_features"))


def _suspicious(latest: DataFrame, min_suspicious: int) -> DataFrame:
    return latest.filter(F.col("n_suspicious") >= min_suspicious)


def customer_alerts(latest: DataFrame, min_suspicious: int = DEFAULT_MIN_SUSPICIOUS) -> DataFrame:
    """Neutral alert of the flagged customers: nothing but the date comes from the score."""
    return _suspicious(latest, min_suspicious).select(
        "customer_id", F.lit(True).alias("unusual_activity_detected"), F.lit(MESSAGE_ES).alias("message_es"),
        F.lit(MESSAGE_PT).alias("message_pt"), F.col("as_of").cast("string").alias("reviewed_period_end"),
        F.lit(INSTRUCTION).alias("instruction"))


def _label(metric: Column) -> Column:
    labels = F.create_map(*[F.lit(part) for pair in METRIC_LABELS.items() for part in pair])
    return F.coalesce(F.try_element_at(labels, metric), metric)


def staff_notes(latest: DataFrame, min_suspicious: int = DEFAULT_MIN_SUSPICIOUS) -> DataFrame:
    """Internal text with the metrics that stand out; never shown to the customer."""
    names = F.array_join(F.transform("suspicious_features", _label), ", ")
    note = F.concat(F.lit("Alerta de comportamiento ("), F.col("model_version"), F.lit(", 30 días hasta "),
                    F.col("as_of").cast("string"), F.lit("): "), F.col("n_suspicious").cast("string"), F.lit(" de "),
                    F.col("n_features").cast("string"), F.lit(" métricas fuera de lo habitual para su segmento: "),
                    names, F.lit(". Uso interno: no compartir con el cliente que se le perfila por segmento."))
    return _suspicious(latest, min_suspicious).select("customer_id", note.alias("note"))


def flagged_pool(customer_anomaly: DataFrame, min_suspicious: int = DEFAULT_MIN_SUSPICIOUS, limit: int = 50) -> DataFrame:
    """Flagged customers of the latest run, most suspicious first."""
    last = customer_anomaly.agg(F.max("as_of")).scalar()
    flagged = customer_anomaly.filter((F.col("as_of") == last) & (F.col("n_suspicious") >= min_suspicious))
    return flagged.orderBy(F.col("n_suspicious").desc(), F.col("anomaly_score").desc(), "customer_id").limit(limit).select(
        "customer_id", "n_suspicious", "anomaly_score")
