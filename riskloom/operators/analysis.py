"""Questions about scored transactions, answered for all customers at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.text import as_truth, present
from riskloom.operators.rules import DEFAULTS, RuleSettings
from riskloom.operators.scaling import top_rows, union_all
from riskloom.sources.logical import logical_transactions, model_score_scale

DEFAULT_DAYS = 180
# Texts of a true label, for reports and for the sampling query.
TRUE_VALUES = ("true", "1", "yes", "y", "t", "si", "sí")
SQL_TRUE_VALUES = ("true", "1", "yes", "y", "t")
# Fields of a transaction that may be shown, in order.
SHOWN_FIELDS = ["id", "timestamp", "amount", "amount_usd", "currency", "product", "merchant", "category", "city",
                "country", "channel", "type", "status", "response_code"]
RISK_FIELDS = ["rule_score", "model_score", "score", "level", "reasons"]
# A greeting at the start of a message.
GREETING = r"(?i)^\s*(hola|ol[áa]|buen[oa]s(\s+\w+)?|estimad[oa])\b[^,:.!\n]*[,:.!]?\s*"


def analyze_window(scored: DataFrame, days: int = DEFAULT_DAYS) -> DataFrame:
    """Scored rows of the last days before each customer's own last transaction."""
    return scored.filter(F.col("timestamp") >= F.col("customer_last") - F.expr(f"INTERVAL {max(days, 1)} DAY"))


def transaction_json(with_risk: bool = False, extra: tuple[str, ...] = ()) -> Column:
    """A transaction as JSON without label, customer and coordinates; empty fields are left out."""
    fields = [*SHOWN_FIELDS, *(RISK_FIELDS if with_risk else []), *extra]
    values = []
    for name in fields:
        value = F.col(name)
        if name == "timestamp":
            value = F.date_format(value, "yyyy-MM-dd HH:mm")
        elif name == "reasons":
            value = F.when(F.size(value) > 0, value)
        values.append(value.alias(name))
    return F.to_json(F.struct(*values))


def recent_transactions(history_rows: DataFrame, days: int = DEFAULT_DAYS, limit: int = 20, ceiling: int = 50
                        ) -> DataFrame:
    """Newest transactions of every customer within the last days, at most min(limit, ceiling), with the number
    of all transactions in these days (`total_in_window`) and the moment of the last one (`last_transaction`).

    The rank is limited before the shuffle. The totals are counts, combined in the map tasks.
    """
    k, back = max(min(limit, ceiling), 1), F.expr(f"INTERVAL {max(days, 1)} DAY")
    known = history_rows.filter(F.col("customer").isNotNull())
    last = known.groupBy("customer").agg(F.max("timestamp").alias("last_transaction"))
    totals = known.select("customer", "timestamp").join(last, "customer").filter(F.col("timestamp") >= F.col("last_transaction") - back).groupBy(
        "customer", "last_transaction").agg(F.count(F.lit(1)).alias("total_in_window"))
    newest = top_rows(known, ["customer"], [F.col("timestamp").desc(), F.col("id").desc()], k, rank="rank")
    inside = newest.join(totals, "customer").filter(F.col("timestamp") >= F.col("last_transaction") - back)
    return inside.select("customer", "rank", *SHOWN_FIELDS, "total_in_window", "last_transaction")


def suspicious_rows(window: DataFrame, settings: RuleSettings = DEFAULTS) -> DataFrame:
    return window.filter(F.col("score") >= settings.suspicious)


def top_suspicious(window: DataFrame, labels: DataFrame, threshold: float, k: int) -> DataFrame:
    """The k rows per customer with the highest scores at or above the threshold, with card labels.

    Equal scores keep the order of time.
    """
    best = top_rows(window.filter(F.col("score") >= threshold), ["customer"],
                    [F.col("score").desc(), F.col("timestamp"), F.col("id")], k, rank="rank")
    return best.join(labels.select(F.col("product_id").alias("product"), "card"), "product", "left")


def risk_assessment(window: DataFrame, settings: RuleSettings = DEFAULTS, alerts: DataFrame | None = None) -> DataFrame:
    """Per customer: rows analysed, suspicious rows, highest level and last moment.

    With `alerts` (customer_id, reviewed_period_end of `customer_alerts`) also `behavior_alert_until`, the end of
    the period that the behaviour alert is about; null without one.
    """
    suspicious = F.col("score") >= settings.suspicious
    top = F.max(F.when(suspicious, F.col("score")))
    found = window.groupBy("customer").agg(
        F.count(F.lit(1)).alias("transactions_analyzed"), F.count_if(suspicious).alias("suspicious_count"),
        F.when(top >= settings.high_risk, "high").when(top.isNotNull(), "medium").otherwise("low").alias("max_level"),
        F.max("customer_last").alias("until"))
    if alerts is None:
        return found
    until = alerts.select(F.col("customer_id").alias("customer"), F.col("reviewed_period_end").alias("behavior_alert_until"))
    return found.join(until, "customer", "left")


def monitor_high_risk(window: DataFrame, labels: DataFrame, settings: RuleSettings = DEFAULTS, k: int = 5) -> DataFrame:
    return top_suspicious(window, labels, settings.high_risk, k)


def top_signal_customers(transactions: DataFrame, days: int = DEFAULT_DAYS, limit: int = 15) -> DataFrame:
    """Customers with most labelled fraud, then with the highest model score, in the last days of the data."""
    logical = logical_transactions(transactions)
    last = logical.agg(F.max("timestamp")).scalar()
    scale = model_score_scale(logical).scalar()
    labelled = F.lower("fraud_label").isin(*SQL_TRUE_VALUES)
    recent = logical.filter(F.col("timestamp") >= last - F.expr(f"INTERVAL {int(days)} DAY"))
    totals = recent.groupBy("customer").agg(
        F.count(F.lit(1)).alias("tx_count"), (F.max("model_score") * scale).alias("max_model_score"),
        F.count_if(F.coalesce(labelled, F.lit(False))).alias("labeled_fraud"))
    return totals.orderBy(F.col("labeled_fraud").desc_nulls_last(), F.col("max_model_score").desc_nulls_last(),
                          "customer").limit(limit)


def evaluation_sample(transactions: DataFrame, customers: int, min_tx: int = 10, seed: int = 42) -> DataFrame:
    """Half customers with labelled fraud and half without, each chosen by the hash of id and seed."""
    logical = logical_transactions(transactions).select("customer", "fraud_label")
    labelled = F.coalesce(F.lower("fraud_label").isin(*SQL_TRUE_VALUES), F.lit(False))
    totals = logical.filter(F.col("customer").isNotNull()).groupBy("customer").agg(
        F.count(F.lit(1)).alias("n"), F.max(labelled).alias("has_fraud")).filter(F.col("n") >= min_tx)
    half = max(customers // 2, 1)
    order = [F.md5(F.concat(F.col("customer"), F.lit(f"#{seed}"))), F.col("customer")]
    halves = [totals.filter(F.col("has_fraud") == wanted).orderBy(*order).limit(half) for wanted in (True, False)]
    return union_all(halves).select("customer", "has_fraud")


def rules_evaluation(scored: DataFrame, settings: RuleSettings = DEFAULTS) -> DataFrame:
    """Alerts, precision and recall of rules, model and both at the two thresholds, in one pass."""
    truth = as_truth(F.col("fraud_label"), TRUE_VALUES)
    signals = {"rules": "rule_score", "model": "model_score", "combined": "score"}
    thresholds = (settings.suspicious, settings.high_risk)
    aggregates = [F.count_if(truth).alias("positives")]
    for signal, column in signals.items():
        for i, threshold in enumerate(thresholds):
            alert = F.coalesce(F.col(column).cast("double") >= threshold, F.lit(False))
            aggregates += [F.count_if(alert).alias(f"alerts_{signal}_{i}"),
                           F.count_if(alert & truth).alias(f"tp_{signal}_{i}")]
    totals = scored.agg(*aggregates)
    cells = [F.struct(F.lit(signal).alias("signal"), F.lit(float(threshold)).alias("threshold"),
                      F.col(f"alerts_{signal}_{i}").alias("alerts"), F.col(f"tp_{signal}_{i}").alias("true_positives"))
             for signal in signals for i, threshold in enumerate(thresholds)]
    rows = totals.select("positives", F.explode(F.array(*cells)).alias("c")).select("c.*", "positives")
    zero = F.lit(0.0)
    return rows.withColumns({
        "precision": F.coalesce(F.try_divide(F.col("true_positives").cast("double"), F.col("alerts")), zero),
        "recall": F.coalesce(F.try_divide(F.col("true_positives").cast("double"), F.col("positives")), zero)})


def alert_text(top: DataFrame, profiles: DataFrame, message: str, bank_name: str = "su banco") -> DataFrame:
    """Customer-facing text per customer: greeting, message, its top transactions and the safety note.

    `top` holds a few ranked rows per customer, so the collected lines are as few.
    """
    place = F.concat_ws(" ", F.coalesce(F.nullif(F.col("merchant"), F.lit("")), F.nullif(F.col("category"), F.lit(""))),
                        F.nullif(F.col("city"), F.lit("")))
    card = F.coalesce(F.concat(F.lit(" | "), F.nullif(F.col("card"), F.lit(""))), F.lit(""))
    line = F.concat(F.lit("- "), F.date_format("timestamp", "yyyy-MM-dd HH:mm"), F.lit(" | "),
                    F.format_number("amount", 2), F.lit(" "), F.coalesce("currency", F.lit("")), F.lit(" | "), place, card)
    lines = top.groupBy("customer").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("_l"))
    names = profiles.select(F.col("customer_id").alias("customer"), "first_name", "full_name")
    first = F.coalesce(F.when(present(F.col("first_name")), F.col("first_name")),
                       F.nullif(F.substring_index(F.coalesce("full_name", F.lit("")), " ", 1), F.lit("")),
                       F.lit("cliente"))
    body = F.btrim(F.lit(message))
    bare = F.btrim(F.regexp_replace(body, GREETING, ""))
    body = F.when(bare != "", bare).otherwise(body)
    text = F.concat_ws(
        "\n", F.concat(F.lit("Hola "), first, F.lit(",")), F.lit(""),
        F.concat(F.upper(F.substring(body, 1, 1)), F.substr(body, F.lit(2))), F.lit(""),
        F.lit("Transacciones en revisión:"), F.array_join(F.transform("_l", lambda x: x["line"]), "\n"), F.lit(""),
        F.lit(f"Si no reconoces estas transacciones, bloquea tu tarjeta desde la app o comunícate con la línea "
              f"oficial de {bank_name}."),
        F.lit(f"{bank_name[:1].upper()}{bank_name[1:]} nunca te pedirá contraseñas, PIN, CVV ni códigos por este medio."))
    return lines.join(names, "customer", "left").select("customer", text.alias("alert"))
