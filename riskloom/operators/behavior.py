"""Transaction behaviour: one row per customer and date window."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.numbers import DayWindow, ratio
from riskloom.operators.contracts import RAW_TRANSACTIONS, TRANSACTION_BEHAVIOR, write_valid
from riskloom.operators.currency import fill_usd_amount
from riskloom.operators.scaling import (MAX_GROUP_ROWS, latest_rows, oversized_groups, quantiles_by_rank, small_side,
                                        top_rows)

# Metrics that are put on a 30-day scale, and metrics compared as they are.
RATE_METRICS = ["num_transacciones", "monto_total_usd", "num_dias_activos", "num_productos", "num_tipos_transaccion",
                "num_monedas", "num_paises_transaccion", "num_ciudades_transaccion"]
PLAIN_METRICS = ["monto_promedio_usd", "monto_mediano_usd", "monto_maximo_usd", "monto_p95_usd", "monto_std_usd",
                 "transacciones_por_dia_activo", "porcentaje_fin_semana", "porcentaje_nocturnas", "tasa_aprobacion",
                 "participacion_tipo_dominante"]
QUANTILES = {"monto_mediano_usd": 0.5, "monto_p95_usd": 0.95}
BEHAVIOR_COLUMNS = [
    "customer_id", "num_transacciones", "num_dias_activos", "num_meses_activos", "monto_total_usd",
    "monto_promedio_usd", "monto_mediano_usd", "monto_maximo_usd", "monto_p95_usd", "monto_std_usd", "num_productos",
    "num_tipos_transaccion", "num_monedas", "num_paises_transaccion", "num_ciudades_transaccion",
    "porcentaje_fin_semana", "porcentaje_nocturnas", "tasa_aprobacion", "porcentaje_amount_usd_faltante",
    "transacciones_promedio_mes", "transacciones_promedio_mes_activo", "transacciones_por_dia_activo",
    "tipo_transaccion_dominante", "participacion_tipo_dominante"]


def select_window(transactions: DataFrame, window: DayWindow) -> DataFrame:
    """Rows of a half-open window of days; a date that cannot be read is outside."""
    moment = F.col("transaction_date")
    if isinstance(transactions.schema["transaction_date"].dataType, T.StringType):
        moment = moment.try_cast("timestamp_ntz")
    return transactions.filter(window.contains(moment))


def latest_moment_windows(transactions: DataFrame, baseline_months: int = 12, recent_days: int = 30) -> DataFrame:
    """One row with the closed baseline and recent intervals counted back from the last moment."""
    last = transactions.agg(F.max("transaction_date").alias("recent_end"))
    day = F.expr("INTERVAL 1 DAY")
    return (last.withColumn("recent_start", F.col("recent_end") - F.expr(f"INTERVAL {recent_days - 1} DAY"))
                .withColumn("baseline_end", F.col("recent_start") - day)
                .withColumn("baseline_start",
                            F.col("baseline_end") - F.expr(f"INTERVAL {baseline_months} MONTH") + day)
                .select("baseline_start", "baseline_end", "recent_start", "recent_end"))


def split_by_latest_moment(transactions: DataFrame, baseline_months: int = 12, recent_days: int = 30) -> DataFrame:
    """Rows of the two closed intervals, with `period` = baseline or recent."""
    bounds = latest_moment_windows(transactions, baseline_months, recent_days)
    at = {c: bounds.select(c).scalar() for c in bounds.columns}
    moment = F.col("transaction_date")
    period = (F.when(moment.between(at["recent_start"], at["recent_end"]), "recent")
               .when(moment.between(at["baseline_start"], at["baseline_end"]), "baseline"))
    return transactions.withColumn("period", period).filter(F.col("period").isNotNull())


def dedup_transactions(transactions: DataFrame) -> DataFrame:
    """One row per transaction id: the last by time, then by content."""
    ties = [F.col(c).desc_nulls_last() for c in transactions.columns if c not in ("transaction_id", "transaction_date")]
    return latest_rows(transactions, ["transaction_id"], "transaction_date", ties)


def clean_amounts(transactions: DataFrame) -> DataFrame:
    return fill_usd_amount(dedup_transactions(transactions))


def calendar_columns(transactions: DataFrame) -> DataFrame:
    """Hour, weekday (Monday is 0), weekend, night, day, month and approval of every transaction."""
    moment = F.col("transaction_date")
    hour, weekday = F.hour(moment), F.weekday(moment)
    return transactions.withColumns({
        "transaction_day": moment.cast("date"),
        "transaction_hour": hour,
        "transaction_weekday": weekday,
        "is_weekend": weekday >= 5,
        "is_night": (hour < 6) | (hour >= 22),
        "transaction_month": F.year(moment) * 100 + F.month(moment),
        "is_approved": F.coalesce(F.col("transaction_status") == "Approved", F.lit(False)),
    })


def _share(flag: str) -> Column:
    return F.avg(F.col(flag).cast("double"))


DISTINCT_METRICS = {"num_dias_activos": "transaction_day", "num_meses_activos": "transaction_month",
                    "num_productos": "product_id", "num_tipos_transaccion": "transaction_type", "num_monedas": "currency",
                    "num_paises_transaccion": "transaction_country", "num_ciudades_transaccion": "transaction_city"}


def count_metrics(by_sets: bool = False) -> dict[str, Column]:
    """Distinct counts. Transactions are unique on their id here, so they are simply counted.

    The sets of a customer of ordinary size are counted in one pass. `countDistinct` expands the
    rows once per column, but its state is shuffled by value, so no task holds the set of one customer.
    """
    def distinct(column: str) -> Column:
        return F.size(F.collect_set(column)).cast("bigint") if by_sets else F.countDistinct(column)

    return {"num_transacciones": F.count("transaction_id"),
            **{name: distinct(column) for name, column in DISTINCT_METRICS.items()}}


def amount_metrics() -> dict[str, Column]:
    """Totals of the USD amount; the sum of nothing is 0."""
    amount = F.col("amount_usd")
    return {
        "monto_total_usd": F.coalesce(F.sum(amount), F.lit(0.0)),
        "monto_promedio_usd": F.avg(amount),
        "monto_maximo_usd": F.max(amount),
        "monto_std_usd": F.stddev_samp(amount),
    }


def share_metrics() -> dict[str, Column]:
    return {
        "porcentaje_fin_semana": _share("is_weekend"),
        "porcentaje_nocturnas": _share("is_night"),
        "tasa_aprobacion": _share("is_approved"),
        "porcentaje_amount_usd_faltante": F.avg(F.col("amount_usd").isNull().cast("double")),
    }


def aggregate(transactions: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    return transactions.groupBy("customer_id").agg(*[c.alias(n) for n, c in metrics.items()])


def frequency_metrics(behavior: DataFrame, months: int | Column) -> DataFrame:
    """Transactions per month of the period, per active month and per active day."""
    n = F.col("num_transacciones")
    months = months if isinstance(months, Column) else F.lit(months)
    return behavior.withColumns({
        "transacciones_promedio_mes": ratio(n, months),
        "transacciones_promedio_mes_activo": ratio(n, F.col("num_meses_activos")),
        "transacciones_por_dia_activo": ratio(n, F.col("num_dias_activos")),
    })


def months_in_data(transactions: DataFrame) -> DataFrame:
    """One row: calendar months between the first and the last transaction, both counted."""
    first, last = F.min("transaction_date"), F.max("transaction_date")
    return transactions.agg(((F.year(last) - F.year(first)) * 12 + F.month(last) - F.month(first) + 1).alias("months"))


def dominant_type(transactions: DataFrame) -> DataFrame:
    """Most frequent type per customer and its count; ties go to the first in the alphabet."""
    counts = (transactions.filter(F.col("transaction_type").isNotNull())
                          .groupBy("customer_id", "transaction_type").agg(F.count(F.lit(1)).alias("_count")))
    best = top_rows(counts, ["customer_id"], [F.col("_count").desc(), F.col("transaction_type")])
    return best.select("customer_id", F.col("transaction_type").alias("tipo_transaccion_dominante"), "_count")


def add_dominant_type(behavior: DataFrame, transactions: DataFrame) -> DataFrame:
    joined = behavior.join(dominant_type(transactions), "customer_id", "left")
    return joined.withColumn("participacion_tipo_dominante",
                             ratio(F.col("_count"), F.col("num_transacciones"))).drop("_count")


def behavior_metrics(transactions: DataFrame, months: int | None = None, max_group_rows: int = MAX_GROUP_ROWS,
                     rows: int | None = None) -> DataFrame:
    """All metrics from cleaned transactions (unique ids, USD amount filled).

    `transactions` should be a written table: unless few `rows` are known, the largest customer is
    looked up first.
    Sets and quantiles are built in a task for ordinary customers only, whose rows are brought together first, so that no
    set travels; for the others sums are combined in the map tasks, distinct values are shuffled and quantiles go by rank.
    """
    prepared = calendar_columns(transactions.filter(
        F.col("customer_id").isNotNull() & F.col("transaction_date").isNotNull()))
    others = {**amount_metrics(), **share_metrics()}
    in_task = {name: F.percentile("amount_usd", F.lit(p)) for name, p in QUANTILES.items()}
    large, n = oversized_groups(transactions, ["customer_id"], max_group_rows, rows)
    if large is None:
        behavior = aggregate(prepared.repartition("customer_id"), {**count_metrics(by_sets=True), **others, **in_task})
    else:
        marker = small_side(large.select("customer_id"), n)
        heavy = prepared.join(marker, "customer_id", "left_semi")
        usual = prepared.join(marker, "customer_id", "left_anti")
        by_rank = aggregate(heavy, {**count_metrics(), **others}).join(
            quantiles_by_rank(heavy.select("customer_id", "amount_usd"), ["customer_id"], "amount_usd", QUANTILES),
            "customer_id")
        behavior = aggregate(usual.repartition("customer_id"), {**count_metrics(by_sets=True), **others, **in_task}).unionByName(by_rank)
    period = months_in_data(prepared).scalar() if months is None else F.lit(months)
    behavior = add_dominant_type(frequency_metrics(behavior, period), prepared)
    return behavior.select(*BEHAVIOR_COLUMNS)


def build_transaction_behavior(transactions: DataFrame, window: DayWindow | None,
                               max_group_rows: int = MAX_GROUP_ROWS, unique: bool = False) -> DataFrame:
    """Clean, check, aggregate and check again. No transactions give no rows.

    Without a window the period is taken from the data. `unique` spares the sort for transactions
    that come from the reader with one row per id.
    """
    cleaned = fill_usd_amount(transactions) if unique else clean_amounts(transactions)
    valid, checked = write_valid(cleaned, RAW_TRANSACTIONS, "transactions", mode="drop")
    months = window.months_touched if window else None
    metrics = behavior_metrics(valid, months, max_group_rows, checked.seen)
    return write_valid(metrics, TRANSACTION_BEHAVIOR, "behavior")[0]


def normalize_period(behavior: DataFrame, period_days: int) -> DataFrame:
    """Adds `<metric>_monthly`, the rate metrics per 30 days."""
    factor = 30.0 / period_days
    return behavior.withColumns({f"{m}_monthly": F.col(m).cast("double") * factor
                                 for m in RATE_METRICS if m in behavior.columns})


def profile_metrics(columns: Iterable[str]) -> list[str]:
    """Metrics that are compared with a profile, in their fixed order."""
    known = set(columns)
    return [m for m in [*(f"{r}_monthly" for r in RATE_METRICS), *PLAIN_METRICS] if m in known]


def window_behavior(transactions: DataFrame, window: DayWindow, max_group_rows: int = MAX_GROUP_ROWS,
                    unique: bool = False) -> DataFrame:
    """Select the window, aggregate and put the rates on a 30-day scale."""
    behavior = build_transaction_behavior(select_window(transactions, window), window, max_group_rows, unique)
    return normalize_period(behavior, window.days)
