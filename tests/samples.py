"""A small bank for the tests: every value follows from a hash of customer, day and purpose."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

AS_OF = dt.date(2026, 6, 17)
RATES = {"COP": 0.00024, "MXN": 0.055, "ARS": 0.0011}
HOMES = [("México", "MXN"), (" argentina", "ARS"), ("COLOMBIA", "COP")]
HELD = ["Tarjeta Débito", "Tarjeta Crédito", "Préstamo Personal", "Inversión"]


def draw(modulus, *parts):
    """A number below the modulus that depends on the parts only."""
    return F.pmod(F.xxhash64(*[p if not isinstance(p, str) else F.lit(p) for p in parts]), F.lit(modulus))


def pick(choices, place):
    return F.element_at(F.array(*[F.lit(c) for c in choices]), (place % len(choices) + 1).cast("int"))


def name_of(number):
    return F.format_string("K%05d", number)


def bank_customers(spark, n):
    """n active customers; number i lives in country i mod 3."""
    number, currency = F.col("id"), pick([c for _, c in HOMES], F.col("id"))
    rate = sum((F.when(currency == c, r).otherwise(0.0) for c, r in RATES.items()), F.lit(0.0))
    return spark.range(n).select(
        name_of(number).alias("customer_id"), F.date_add(F.lit(dt.date(1951, 2, 3)), draw(17000, number, "born").cast("int")).alias("date_of_birth"),
        pick([h for h, _ in HOMES], number).alias("country"), pick(["Joven", "Clásico"], number).alias("segment"),
        (draw(440, number, "score") + 380).cast("double").alias("credit_score"), ((draw(5500, number, "income") + 500) / rate).alias("estimated_monthly_income"),
        F.lit("Docente").alias("occupation"), pick(["Primaria", "Posgrado", "Técnica"], draw(3, number, "school")).alias("education_level"),
        F.lit("Active").alias("customer_status"), F.concat(F.lit("Nombre"), number).alias("first_name"), F.lit("Apellido").alias("last_name"),
        F.concat(name_of(number), F.lit("@correo.example")).alias("email"), F.concat(F.lit("+57 31"), F.lpad(number.cast("string"), 8, "0")).alias("mobile_phone"),
        F.lit("neutral").alias("detected_accent"), F.lit("Quito").alias("city"), F.lit(dt.datetime(2026, 5, 2)).alias("last_updated"))


def bank_products(spark, n):
    """Customer i holds the first i mod 4 + 1 kinds of product."""
    held = spark.range(n).select("id", F.explode(F.sequence(F.lit(0), (F.col("id") % 4).cast("int"))).alias("k"))
    return held.select(
        F.concat_ws("/", name_of(F.col("id")), F.col("k").cast("string")).alias("product_id"), name_of(F.col("id")).alias("customer_id"),
        pick(HELD, F.col("k")).alias("product_type"), F.lpad(draw(10 ** 15, F.col("id"), F.col("k")).cast("string"), 16, "4").alias("product_number"),
        pick([c for _, c in HOMES], F.col("id")).alias("currency"), (draw(90_000, F.col("id"), F.col("k"), "balance") + 50).cast("double").alias("current_balance"),
        F.lit(100.0).alias("credit_limit"), F.lit("Active").alias("product_status"), F.lit(dt.datetime(2026, 5, 2)).alias("last_updated"))


def purchases(customers, start, days, of_ten=3, purpose="x"):
    """Purchases near the `level` of each customer (customer_id, level), on about `of_ten` days in ten."""
    who = F.col("customer_id")
    rows = customers.select("customer_id", "level", F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("day"))
    rows = rows.filter(draw(10, who, F.col("day"), purpose) < of_ten)
    minute = 540 + draw(600, who, F.col("day"), purpose, "minute")
    amount = F.round(F.col("level") * (0.93 + draw(1400, who, F.col("day"), purpose, "amount") / 10_000), 2)
    moment = F.lit(dt.datetime.combine(start, dt.time())) + F.make_dt_interval(F.col("day"), F.lit(0), minute.cast("int"))
    return rows.select(
        F.concat_ws("-", F.lit(purpose), who, F.col("day").cast("string")).alias("transaction_id"), moment.cast("timestamp_ntz").alias("transaction_date"),
        F.concat_ws("/", who, F.lit("0")).alias("product_id"), "customer_id", F.lit("Compra").alias("transaction_type"), amount.alias("amount"),
        F.lit("USD").alias("currency"), amount.alias("amount_usd"), F.lit("Ecuador").alias("transaction_country"), F.lit("Quito").alias("transaction_city"),
        F.lit("Approved").alias("transaction_status"), F.lit(False).alias("is_fraud"), draw(1000, who, F.col("day"), "model").cast("double").alias("fraud_score"))


def levels(spark, given):
    return spark.createDataFrame([(k, float(v)) for k, v in given.items()], "customer_id string, level double")


def purchase_table(spark, given, start, days, of_ten, purpose="x"):
    """The same as a pandas frame in a fixed order."""
    return purchases(levels(spark, given), start, days, of_ten, purpose).orderBy("customer_id", "transaction_date").toPandas()


def frame(spark, table):
    """A Spark frame; missing values become null and times have no zone."""
    def plain(value):
        if value is None or value is pd.NaT or (isinstance(value, float) and np.isnan(value)):
            return None
        return value.to_pydatetime() if isinstance(value, pd.Timestamp) else value.item() if isinstance(value, np.generic) else value

    rows = [tuple(plain(v) for v in row) for row in table.itertuples(index=False)]
    return spark.createDataFrame(rows, schema_of(table))


def schema_of(table):
    kinds = {"f": "double", "i": "bigint", "b": "boolean", "M": "timestamp_ntz"}
    parts = []
    for name in table.columns:
        kind = kinds.get(table[name].dtype.kind)
        if kind is None:
            first = table[name].dropna().iloc[0] if table[name].notna().any() else ""
            kind = ("boolean" if isinstance(first, bool) else "double" if isinstance(first, float)
                    else "timestamp_ntz" if isinstance(first, dt.datetime) else "date" if isinstance(first, dt.date) else "string")
        parts.append(f"`{name}` {kind}")
    return ", ".join(parts)
