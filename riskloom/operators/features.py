"""Customer features: one row per eligible customer."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.numbers import age_at
from riskloom.operators.contracts import CUSTOMER_FEATURES, PRODUCT_TYPES, RAW_CUSTOMER_PRODUCTS, watched, write_valid
from riskloom.operators.currency import add_usd_amounts

# Product types that count as debt and as assets.
DEBT_TYPES = ("Préstamo Hipotecario", "Préstamo Personal", "Tarjeta Crédito")
ASSET_TYPES = ("Cuenta Ahorro", "Cuenta Corriente", "Seguro", "Inversión", "Tarjeta Débito")
INFO_COLUMNS = ["customer_id", "date_of_birth", "country", "segment", "credit_score", "income_usd", "occupation",
                "education_level", "customer_status"]
FEATURE_COLUMNS = [*INFO_COLUMNS, *PRODUCT_TYPES, "num_products", "Deuda_usd", "Activos_financieros_usd", "Edad"]


def _quoted(name: str):
    return F.col(f"`{name}`")


def active_customers(users: DataFrame) -> DataFrame:
    """Active customers with a credit score, an income and an occupation."""
    return users.filter(F.col("credit_score").isNotNull() & F.col("income").isNotNull()
                        & F.col("occupation").isNotNull() & (F.col("customer_status") == "Active"))


def with_known_income(users: DataFrame) -> DataFrame:
    """Without the customers whose income has no USD value."""
    return users.filter(F.col("income_usd").isNotNull())


def customers_without_income(users: DataFrame) -> DataFrame:
    """How many customers `with_known_income` leaves out."""
    return users.filter(F.col("income_usd").isNull()).agg(F.countDistinct("customer_id").alias("customers"))


def _with_balance(users: DataFrame) -> DataFrame:
    return users.filter(F.col("product_type").isNotNull() & F.col("current_balance_usd").isNotNull())


def unknown_products(users: DataFrame) -> DataFrame:
    """Product types that have a balance but no column in the features."""
    return _with_balance(users).filter(~F.col("product_type").isin(*PRODUCT_TYPES)).select("product_type").distinct()


def pivot_balances(users: DataFrame) -> DataFrame:
    """USD balance per customer and known product type; 0 where the customer has none.

    The fixed list of types spares the job that would look for them, and a customer with other
    types only keeps a row of zeros.
    """
    sums = _with_balance(users).groupBy("customer_id").pivot("product_type", list(PRODUCT_TYPES)).agg(
        F.sum("current_balance_usd"))
    return sums.select("customer_id", *[F.coalesce(_quoted(t), F.lit(0.0)).alias(t) for t in PRODUCT_TYPES])


def derive_features(balances: DataFrame) -> DataFrame:
    """Number of products with a balance, debt and assets; customers without any balance leave."""
    def total(types):
        return reduce(lambda a, b: a + b, [_quoted(t) for t in types])

    held = reduce(lambda a, b: a + b, [(_quoted(t) > 0).cast("int") for t in PRODUCT_TYPES])
    return (balances.withColumn("num_products", held)
                    .withColumn("Deuda_usd", total(DEBT_TYPES))
                    .withColumn("Activos_financieros_usd", total(ASSET_TYPES))
                    .filter(F.col("num_products") > 0))


def build_customer_features(users: DataFrame, as_of: dt.date | str, countries: DataFrame, rates: DataFrame) -> DataFrame:
    """The whole step, with its input contract (invalid rows leave) and its output contract.

    One pass: input rows are checked on their way into the aggregate, which takes the information and all balances of
    a customer together, and only the result is written.
    """
    valid, outcome = watched(users, RAW_CUSTOMER_PRODUCTS)
    active = with_known_income(add_usd_amounts(active_customers(valid), countries, rates))
    balances = [F.coalesce(F.sum(F.when(F.col("product_type") == t, F.col("current_balance_usd"))), F.lit(0.0)).alias(t) for t in PRODUCT_TYPES]
    grouped = active.groupBy("customer_id").agg(F.min(F.struct(*INFO_COLUMNS[1:])).alias("info"), *balances)
    features = (derive_features(grouped.select("customer_id", "info.*", *[_quoted(t) for t in PRODUCT_TYPES]))
                .withColumn("Edad", age_at(F.col("date_of_birth").try_cast("date"), as_of))
                .select(*FEATURE_COLUMNS))
    written = write_valid(features, CUSTOMER_FEATURES, "customer-features")[0]
    outcome()
    return written
