"""Readers of the bank tables: newest versions, date windows and column selections."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.numbers import DayWindow, as_date
from riskloom.operators.scaling import latest_rows, left_join_many

# Columns handed on by each reader.
CUSTOMER_COLUMNS = ["customer_id", "date_of_birth", "country", "segment", "credit_score", "income", "occupation",
                    "education_level", "customer_status"]
PRODUCT_COLUMNS = ["product_id", "customer_id", "product_type", "currency", "current_balance"]
TRANSACTION_COLUMNS = ["transaction_id", "transaction_date", "product_id", "customer_id", "transaction_type", "amount",
                       "currency", "amount_usd", "transaction_country", "transaction_city", "transaction_status"]
ALL_TRANSACTION_COLUMNS = [
    "transaction_id", "transaction_date", "process_date", "product_id", "customer_id", "transaction_type",
    "transaction_category", "amount", "currency", "amount_usd", "channel", "branch_id", "merchant_name",
    "merchant_category", "transaction_country", "transaction_city", "transaction_status", "response_code", "is_fraud",
    "fraud_score", "latitude", "longitude", "filename", "day", "month", "year"]
PAGED_TRANSACTION_COLUMNS = [*TRANSACTION_COLUMNS, "is_fraud"]


def _customer_fields(customers: DataFrame) -> DataFrame:
    return customers.withColumnRenamed("estimated_monthly_income", "income")


def customers_latest(customers: DataFrame) -> DataFrame:
    """Newest record of every customer. Records with the same time are ordered by their content."""
    fields = _customer_fields(customers).select(*CUSTOMER_COLUMNS, "last_updated")
    ties = [F.col(c) for c in CUSTOMER_COLUMNS if c != "customer_id"]
    return latest_rows(fields, ["customer_id"], "last_updated", ties).select(*CUSTOMER_COLUMNS)


def products_latest(products: DataFrame) -> DataFrame:
    """Newest record of every product."""
    fields = products.select(*PRODUCT_COLUMNS, "last_updated")
    ties = [F.col(c) for c in PRODUCT_COLUMNS if c != "product_id"]
    return latest_rows(fields, ["product_id"], "last_updated", ties).select(*PRODUCT_COLUMNS)


def customers_with_products(customers: DataFrame, products: DataFrame) -> DataFrame:
    """One row per customer and product; a customer without products appears once.

    Not sorted: callers that show the rows order them by customer and product.
    """
    joined = left_join_many(customers_latest(customers), products_latest(products), "customer_id",
                            products.select("customer_id"))
    return joined.select(*CUSTOMER_COLUMNS, "product_id", "product_type", "currency", "current_balance")


def _only_customers(df: DataFrame, customer_ids: DataFrame | None) -> DataFrame:
    if customer_ids is None:
        return df
    return df.join(customer_ids.select("customer_id").distinct(), "customer_id", "left_semi")


def transactions_in_window(transactions: DataFrame, window: DayWindow, customer_ids: DataFrame | None = None,
                           extra: tuple[str, ...] = ()) -> DataFrame:
    """Transactions of the window, newest row per id among the rows inside it."""
    columns = [*TRANSACTION_COLUMNS, *extra]
    inside = transactions.filter(window.contains(F.col("transaction_date"))).select(*columns)
    ties = [F.col(c) for c in columns if c not in ("transaction_id", "transaction_date")]
    return latest_rows(_only_customers(inside, customer_ids), ["transaction_id"], "transaction_date", ties)


def read_customers(customers: DataFrame, customer_ids: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Customer columns without removing versions."""
    found = _only_customers(_customer_fields(customers).select(*CUSTOMER_COLUMNS), customer_ids)
    return found if limit is None else found.limit(limit)


def read_products(products: DataFrame, customer_ids: DataFrame) -> DataFrame:
    """Products of the given customers, with the credit limit."""
    return _only_customers(products.select(*PRODUCT_COLUMNS, "credit_limit"), customer_ids)


def read_users(customers: DataFrame, products: DataFrame, customer_ids: DataFrame | None = None,
               limit: int | None = None) -> DataFrame:
    """Every customer record with every product record of that customer.

    Versions are kept on both sides, so the customer side may repeat a key; frequent keys sit on
    the product side.
    """
    people = read_customers(customers, customer_ids, limit)
    owned = products.select(*PRODUCT_COLUMNS, "credit_limit")
    return left_join_many(people, owned, "customer_id", products.select("customer_id"))


def read_transactions(transactions: DataFrame, customer_ids: DataFrame | None = None,
                      first_day: dt.date | str | None = None, last_day: dt.date | str | None = None,
                      limit: int | None = None, columns: list[str] = ALL_TRANSACTION_COLUMNS) -> DataFrame:
    """Transactions between two days, both included, ordered by time and id; versions are kept."""
    found = transactions
    if first_day is not None:
        found = found.filter(F.col("transaction_date") >= F.lit(as_date(first_day)))
    if last_day is not None:
        found = found.filter(F.col("transaction_date") < F.lit(as_date(last_day) + dt.timedelta(days=1)))
    ordered = _only_customers(found.select(*columns), customer_ids).orderBy("transaction_date", "transaction_id")
    return ordered if limit is None else ordered.limit(limit)


def read_transactions_all(transactions: DataFrame, first_day: dt.date | str | None = None,
                          last_day: dt.date | str | None = None, limit: int | None = None) -> DataFrame:
    """The 12 columns of the paged reader. Spark partitions stand in for the pages."""
    return read_transactions(transactions, None, first_day, last_day, limit, PAGED_TRANSACTION_COLUMNS)


# Columns of an agent used for routing.
AGENT_COLUMNS = ["agent_id", "first_name", "last_name", "email", "native_accent", "country_of_origin", "agent_type",
                 "experience_level", "languages", "specialty", "avg_csat", "total_monthly_interactions", "work_shift"]


def active_agents(agents: DataFrame) -> DataFrame:
    """Active agents, one row each."""
    active = agents.filter(F.col("agent_status") == "Active").select(*AGENT_COLUMNS)
    return latest_rows(active, ["agent_id"], "agent_id", [F.col(c) for c in AGENT_COLUMNS[1:]])
