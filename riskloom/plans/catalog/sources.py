"""Readers, file sources and logical views."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import functions as F

from riskloom.functions.text import normalize_key
from riskloom.operators.currency import quotes_as_of, usd_rates_from_quotes
from riskloom.operators.features import build_customer_features
from riskloom.plans.bridge import BankTables
from riskloom.plans.catalog.common import (AS_OF, CUSTOMER_FIELDS, FEATURE_DOUBLES, PRODUCT_FIELDS, RATES_AS_OF, RECENT, TRANSACTION_FIELDS,
                                           inside)
from riskloom.plans.catalog.registry import query, rounded
from riskloom.session import shared_folder
from riskloom.sources import files, logical, tables

SUSPENDED = "customer_status = 'Suspended'"


def scratch(t: BankTables, name: str) -> str:
    return os.path.join(shared_folder(t.spark), "riskloom", f"{name}-{uuid.uuid4().hex}")


@query("src_customers_latest", "SELECT * FROM customers_newest")
def src_customers_latest(t: BankTables):
    return tables.customers_latest(t.customers)


@query("src_products_latest", "SELECT * FROM products_newest")
def src_products_latest(t: BankTables):
    return tables.products_latest(t.products)


@query("src_customer_products", "SELECT * EXCLUDE (product_id) FROM customer_products ORDER BY customer_id, product_id")
def src_customer_products(t: BankTables):
    rows = tables.customers_with_products(t.customers, t.products)
    return rows.orderBy(F.asc_nulls_last("customer_id"), F.asc_nulls_last("product_id")).drop("product_id")


@query("src_transactions_window", f"""
SELECT {TRANSACTION_FIELDS} FROM transactions
WHERE {inside(RECENT)} AND customer_id IN (SELECT customer_id FROM customers WHERE {SUSPENDED})
QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY transaction_date DESC) = 1""")
def src_transactions_window(t: BankTables):
    return tables.transactions_in_window(t.transactions, RECENT, t.customers.filter(SUSPENDED))


@query("src_usd_rates_asof", f"""
WITH quotes AS (
  SELECT * FROM daily_exchange_rates
  WHERE date = (SELECT max(date) FROM daily_exchange_rates WHERE date <= DATE '{RATES_AS_OF}')
    AND 'USD' IN (source_currency, target_currency) AND exchange_rate > 0),
found AS (
  SELECT source_currency AS currency, exchange_rate AS usd_rate, 0 AS p, quote_id FROM quotes
  WHERE target_currency = 'USD' AND source_currency <> 'USD'
  UNION ALL
  SELECT target_currency, 1.0 / exchange_rate, 1, quote_id FROM quotes
  WHERE source_currency = 'USD' AND target_currency <> 'USD')
SELECT currency, round(usd_rate, 9) AS usd_rate FROM found
QUALIFY row_number() OVER (PARTITION BY currency ORDER BY p, quote_id DESC) = 1
UNION ALL SELECT 'USD', 1.0""")
def src_usd_rates_asof(t: BankTables):
    return rounded(usd_rates_from_quotes(quotes_as_of(t.exchange_rates, RATES_AS_OF), "quote_id"), 9)


@query("reader_customers", f"""
SELECT {CUSTOMER_FIELDS} FROM customers WHERE customer_id IN (SELECT customer_id FROM products WHERE currency = 'CLP')""")
def reader_customers(t: BankTables):
    return tables.read_customers(t.customers, t.products.filter("currency = 'CLP'"))


@query("reader_products", f"""
SELECT {PRODUCT_FIELDS}, credit_limit FROM products
WHERE customer_id IN (SELECT customer_id FROM customers WHERE {SUSPENDED})""")
def reader_products(t: BankTables):
    return tables.read_products(t.products, t.customers.filter(SUSPENDED))


@query("reader_users", f"""
SELECT c.*, p.product_id, p.product_type, p.currency, p.current_balance, p.credit_limit
FROM (SELECT {CUSTOMER_FIELDS} FROM customers) c LEFT JOIN products p USING (customer_id)""")
def reader_users(t: BankTables):
    return tables.read_users(t.customers, t.products)


@query("reader_transactions", """
SELECT * FROM transactions WHERE transaction_date >= DATE '2024-01-10' AND transaction_date < DATE '2024-01-20'
ORDER BY transaction_date, transaction_id""")
def reader_transactions(t: BankTables):
    return tables.read_transactions(t.transactions, None, "2024-01-10", "2024-01-19")


@query("reader_transactions_all", f"""
SELECT {TRANSACTION_FIELDS}, is_fraud FROM transactions ORDER BY transaction_date, transaction_id""")
def reader_transactions_all(t: BankTables):
    return tables.read_transactions_all(t.transactions)


@query("tx_logical_view", "SELECT * FROM logical_tx")
def tx_logical_view(t: BankTables):
    return logical.logical_transactions(t.transactions)


@query("tx_logical_view_other_names", """
SELECT cast(o_orderkey AS VARCHAR) AS id, cast(o_custkey AS VARCHAR) AS customer, o_orderdate AS timestamp,
       o_totalprice AS amount, cast(NULL AS DOUBLE) AS amount_usd, cast(NULL AS VARCHAR) AS currency,
       cast(NULL AS DOUBLE) AS model_score, o_orderstatus AS status, TRY_CAST(o_orderpriority AS DOUBLE) AS lat FROM orders""")
def tx_logical_view_other_names(t: BankTables):
    renamed = t.base("orders").withColumnsRenamed({
        "o_orderkey": "ID", "o_custkey": "Client_Id", "o_orderdate": "created_at", "o_totalprice": "value",
        "o_orderstatus": "Status", "o_orderpriority": "lat"})
    return logical.logical_transactions(renamed).select("id", "customer", "timestamp", "amount", "amount_usd", "currency",
                                                        "model_score", "status", "lat")


@query("score_scale", """
SELECT 'as stored' AS scores, CASE WHEN max(model_score) <= 1.0 THEN 100.0 ELSE 1.0 END::DOUBLE AS scale FROM logical_tx
UNION ALL
SELECT 'as probability', CASE WHEN max(model_score / 100) <= 1.0 THEN 100.0 ELSE 1.0 END FROM logical_tx""")
def score_scale(t: BankTables):
    rows = logical.logical_transactions(t.transactions)
    small = rows.withColumn("model_score", F.col("model_score") / 100)
    stored = logical.model_score_scale(rows).select(F.lit("as stored").alias("scores"), "scale")
    return stored.unionByName(logical.model_score_scale(small).select(F.lit("as probability").alias("scores"), "scale"))


@query("tx_history", """
SELECT id, customer, timestamp, amount, amount_usd, status
FROM (SELECT * REPLACE (CASE WHEN id LIKE '%77' THEN NULL ELSE timestamp END AS timestamp) FROM tx_history_rows)
WHERE timestamp IS NOT NULL""")
def tx_history(t: BankTables):
    rows = logical.logical_transactions(t.transactions).withColumn(
        "timestamp", F.when(~F.col("id").like("%77"), F.col("timestamp")))
    return logical.history(rows).select("id", "customer", "timestamp", "amount", "amount_usd", "status")


@query("profile_latest", """
SELECT customer_id, first_name, last_name, email, mobile_phone AS phone, country, preferred_language AS language, segment,
       customer_status AS status, detected_accent AS accent, city, strftime(last_updated, '%Y-%m-%d %H:%M:%S') AS updated_at,
       nullif(concat_ws(' ', nullif(first_name, ''), nullif(last_name, '')), '') AS full_name
FROM customers QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY last_updated DESC) = 1""")
def profile_latest(t: BankTables):
    return logical.latest_profiles(t.customers)


@query("product_labels", "SELECT * FROM labels_of_products")
def product_labels(t: BankTables):
    return logical.product_labels(t.products)


AGENT_LIST = ", ".join(tables.AGENT_COLUMNS)


@query("agents_active", f"SELECT DISTINCT {AGENT_LIST} FROM service_agents WHERE agent_status = 'Active'")
def agents_active(t: BankTables):
    return tables.active_agents(t.agents)


@query("src_customer_list_file", """
SELECT customer_id, round(anomaly_score, 6) AS anomaly_score FROM (
  SELECT DISTINCT customer_id, credit_score / 1000 AS anomaly_score FROM customers_newest WHERE customer_status = 'Closed')""")
def src_customer_list_file(t: BankTables):
    rows = tables.customers_latest(t.customers).filter("customer_status = 'Closed'").select(
        F.col("customer_id").alias("Customer_ID"), (F.col("credit_score") / 1000).alias("anomaly_score"))
    path = scratch(t, "customer-list")
    rows.write.csv(path, header=True)
    return rounded(files.read_customer_list(t.spark, path))


@query("src_contact_map_file", """
SELECT customer_id, email, nullif(trim(CASE WHEN customer_status = 'Closed' THEN ' ' ELSE phone END), '') AS whatsapp FROM (
  SELECT customer_id, email, mobile_phone AS phone, customer_status FROM customers
  QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY last_updated DESC) = 1)""")
def src_contact_map_file(t: BankTables):
    rows = logical.latest_profiles(t.customers).select(
        "customer_id", F.concat(F.lit(" "), F.col("email")).alias("Email "),
        F.when(F.col("status") == "Closed", " ").otherwise(F.col("phone")).alias("whatsapp"))
    path = scratch(t, "contact-map")
    rows.write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return files.read_contact_map(t.spark, path)


@query("src_currency_config", """
SELECT c.customer_id, cc.income_currency, r.usd_rate FROM customers_newest c
JOIN country_currencies cc ON cc.country_key = lower(trim(strip_accents(c.country)))
JOIN usd_rates r ON r.currency = cc.income_currency""")
def src_currency_config(t: BankTables):
    path = scratch(t, "currency-config")
    text = json.dumps({"country_currency": files.COUNTRY_CURRENCY, "currency_to_usd": files.CURRENCY_TO_USD})
    t.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    countries, rates = files.read_currency_config(t.spark, path)
    people = tables.customers_latest(t.customers).select("customer_id", normalize_key(F.col("country")).alias("country_key"))
    return (people.join(countries, "country_key")
                  .join(rates.withColumnRenamed("currency", "income_currency"), "income_currency")
                  .select("customer_id", "income_currency", "usd_rate"))


@query("src_clean_customers_csv", "SELECT * REPLACE (cast(date_of_birth AS VARCHAR) AS date_of_birth) FROM customer_features",
       rounds=FEATURE_DOUBLES, digits=8)
def src_clean_customers_csv(t: BankTables):
    countries, rates = files.currency_frames(t.spark)
    features = build_customer_features(tables.customers_with_products(t.customers, t.products), AS_OF, countries, rates)
    path = scratch(t, "clean-customers")
    features.write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return rounded(files.read_clean_customers(t.spark, path), 8)
