"""Currency, text keys and customer features."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.numbers import age_at
from riskloom.functions.text import normalize_key
from riskloom.operators import contracts as C
from riskloom.operators import features as X
from riskloom.operators.currency import add_usd_amounts, fill_usd_amount, usd_rates_from_quotes
from riskloom.plans.bridge import BankTables
from riskloom.plans.catalog.common import AGE, AS_OF, FEATURE_DOUBLES, normalized
from riskloom.plans.catalog.contracts import _counts, above, below, infinite, required
from riskloom.plans.catalog.registry import query, rounded, view
from riskloom.sources.files import currency_frames
from riskloom.sources.tables import customers_latest, customers_with_products

MONEY = 8       # an amount with two decimals times a rate with six


def users(t: BankTables):
    return customers_with_products(t.customers, t.products)


def active_users(t: BankTables):
    valid = C.valid_rows(users(t), C.RAW_CUSTOMER_PRODUCTS)
    return X.active_customers(valid)


def users_usd(t: BankTables):
    return add_usd_amounts(active_users(t), *currency_frames(t.spark))


def feature_rows(t: BankTables):
    return X.build_customer_features(users(t), AS_OF, *currency_frames(t.spark))


@query("normalize_key", f"""
SELECT doc_id, {normalized("concat('  ÁÉ', text, 'ñÜ  ')")} AS key FROM documents""")
def normalize_key_query(t: BankTables):
    text = F.concat(F.lit("  ÁÉ"), F.col("text"), F.lit("ñÜ  "))
    return t.base("documents").select("doc_id", normalize_key(text).alias("key"))


@query("country_currency_map", f"""
SELECT c.customer_id, c.country, cc.income_currency FROM customers_newest c
LEFT JOIN country_currencies cc ON cc.country_key = {normalized('c.country')}""")
def country_currency_map(t: BankTables):
    countries, _ = currency_frames(t.spark)
    people = customers_latest(t.customers).select("customer_id", "country", normalize_key(F.col("country")).alias("country_key"))
    return people.join(F.broadcast(countries), "country_key", "left").select("customer_id", "country", "income_currency")


@query("usd_rates_from_rows", """
WITH found AS (
  SELECT date, source_currency AS currency, exchange_rate AS usd_rate, 0 AS p, quote_id FROM daily_exchange_rates
  WHERE target_currency = 'USD' AND source_currency <> 'USD' AND exchange_rate > 0
  UNION ALL
  SELECT date, target_currency, 1.0 / exchange_rate, 1, quote_id FROM daily_exchange_rates
  WHERE source_currency = 'USD' AND target_currency <> 'USD' AND exchange_rate > 0)
SELECT currency, round(usd_rate, 9) AS usd_rate FROM found
QUALIFY row_number() OVER (PARTITION BY currency ORDER BY p, quote_id DESC) = 1 UNION ALL SELECT 'USD', 1.0""")
def usd_rates_from_rows(t: BankTables):
    return rounded(usd_rates_from_quotes(t.exchange_rates, "quote_id"), 9)


@query("add_usd_amounts", """
SELECT customer_id, product_id, income, income_usd, current_balance, current_balance_usd FROM users_usd""",
       rounds=["income_usd", "current_balance_usd"], digits=MONEY)
def add_usd_amounts_query(t: BankTables):
    return rounded(users_usd(t).select("customer_id", "product_id", "income", "income_usd", "current_balance",
                                       "current_balance_usd"), MONEY)


@query("fill_usd_amount", """
SELECT transaction_id, currency, amount, coalesce(amount_usd, CASE WHEN currency = 'USD' THEN amount END) AS amount_usd
FROM transactions""")
def fill_usd_amount_query(t: BankTables):
    return fill_usd_amount(t.transactions).select("transaction_id", "currency", "amount", "amount_usd")


@query("filter_active_customers", "SELECT * EXCLUDE (product_id) FROM active_users")
def filter_active_customers(t: BankTables):
    return active_users(t).drop("product_id")


@query("drop_no_income", """
SELECT count(DISTINCT customer_id) FILTER (WHERE income_usd IS NULL) AS dropped,
       count(DISTINCT customer_id) FILTER (WHERE income_usd IS NOT NULL) AS kept FROM users_usd""")
def drop_no_income(t: BankTables):
    rows = users_usd(t)
    dropped = X.customers_without_income(rows).select(F.col("customers").alias("dropped"))
    kept = X.with_known_income(rows).agg(F.countDistinct("customer_id")).scalar()
    return dropped.withColumn("kept", kept)


@query("unknown_products", """
SELECT DISTINCT product_type FROM users_usd WHERE current_balance_usd IS NOT NULL AND product_type NOT IN ('Cuenta Ahorro',
 'Cuenta Corriente', 'Inversión', 'Préstamo Hipotecario', 'Préstamo Personal', 'Seguro', 'Tarjeta Crédito', 'Tarjeta Débito')""")
def unknown_products(t: BankTables):
    return X.unknown_products(users_usd(t))


@query("pivot_balances", "SELECT * FROM balances", rounds=list(C.PRODUCT_TYPES), digits=MONEY)
def pivot_balances(t: BankTables):
    return rounded(X.pivot_balances(X.with_known_income(users_usd(t))), MONEY)


@query("age_at", f"SELECT customer_id, date_of_birth, {AGE} AS age FROM customers_newest")
def age_at_query(t: BankTables):
    people = customers_latest(t.customers)
    return people.select("customer_id", "date_of_birth", age_at(F.col("date_of_birth"), AS_OF).alias("age"))


@query("features_derived", """
SELECT customer_id, num_products, "Deuda_usd", "Activos_financieros_usd" FROM derived_features""",
       rounds=["Deuda_usd", "Activos_financieros_usd"], digits=MONEY)
def features_derived(t: BankTables):
    balances = X.pivot_balances(X.with_known_income(users_usd(t)))
    return rounded(X.derive_features(balances).select("customer_id", "num_products", "Deuda_usd", "Activos_financieros_usd"), MONEY)


@query("build_customer_features", "SELECT * FROM customer_features", rounds=FEATURE_DOUBLES, digits=MONEY)
def build_customer_features_query(t: BankTables):
    return rounded(feature_rows(t), MONEY)


# The same features of all customers, whether eligible or not, so that the rules have something to find.
view("open_features", f"""
SELECT i.*, d.* EXCLUDE (customer_id), {AGE} AS "Edad"
FROM (SELECT c.customer_id, c.country, c.education_level, c.credit_score, c.date_of_birth,
             c.income * r.usd_rate AS income_usd
      FROM customers_newest c LEFT JOIN country_currencies cc ON cc.country_key = {normalized('c.country')}
      LEFT JOIN usd_rates r ON r.currency = cc.income_currency) i
LEFT JOIN derived_features d USING (customer_id)""")


@query("contract_customer_features", _counts("open_features", [
    *required("customer_id", "country"),
    ("country: valor no permitido", f"{normalized('country')} NOT IN ('colombia', 'mexico', 'argentina')"),
    *required("credit_score"), infinite("credit_score"), below("credit_score", 300), above("credit_score", 850),
    *required("income_usd"), infinite("income_usd"), below("income_usd", 0), *required("Edad"), infinite("Edad"),
    below("Edad", 0), above("Edad", 120), *[r for p in C.PRODUCT_TYPES for r in (*required(p), infinite(p))],
    *required("num_products"), infinite("num_products"), below("num_products", 1), above("num_products", 8),
    *required("Deuda_usd"), infinite("Deuda_usd"), *required("Activos_financieros_usd"), infinite("Activos_financieros_usd"),
]) + " UNION ALL SELECT 'duplicado en [''customer_id'']', 0")
def contract_customer_features(t: BankTables):
    countries, rates = currency_frames(t.spark)
    people = customers_latest(t.customers).withColumns({"currency": F.lit("USD"), "current_balance": F.lit(0.0)})
    money = add_usd_amounts(people, countries, rates).drop("current_balance", "current_balance_usd", "currency")
    derived = X.derive_features(X.pivot_balances(X.with_known_income(users_usd(t))))
    rows = money.join(derived, "customer_id", "left").withColumn("Edad", age_at(F.col("date_of_birth"), AS_OF))
    return C.rule_counts(rows, C.CUSTOMER_FEATURES)
