"""Contract queries: rule by rule counts and the rows that stay."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import contracts as C
from riskloom.operators.behavior import fill_usd_amount
from riskloom.operators.currency import invalid_rates
from riskloom.operators.scaling import union_all
from riskloom.plans.bridge import BankTables
from riskloom.plans.catalog.common import RECENT, inside, normalized
from riskloom.plans.catalog.registry import query, view
from riskloom.functions.text import normalize_key
from riskloom.sources import tables

# An input with every kind of violation: the raw customer records, dates as text.
CHECKED = C.Contract(
    "registro de clientes", C.Expect.text("customer_id").required(), C.Expect.moment("birth").between("1960-01-01", "1995-12-31"),
    C.Expect.number("credit_score").required().between(300, 850),
    C.Expect.number("estimated_monthly_income").required().between(200000, 1900000),
    C.Expect.text("country").required().among(C.COUNTRIES, normalize_key), C.Expect.text("customer_status").among({"Active", "Inactive"}),
    key=["customer_id"],
    never={"score impar": lambda: F.col("credit_score") % 2 == 1,
           "posgrado sin ocupación": lambda: (F.col("education_level") == "Posgrado") & F.col("occupation").isNull()})
ORDER = ["last_updated", "credit_score", "estimated_monthly_income", "first_name"]

view("checked_customers", """
SELECT *, CASE WHEN credit_score = 307 THEN 'sin fecha' ELSE cast(date_of_birth AS VARCHAR) END AS birth,
       CASE WHEN credit_score = 9999 THEN 'inf'::DOUBLE ELSE credit_score END AS score
FROM customers""")
FIELD_RULES = [
    ("customer_id: nulo", "customer_id IS NULL"),
    ("birth: fecha inválida", "birth IS NOT NULL AND try_cast(birth AS TIMESTAMP) IS NULL"),
    ("birth: < 1960-01-01", "try_cast(birth AS TIMESTAMP) < DATE '1960-01-01'"),
    ("birth: > 1995-12-31", "try_cast(birth AS TIMESTAMP) > DATE '1995-12-31'"),
    ("credit_score: nulo", "score IS NULL"),
    ("credit_score: infinito", "abs(score) = 'inf'::DOUBLE"),
    ("credit_score: < 300", "score < 300"), ("credit_score: > 850", "score > 850"),
    ("estimated_monthly_income: nulo", "estimated_monthly_income IS NULL"),
    ("estimated_monthly_income: infinito", "abs(estimated_monthly_income) = 'inf'::DOUBLE"),
    ("estimated_monthly_income: < 200000", "estimated_monthly_income < 200000"),
    ("estimated_monthly_income: > 1900000", "estimated_monthly_income > 1900000"),
    ("country: nulo", "country IS NULL"),
    ("country: valor no permitido", f"{normalized('country')} NOT IN ('colombia', 'mexico', 'argentina')"),
    ("customer_status: valor no permitido", "customer_status NOT IN ('Active', 'Inactive')"),
]
ROW_RULES = [("score impar", "CASE WHEN isinf(score) THEN false ELSE score % 2 = 1 END"),
             ("posgrado sin ocupación", "education_level = 'Posgrado' AND occupation IS NULL")]


def _counts(source: str, rules: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name.replace(chr(39), chr(39) * 2)}' AS rule, count(*) FILTER (WHERE {cond}) AS rows FROM {source}"
        for name, cond in rules)


def _any(rules: list[tuple[str, str]]) -> str:
    return " OR ".join(f"coalesce({cond}, false)" for _, cond in rules)


view("checked_flags", f"""
SELECT *, {_any(FIELD_RULES + ROW_RULES)} AS invalid,
       row_number() OVER (PARTITION BY customer_id ORDER BY last_updated, score, estimated_monthly_income, first_name) AS nth
FROM checked_customers""")


def checked_customers(t: BankTables):
    return t.customers.withColumns({
        "birth": F.when(F.col("credit_score") == 307, "sin fecha").otherwise(F.col("date_of_birth").cast("string")),
        "credit_score": F.when(F.col("credit_score") == 9999, F.lit(float("inf"))).otherwise(F.col("credit_score"))})


@query("contract_schema", """
SELECT 'sin columna' AS variant, 'credit_score' AS "column", 'faltan columnas' AS problem, 0 AS filled
UNION ALL SELECT 'otro tipo', 'credit_score', 'tipos incorrectos', count(credit_score) FROM customers
UNION ALL SELECT 'otro tipo', 'income', 'tipos incorrectos', count(estimated_monthly_income) FROM customers WHERE estimated_monthly_income > 0""")
def contract_schema(t: BankTables):
    """Schema problems of three variants of the customers; the last one's column of nulls has no kind."""
    spec = C.Contract("prueba", C.Expect.text("customer_id"), C.Expect.number("credit_score"), C.Expect.truth("income"))
    income = F.when(F.col("estimated_monthly_income") > 0, F.col("estimated_monthly_income"))
    nothing = F.lit(None).cast("string")
    variants = {"sin columna": t.customers.drop("credit_score").withColumn("income", nothing.cast("double")),
                "otro tipo": t.customers.withColumns({"credit_score": F.col("credit_score").cast("string"), "income": income}),
                "columna vacía": t.customers.withColumns({"credit_score": nothing, "income": nothing.cast("double")})}
    return union_all([C.schema_problems(df, spec).select(F.lit(name).alias("variant"), "column", "problem", "filled") for name, df in variants.items()])


@query("contract_column_rules", _counts("checked_customers", FIELD_RULES))
def contract_column_rules(t: BankTables):
    spec = C.Contract(CHECKED.title, *CHECKED.columns)
    return C.rule_counts(checked_customers(t), spec)


@query("contract_row_checks", _counts("checked_customers", ROW_RULES))
def contract_row_checks(t: BankTables):
    finite = checked_customers(t).withColumn("credit_score", F.when(F.col("credit_score") < 9e9, F.col("credit_score")))
    return C.rule_counts(finite, C.Contract(CHECKED.title, never=CHECKED.never))


@query("contract_unique", """
SELECT customer_id, country, customer_status FROM checked_flags WHERE NOT invalid AND nth = 1""")
def contract_unique(t: BankTables):
    return C.valid_rows(checked_customers(t), CHECKED, ORDER).select("customer_id", "country", "customer_status")


@query("contract_validate", f"""
SELECT * FROM products WHERE current_balance IS NULL OR (current_balance >= 0 AND current_balance <= 480000)""")
def contract_validate(t: BankTables):
    spec = C.Contract("productos", C.Expect.text("product_id").required(), C.Expect.number("current_balance").between(0, 480000), tolerance=0.5)
    return C.validate(t.products, spec, mode="drop")[0]


@query("contract_report", _counts("checked_customers", FIELD_RULES + ROW_RULES) + """
UNION ALL SELECT 'duplicado en [''customer_id'']', count(*) FILTER (WHERE NOT invalid AND nth > 1) FROM checked_flags""")
def contract_report(t: BankTables):
    return C.rule_counts(checked_customers(t), CHECKED, ORDER)


@query("contract_usd_rates", """
SELECT source_currency AS currency, exchange_rate AS usd_rate FROM daily_exchange_rates
WHERE exchange_rate IS NULL OR exchange_rate <= 0 OR (source_currency = 'USD' AND exchange_rate <> 1.0)""")
def contract_usd_rates(t: BankTables):
    return invalid_rates(t.exchange_rates.select(F.col("source_currency").alias("currency"),
                                                 F.col("exchange_rate").alias("usd_rate")))


def required(*names: str) -> list[tuple[str, str]]:
    return [(f"{n}: nulo", f'"{n}" IS NULL') for n in names]


def infinite(name: str) -> tuple[str, str]:
    return f"{name}: infinito", f"abs(\"{name}\") = 'inf'::DOUBLE"


def below(name: str, bound) -> tuple[str, str]:
    return f"{name}: < {bound}", f'"{name}" < {bound}'


def above(name: str, bound) -> tuple[str, str]:
    return f"{name}: > {bound}", f'"{name}" > {bound}'


@query("contract_raw_customer_products", _counts("customer_products", [
    *required("customer_id", "date_of_birth"), ("date_of_birth: fecha inválida", "false"),
    ("date_of_birth: < 1900-01-01", "date_of_birth < DATE '1900-01-01'"), *required("country"),
    infinite("credit_score"), below("credit_score", 300), above("credit_score", 850), infinite("income"), below("income", 0),
    *required("customer_status"),
    ("customer_status: valor no permitido", "customer_status NOT IN ('Active', 'Inactive', 'Suspended', 'Closed')"),
    infinite("current_balance")]))
def contract_raw_customer_products(t: BankTables):
    return C.rule_counts(tables.customers_with_products(t.customers, t.products), C.RAW_CUSTOMER_PRODUCTS)


view("recent_filled", f"""
SELECT * REPLACE (coalesce(amount_usd, CASE WHEN currency = 'USD' THEN amount END) AS amount_usd)
FROM (SELECT * FROM transactions WHERE {inside(RECENT)})""")


@query("contract_raw_transactions", _counts("recent_filled", [
    *required("transaction_id", "transaction_date"), ("transaction_date: fecha inválida", "false"),
    *required("customer_id", "amount"), infinite("amount"), *required("currency"), infinite("amount_usd"),
    *required("transaction_status"),
    ("transaction_status: valor no permitido", "transaction_status NOT IN ('Approved', 'Declined', 'Pending', 'Reversed')"),
]) + """
UNION ALL SELECT 'duplicado en [''transaction_id'']', count(*) FILTER (WHERE transaction_status <> 'Desconocido' AND nth > 1)
FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY transaction_date, amount) AS nth FROM recent_filled)""")
def contract_raw_transactions(t: BankTables):
    rows = fill_usd_amount(t.transactions.filter(RECENT.contains(F.col("transaction_date"))))
    return C.rule_counts(rows, C.RAW_TRANSACTIONS, [F.col("transaction_date"), F.col("amount")])
