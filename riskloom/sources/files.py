"""Readers of the small input files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.text import normalize_key
from riskloom.session import small_table

# Currency of each country's incomes and USD per unit of each currency.
COUNTRY_CURRENCY = {"Colombia": "COP", "United States": "USD", "United Kingdom": "GBP", "Germany": "EUR",
                    "Argentina": "ARS", "México": "MXN"}
CURRENCY_TO_USD = {"COP": 0.000297, "USD": 1.0, "GBP": 1.27, "EUR": 1.08, "ARS": 0.0053, "MXN": 0.055}

CLEAN_CUSTOMERS_SCHEMA = (
    "customer_id string, date_of_birth string, country string, segment string, credit_score double, "
    "income_usd double, occupation string, education_level string, customer_status string, "
    "`Cuenta Ahorro` double, `Cuenta Corriente` double, `Inversión` double, `Préstamo Hipotecario` double, "
    "`Préstamo Personal` double, `Seguro` double, `Tarjeta Crédito` double, `Tarjeta Débito` double, "
    "num_products int, Deuda_usd double, Activos_financieros_usd double, Edad int")


def _blank_to_null(name: str):
    return F.nullif(F.trim(F.col(name)), F.lit(""))


def _trimmed_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def read_customer_list(spark: SparkSession, path: str) -> DataFrame:
    """(customer_id, anomaly_score) from a CSV with a header, or from a plain list of ids.

    The header is recognised, whatever its case, by the first line; scores are optional.
    """
    first = spark.read.text(path).filter(F.trim("value") != "").limit(1).first()
    if first is None:
        return spark.createDataFrame([], "customer_id string, anomaly_score double")
    if "customer_id" in first["value"].lower():
        rows = _trimmed_headers(spark.read.csv(path, header=True))
        score = F.col("anomaly_score").try_cast("double") if "anomaly_score" in rows.columns else F.lit(None)
        rows = rows.select(F.trim("customer_id").alias("customer_id"), score.cast("double").alias("anomaly_score"))
    else:
        rows = spark.read.text(path).select(F.trim(F.substring_index("value", ",", 1)).alias("customer_id"),
                                            F.lit(None).cast("double").alias("anomaly_score"))
    return rows.filter(F.col("customer_id") != "")


def read_contact_map(spark: SparkSession, path: str) -> DataFrame:
    """(customer_id, email, whatsapp) from a CSV; blanks become null, the last row of an id wins."""
    rows = _trimmed_headers(spark.read.csv(path, header=True))
    for name in ("email", "whatsapp"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    rows = rows.select(F.trim("customer_id").alias("customer_id"), _blank_to_null("email").alias("email"),
                       _blank_to_null("whatsapp").alias("whatsapp"), F.monotonically_increasing_id().alias("_line"))
    last = rows.filter(F.col("customer_id") != "").groupBy("customer_id").agg(
        F.max_by(F.struct("email", "whatsapp"), "_line").alias("c"))
    return last.select("customer_id", "c.email", "c.whatsapp")


def currency_frames(spark: SparkSession, country_currency: dict[str, str] | None = None,
                    currency_to_usd: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(country_key, income_currency) and (currency, usd_rate); a handful of rows each."""
    countries = small_table(spark, list((country_currency or COUNTRY_CURRENCY).items()), "country string, income_currency string")
    rates = small_table(spark, [(c, float(r)) for c, r in (currency_to_usd or CURRENCY_TO_USD).items()],
                        "currency string, usd_rate double")
    return countries.select(normalize_key(F.col("country")).alias("country_key"), "income_currency"), rates


def read_currency_config(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The same two frames from a JSON file with the maps `country_currency` and `currency_to_usd`."""
    config = spark.read.schema("country_currency map<string,string>, currency_to_usd map<string,double>").json(
        path, multiLine=True)
    countries = config.select(F.explode("country_currency").alias("country", "income_currency"))
    return (countries.select(normalize_key(F.col("country")).alias("country_key"), "income_currency"),
            config.select(F.explode("currency_to_usd").alias("currency", "usd_rate")))


def read_clean_customers(spark: SparkSession, path: str) -> DataFrame:
    """Customer features saved as CSV, with a fixed schema. `path` is a file or a folder of parts."""
    return spark.read.csv(path, header=True, schema=CLEAN_CUSTOMERS_SCHEMA, enforceSchema=False)
