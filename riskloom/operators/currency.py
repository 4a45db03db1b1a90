"""Exchange rates and amounts in USD."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.numbers import as_date
from riskloom.functions.text import normalize_key
from riskloom.operators.scaling import top_rows


class RateError(ValueError):
    """The exchange rates cannot be used."""


def usd_rates_from_quotes(quotes: DataFrame, sequence: str) -> DataFrame:
    """(currency, usd_rate) from quotes "1 source = rate target".

    A quote to USD is used as it is, a quote from USD is inverted; the direct one wins, and among
    several the one with the highest `sequence`. USD itself is 1.
    """
    usable = quotes.filter(F.col("exchange_rate") > 0)
    direct = usable.filter((F.col("target_currency") == "USD") & (F.col("source_currency") != "USD")).select(
        F.col("source_currency").alias("currency"), F.col("exchange_rate").alias("usd_rate"),
        F.lit(0).alias("_priority"), F.col(sequence).alias("_sequence"))
    inverted = usable.filter((F.col("source_currency") == "USD") & (F.col("target_currency") != "USD")).select(
        F.col("target_currency").alias("currency"), (1.0 / F.col("exchange_rate")).alias("usd_rate"),
        F.lit(1).alias("_priority"), F.col(sequence).alias("_sequence"))
    chosen = top_rows(direct.unionByName(inverted), ["currency"], [F.col("_priority"), F.col("_sequence").desc()])
    usd = quotes.sparkSession.createDataFrame([("USD", 1.0)], "currency string, usd_rate double")
    return chosen.select("currency", "usd_rate").unionByName(usd)


def quotes_as_of(rates: DataFrame, as_of: dt.date | str) -> DataFrame:
    """USD quotes of the last day with rates on or before `as_of`."""
    day = F.lit(as_date(as_of))
    last_day = rates.filter(F.col("date") <= day).agg(F.max("date")).scalar()
    return rates.filter((F.col("date") == last_day)
                        & ((F.col("source_currency") == "USD") | (F.col("target_currency") == "USD")))


def usd_rates_as_of(rates: DataFrame, as_of: dt.date | str, sequence: str) -> DataFrame:
    return usd_rates_from_quotes(quotes_as_of(rates, as_of), sequence)


def invalid_rates(rates: DataFrame) -> DataFrame:
    """Rates that are missing, infinite, not positive, or a USD rate other than 1."""
    rate = F.col("usd_rate")
    usable = (rate > 0) & (rate < F.lit(math.inf)) & ~F.isnan(rate)
    wrong_usd = (F.col("currency") == "USD") & (rate != 1.0)
    return rates.filter(~F.coalesce(usable, F.lit(False)) | F.coalesce(wrong_usd, F.lit(False)))


def require_usd_rates(rates: DataFrame, as_of: dt.date | str | None = None) -> None:
    """Raise unless every rate is usable and USD is present (one row per currency: a small frame)."""
    found = rates.agg(F.count(F.lit(1)).alias("n"),
                      F.count_if(F.col("currency") == "USD").alias("usd")).first()
    if as_of is not None and found["n"] <= 1:
        raise LookupError(f"no exchange rates on or before {as_of}")
    bad = invalid_rates(rates).limit(20).collect()
    if bad:
        raise RateError(f"invalid rates: {[(r['currency'], r['usd_rate']) for r in bad]}")
    if found["usd"] == 0:
        raise RateError("the USD rate must be 1.0")


def add_usd_amounts(users: DataFrame, countries: DataFrame, rates: DataFrame) -> DataFrame:
    """Income in USD by the currency of the country, balance in USD by the currency of the product.

    `countries` and `rates` have one row per country and per currency; Spark broadcasts them where it knows that they
    are small.
    """
    rates = rates.select("currency", "usd_rate")
    income_rates = countries.join(rates.withColumnRenamed("currency", "income_currency"), "income_currency").select(
        "country_key", F.col("usd_rate").alias("_income_rate"))
    return (users.withColumn("country_key", normalize_key(F.col("country")))
                 .join(income_rates, "country_key", "left")
                 .join(rates.withColumnRenamed("usd_rate", "_balance_rate"), "currency", "left")
                 .withColumn("income_usd", F.col("income") * F.col("_income_rate"))
                 .withColumn("current_balance_usd", F.col("current_balance") * F.col("_balance_rate"))
                 .drop("country_key", "_income_rate", "_balance_rate"))


def fill_usd_amount(transactions: DataFrame) -> DataFrame:
    """A missing USD amount is the amount itself when the currency is USD."""
    known = F.col("amount_usd") if "amount_usd" in transactions.columns else F.lit(None).cast("double")
    return transactions.withColumn("amount_usd", F.coalesce(known, F.when(F.col("currency") == "USD", F.col("amount"))))
