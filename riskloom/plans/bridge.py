"""Bank tables derived from the benchmark tables.

Each view is one SQL text that Spark and DuckDB both accept and evaluate alike (integer arithmetic,
CASE, concat). It brings what the operators must cope with: versions of a record, exact copies,
nulls, invalid values and mixed spelling. `@TS` stands for the zone-less timestamp type name.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

CUSTOMER_ID = "concat('C', lpad(cast({key} as string), 8, '0'))"

TRANSACTIONS = f"""
SELECT concat('T', lpad(cast(event_id as string), 12, '0')) AS transaction_id,
       ts AS transaction_date,
       cast(ts as date) AS process_date,
       concat('P', lpad(cast(user_id * 7 + event_id % 3 as string), 12, '0')) AS product_id,
       {CUSTOMER_ID.format(key='user_id')} AS customer_id,
       CASE WHEN event_id % 53 = 0 THEN NULL ELSE event_type END AS transaction_type,
       CASE WHEN event_id % 2 = 0 THEN 'Debit' ELSE 'Credit' END AS transaction_category,
       amount,
       CASE event_id % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'COP' WHEN 2 THEN 'MXN' ELSE 'ARS' END AS currency,
       CASE WHEN event_id % 20 IN (3, 8) THEN NULL ELSE amount END AS amount_usd,
       CASE event_id % 5 WHEN 0 THEN 'ATM' WHEN 1 THEN 'Branch' WHEN 2 THEN ' POS ' WHEN 3 THEN 'Web'
            ELSE 'App' END AS channel,
       concat('B', cast(event_id % 40 as string)) AS branch_id,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE concat('Comercio ', cast((event_id * 3) % 57 as string)) END
            AS merchant_name,
       CASE WHEN event_id % 59 = 0 THEN '' ELSE concat('Rubro ', cast((event_id * 7) % 23 as string)) END
            AS merchant_category,
       CASE WHEN event_id % 97 = 0 THEN 'Brasil' WHEN user_id % 3 = 0 THEN 'Colombia'
            WHEN user_id % 3 = 1 THEN 'México' ELSE 'Argentina' END AS transaction_country,
       concat('Ciudad ', cast((user_id + CASE WHEN event_id % 41 = 0 THEN 1 ELSE 0 END) % 12 as string))
            AS transaction_city,
       CASE WHEN event_type = 'error' THEN 'Declined' WHEN event_id % 251 = 0 THEN 'Desconocido'
            WHEN event_id % 37 = 0 THEN 'Pending' WHEN event_id % 43 = 0 THEN 'Reversed'
            ELSE 'Approved' END AS transaction_status,
       CASE WHEN event_type = 'error' THEN '51' ELSE '00' END AS response_code,
       event_id % 211 = 0 AS is_fraud,
       CASE WHEN event_id % 61 = 0 THEN NULL ELSE cast((event_id * 37) % 100 as double) END AS fraud_score,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE cast((event_id * 37) % 160 - 80 as double) / 2 END AS latitude,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE cast((event_id * 53) % 360 - 180 as double) / 2 END AS longitude,
       'events.parquet' AS filename,
       cast(day(ts) as bigint) AS day, cast(month(ts) as bigint) AS month, cast(year(ts) as bigint) AS year
FROM (SELECT event_id, ts, user_id, event_type, value AS amount FROM {{events}}
      UNION ALL
      SELECT event_id, CASE WHEN event_id % 50 = 0 THEN ts - INTERVAL 1 HOUR ELSE ts END AS ts, user_id,
             event_type, CASE WHEN event_id % 50 = 0 THEN value + 1.0 ELSE value END AS amount
      FROM {{events}} WHERE event_id % 50 = 0 OR event_id % 75 = 0) e
"""

CUSTOMERS = f"""
SELECT {CUSTOMER_ID.format(key='k')} AS customer_id,
       DATE '1950-01-01' + cast((k * 37) % 18000 as int) AS date_of_birth,
       CASE n_nationkey % 8 WHEN 0 THEN 'Colombia' WHEN 1 THEN 'México' WHEN 2 THEN 'Argentina'
            WHEN 3 THEN ' COLOMBIA ' WHEN 4 THEN 'Mexico' WHEN 5 THEN 'argentina' WHEN 6 THEN 'Colombia'
            ELSE CASE WHEN k % 5 = 0 THEN 'Brasil' ELSE 'MÉXICO' END END AS country,
       c_mktsegment AS segment,
       CASE WHEN k % 23 = 0 THEN NULL WHEN k % 101 = 0 THEN 9999.0
            ELSE cast(300 + (k * 91 + v * 5) % 551 as double) END AS credit_score,
       CASE WHEN k % 29 = 0 THEN NULL ELSE cast((1000 + (k * 131 + v * 50) % 20000) * 100 as double) END
            AS estimated_monthly_income,
       CASE WHEN k % 31 = 0 THEN NULL ELSE concat('Ocupación ', cast(k % 6 as string)) END AS occupation,
       CASE WHEN k % 17 = 0 THEN NULL WHEN k % 4 = 0 THEN 'Primaria' WHEN k % 4 = 1 THEN 'Secundaria'
            WHEN k % 4 = 2 THEN 'Universitaria' ELSE 'Posgrado' END AS education_level,
       CASE k % 10 WHEN 7 THEN 'Inactive' WHEN 8 THEN 'Suspended' WHEN 9 THEN 'Closed' ELSE 'Active' END
            AS customer_status,
       CASE WHEN k % 37 = 0 THEN NULL ELSE concat('Nombre', cast(k % 90 as string)) END AS first_name,
       concat('Apellido', cast(k % 70 as string)) AS last_name,
       CASE WHEN k % 19 = 0 THEN NULL ELSE concat('persona', cast(k as string), '@correo.example') END AS email,
       CASE WHEN k % 3 = 0 THEN concat('+57 300 ', lpad(cast(k as string), 7, '0'))
            ELSE concat('300-', lpad(cast(k as string), 7, '0')) END AS mobile_phone,
       CASE k % 4 WHEN 0 THEN 'neutral' WHEN 1 THEN 'Paisa' WHEN 2 THEN 'Rioplatense' ELSE 'Norteño' END
            AS detected_accent,
       concat('Ciudad ', cast(k % 12 as string)) AS city,
       CASE k % 5 WHEN 0 THEN 'pt' WHEN 1 THEN 'inglés' ELSE 'Español' END AS preferred_language,
       CASE WHEN v = 1 THEN @TS '2023-12-01 00:00:00' ELSE @TS '2023-06-01 00:00:00' END AS last_updated
FROM (SELECT c_custkey AS k, c_nationkey, c_mktsegment, 0 AS v FROM {{customer}}
      UNION ALL
      SELECT c_custkey, c_nationkey, c_mktsegment, CASE WHEN c_custkey % 40 = 0 THEN 1 ELSE 0 END
      FROM {{customer}} WHERE c_custkey % 40 = 0 OR c_custkey % 60 = 0) c
JOIN {{nation}} n ON c.c_nationkey = n.n_nationkey
"""

PRODUCTS = f"""
SELECT concat('P', lpad(cast(o_orderkey as string), 12, '0')) AS product_id,
       {CUSTOMER_ID.format(key='o_custkey')} AS customer_id,
       CASE WHEN o_orderkey % 97 = 0 THEN 'Tarjeta Prepago' WHEN o_orderkey % 89 = 0 THEN NULL
            ELSE CASE o_orderkey % 8 WHEN 0 THEN 'Cuenta Ahorro' WHEN 1 THEN 'Cuenta Corriente'
                 WHEN 2 THEN 'Inversión' WHEN 3 THEN 'Préstamo Hipotecario' WHEN 4 THEN 'Préstamo Personal'
                 WHEN 5 THEN 'Seguro' WHEN 6 THEN 'Tarjeta Crédito' ELSE 'Tarjeta Débito' END END AS product_type,
       lpad(cast(o_orderkey * 7919 as string), 16, '4') AS product_number,
       CASE o_custkey % 5 WHEN 0 THEN 'USD' WHEN 1 THEN 'COP' WHEN 2 THEN 'MXN' WHEN 3 THEN 'ARS' ELSE 'CLP' END
            AS currency,
       CASE WHEN o_orderkey % 71 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 0.0 ELSE balance END AS current_balance,
       balance * 2 AS credit_limit,
       CASE o_orderstatus WHEN 'F' THEN 'Closed' WHEN 'O' THEN 'Active' ELSE 'Blocked' END AS product_status,
       updated AS last_updated
FROM (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice AS balance, o_orderdate AS updated FROM {{orders}}
      UNION ALL
      SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + 100.0, o_orderdate - INTERVAL 30 DAY
      FROM {{orders}} WHERE o_orderkey % 50 = 0) o
"""

EXCHANGE_RATES = """
SELECT cast(o_orderdate as date) AS date,
       CASE o_orderkey % 6 WHEN 0 THEN 'COP' WHEN 1 THEN 'USD' WHEN 2 THEN 'MXN' WHEN 3 THEN 'USD' WHEN 4 THEN 'EUR'
            ELSE 'ARS' END AS source_currency,
       CASE o_orderkey % 6 WHEN 0 THEN 'USD' WHEN 1 THEN 'MXN' WHEN 2 THEN 'USD' WHEN 3 THEN 'CLP' WHEN 4 THEN 'ARS'
            ELSE 'USD' END AS target_currency,
       CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 25 = 0 THEN 0.0 ELSE o_totalprice / 1000.0 END
            AS exchange_rate,
       o_orderkey AS quote_id
FROM {orders}
"""

SERVICE_AGENTS = """
SELECT concat('A', lpad(cast(s_suppkey as string), 6, '0')) AS agent_id,
       concat('Asesor', cast(s_suppkey % 50 as string)) AS first_name,
       concat('Apellido', cast(s_suppkey % 31 as string)) AS last_name,
       concat('asesor', cast(s_suppkey as string), '@banco.example') AS email,
       CASE s_suppkey % 4 WHEN 0 THEN 'Neutral' WHEN 1 THEN 'PAISA' WHEN 2 THEN 'rioplatense' ELSE 'Norteño' END
            AS native_accent,
       CASE s_nationkey % 4 WHEN 0 THEN 'Colombia' WHEN 1 THEN 'México' WHEN 2 THEN 'Argentina' ELSE 'Brasil' END
            AS country_of_origin,
       CASE s_suppkey % 7 WHEN 0 THEN 'In-Person' WHEN 1 THEN 'Hybrid' WHEN 2 THEN 'Phone' ELSE 'Digital' END
            AS agent_type,
       CASE s_suppkey % 4 WHEN 0 THEN 'Specialist' WHEN 1 THEN 'Senior' WHEN 2 THEN 'Mid-Senior' ELSE 'Junior' END
            AS experience_level,
       CASE s_suppkey % 6 WHEN 0 THEN 'Español' WHEN 1 THEN 'Español, Inglés' WHEN 2 THEN 'Portugués'
            WHEN 3 THEN 'Español, Portugués, Inglés' WHEN 4 THEN 'Inglés' ELSE 'español' END AS languages,
       CASE s_suppkey % 5 WHEN 0 THEN 'Fraudes' WHEN 1 THEN 'Prevención de Fraude' WHEN 2 THEN 'Créditos'
            WHEN 3 THEN NULL ELSE 'Seguros' END AS specialty,
       CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE 3.0 + cast(s_suppkey % 20 as double) / 10 END AS avg_csat,
       CASE WHEN s_suppkey % 8 = 0 THEN NULL ELSE floor(abs(s_acctbal) / 40) * 10.0 END AS total_monthly_interactions,
       CASE s_suppkey % 5 WHEN 0 THEN 'Morning' WHEN 1 THEN 'Afternoon' WHEN 2 THEN 'Night' WHEN 3 THEN 'Rotating'
            ELSE NULL END AS work_shift,
       CASE WHEN s_suppkey % 13 = 0 THEN 'Inactive' ELSE 'Active' END AS agent_status
FROM (SELECT s_suppkey, s_nationkey, s_acctbal FROM {supplier}
      UNION ALL SELECT s_suppkey, s_nationkey, s_acctbal FROM {supplier} WHERE s_suppkey % 10 = 0) s
"""

# Stand-in for the fitted clusters in queries that are compared with SQL.
CLUSTERS = f"""
SELECT {CUSTOMER_ID.format(key='c_custkey')} AS customer_id, cast(c_nationkey % 3 as int) AS cluster FROM {{customer}}
"""

BANK_VIEWS = {
    "transactions": TRANSACTIONS,
    "customers": CUSTOMERS,
    "products": PRODUCTS,
    "daily_exchange_rates": EXCHANGE_RATES,
    "service_agents": SERVICE_AGENTS,
    "clusters": CLUSTERS,
}
BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
               "embeddings", "pages", "benchmark", "labels", "conversations")


class BankTables:
    """The derived tables of one data folder as lazy DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        text = BANK_VIEWS[name].replace("@TS", "TIMESTAMP_NTZ")
        used = {t: self.base(t) for t in BASE_TABLES if "{" + t + "}" in text}
        return self.spark.sql(text, **used)

    @cached_property
    def transactions(self) -> DataFrame:
        return self.view("transactions")

    @cached_property
    def customers(self) -> DataFrame:
        return self.view("customers")

    @cached_property
    def products(self) -> DataFrame:
        return self.view("products")

    @cached_property
    def exchange_rates(self) -> DataFrame:
        return self.view("daily_exchange_rates")

    @cached_property
    def agents(self) -> DataFrame:
        return self.view("service_agents")

    @cached_property
    def clusters(self) -> DataFrame:
        return self.view("clusters")
