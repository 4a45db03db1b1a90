"""Parameters shared by the queries, and the SQL views their twins are built from."""

from __future__ import annotations

from riskloom.functions.numbers import DayWindow, history_window, recent_and_baseline
from riskloom.operators.contracts import PRODUCT_TYPES
from riskloom.plans.catalog.registry import view
from riskloom.sources.tables import CUSTOMER_COLUMNS, PRODUCT_COLUMNS, TRANSACTION_COLUMNS

# The events cover January 2024.
AS_OF = "2024-01-30"
BASELINE, RECENT = recent_and_baseline(AS_OF, recent_days=7)
HISTORY = history_window(AS_OF)
# Two held-out windows of ten days for the evaluation.
HELD_OUT_DAYS = 10
EARLIER, LATER = (recent_and_baseline(day, recent_days=HELD_OUT_DAYS)[1] for day in ("2024-01-20", "2024-01-30"))
RATES_AS_OF = "2000-06-15"
ANALYSIS_DAYS = 10
BURST_MINUTES = 180
VERSION = "clusters_20240130"

CUSTOMER_FIELDS = ", ".join("estimated_monthly_income AS income" if c == "income" else c for c in CUSTOMER_COLUMNS)
PRODUCT_FIELDS = ", ".join(PRODUCT_COLUMNS)
TRANSACTION_FIELDS = ", ".join(TRANSACTION_COLUMNS)
NORMALIZE = "regexp_replace(lower(trim(strip_accents({0}))), '[^\\x00-\\x7F]', '', 'g')"


def normalized(column: str) -> str:
    return NORMALIZE.format(column)


def inside(window: DayWindow, column: str = "transaction_date") -> str:
    return f"{column} >= DATE '{window.start}' AND {column} < DATE '{window.end}'"


view("customers_newest", f"""
SELECT {CUSTOMER_FIELDS} FROM customers
QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY last_updated DESC) = 1""")
view("products_newest", f"""
SELECT {PRODUCT_FIELDS} FROM products
QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY last_updated DESC) = 1""")
view("customer_products", """
SELECT c.*, p.product_id, p.product_type, p.currency, p.current_balance
FROM customers_newest c LEFT JOIN products_newest p USING (customer_id)""")
view("usd_rates", """
SELECT * FROM (VALUES ('COP', 0.000297::DOUBLE), ('USD', 1.0), ('GBP', 1.27), ('EUR', 1.08), ('ARS', 0.0053),
                      ('MXN', 0.055)) r(currency, usd_rate)""")
view("country_currencies", """
SELECT * FROM (VALUES ('colombia', 'COP'), ('united states', 'USD'), ('united kingdom', 'GBP'), ('germany', 'EUR'),
                      ('argentina', 'ARS'), ('mexico', 'MXN')) r(country_key, income_currency)""")

# --- customer features -------------------------------------------------------------------------
view("valid_users", """
SELECT * FROM customer_products
WHERE customer_id IS NOT NULL AND date_of_birth IS NOT NULL AND date_of_birth >= DATE '1900-01-01'
  AND country IS NOT NULL AND coalesce(credit_score BETWEEN 300 AND 850, true) AND coalesce(income >= 0, true)
  AND customer_status IN ('Active', 'Inactive', 'Suspended', 'Closed')""")
view("active_users", """
SELECT * FROM valid_users
WHERE credit_score IS NOT NULL AND income IS NOT NULL AND occupation IS NOT NULL AND customer_status = 'Active'""")
view("users_usd", f"""
SELECT u.*, u.income * ri.usd_rate AS income_usd, u.current_balance * rb.usd_rate AS current_balance_usd
FROM active_users u
LEFT JOIN country_currencies cc ON cc.country_key = {normalized('u.country')}
LEFT JOIN usd_rates ri ON ri.currency = cc.income_currency
LEFT JOIN usd_rates rb ON rb.currency = u.currency""")
_SUMS = ", ".join(f"coalesce(sum(current_balance_usd) FILTER (WHERE product_type = '{t}'), 0.0) AS \"{t}\""
                  for t in PRODUCT_TYPES)
view("balances", f"""
SELECT customer_id, {_SUMS} FROM users_usd
WHERE income_usd IS NOT NULL AND product_type IS NOT NULL AND current_balance_usd IS NOT NULL GROUP BY customer_id""")
view("derived_features", f"""
SELECT *, cast({' + '.join(f'("{t}" > 0)::INT' for t in PRODUCT_TYPES)} AS INT) AS num_products,
       "Préstamo Hipotecario" + "Préstamo Personal" + "Tarjeta Crédito" AS "Deuda_usd",
       "Cuenta Ahorro" + "Cuenta Corriente" + "Seguro" + "Inversión" + "Tarjeta Débito" AS "Activos_financieros_usd"
FROM balances WHERE {' OR '.join(f'"{t}" > 0' for t in PRODUCT_TYPES)}""")
AGE = (f"cast(year(DATE '{AS_OF}') - year(date_of_birth) - CASE WHEN (month(date_of_birth), day(date_of_birth)) > "
       f"(month(DATE '{AS_OF}'), day(DATE '{AS_OF}')) THEN 1 ELSE 0 END AS INT)")
view("customer_features", f"""
SELECT i.customer_id, i.date_of_birth, i.country, i.segment, i.credit_score, i.income_usd, i.occupation,
       i.education_level, i.customer_status, d.* EXCLUDE (customer_id), {AGE} AS "Edad"
FROM (SELECT DISTINCT customer_id, date_of_birth, country, segment, credit_score, income_usd, occupation,
             education_level, customer_status FROM users_usd WHERE income_usd IS NOT NULL) i
JOIN derived_features d USING (customer_id)""")

# --- transactions and behaviour ----------------------------------------------------------------
for _name, _window in (("recent", RECENT), ("baseline", BASELINE), ("history", HISTORY), ("earlier", EARLIER), ("later", LATER)):
    view(f"{_name}_transactions", f"""
SELECT {TRANSACTION_FIELDS} FROM transactions WHERE {inside(_window)}
QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY transaction_date DESC) = 1""")
    view(f"{_name}_clean", f"""
SELECT * REPLACE (coalesce(amount_usd, CASE WHEN currency = 'USD' THEN amount END) AS amount_usd)
FROM {_name}_transactions
WHERE customer_id IS NOT NULL AND amount IS NOT NULL AND currency IS NOT NULL
  AND transaction_status IN ('Approved', 'Declined', 'Pending', 'Reversed')""")
    view(f"{_name}_dominant", f"""
SELECT customer_id, transaction_type AS tipo_transaccion_dominante, count(*) AS count_dominante
FROM {_name}_clean WHERE transaction_type IS NOT NULL GROUP BY customer_id, transaction_type
QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, transaction_type) = 1""")
    view(f"{_name}_totals", f"""
SELECT customer_id, count(DISTINCT transaction_id) AS num_transacciones,
       count(DISTINCT cast(transaction_date AS DATE)) AS num_dias_activos,
       count(DISTINCT date_trunc('month', transaction_date)) AS num_meses_activos,
       coalesce(sum(amount_usd), 0.0) AS monto_total_usd, avg(amount_usd) AS monto_promedio_usd,
       quantile_cont(amount_usd, 0.5) AS monto_mediano_usd, max(amount_usd) AS monto_maximo_usd,
       quantile_cont(amount_usd, 0.95) AS monto_p95_usd, stddev_samp(amount_usd) AS monto_std_usd,
       count(DISTINCT product_id) AS num_productos, count(DISTINCT transaction_type) AS num_tipos_transaccion,
       count(DISTINCT currency) AS num_monedas, count(DISTINCT transaction_country) AS num_paises_transaccion,
       count(DISTINCT transaction_city) AS num_ciudades_transaccion,
       avg(CASE WHEN isodow(transaction_date) >= 6 THEN 1.0 ELSE 0.0 END) AS porcentaje_fin_semana,
       avg(CASE WHEN hour(transaction_date) < 6 OR hour(transaction_date) >= 22 THEN 1.0 ELSE 0.0 END)
           AS porcentaje_nocturnas,
       avg(CASE WHEN transaction_status = 'Approved' THEN 1.0 ELSE 0.0 END) AS tasa_aprobacion,
       avg(CASE WHEN amount_usd IS NULL THEN 1.0 ELSE 0.0 END) AS porcentaje_amount_usd_faltante
FROM {_name}_clean GROUP BY customer_id""")
    view(f"{_name}_behavior", f"""
SELECT t.*, t.num_transacciones / {_window.months_touched}.0 AS transacciones_promedio_mes,
       t.num_transacciones / t.num_meses_activos AS transacciones_promedio_mes_activo,
       t.num_transacciones / t.num_dias_activos AS transacciones_por_dia_activo,
       d.tipo_transaccion_dominante, d.count_dominante / t.num_transacciones AS participacion_tipo_dominante,
       {', '.join(f"t.{m} * (30.0 / {_window.days}) AS {m}_monthly" for m in (
           'num_transacciones', 'monto_total_usd', 'num_dias_activos', 'num_productos', 'num_tipos_transaccion',
           'num_monedas', 'num_paises_transaccion', 'num_ciudades_transaccion'))}
FROM {_name}_totals t LEFT JOIN {_name}_dominant d USING (customer_id)""")

BEHAVIOR_DOUBLES = ("monto_total_usd monto_promedio_usd monto_mediano_usd monto_maximo_usd monto_p95_usd monto_std_usd "
                    "porcentaje_fin_semana porcentaje_nocturnas tasa_aprobacion porcentaje_amount_usd_faltante "
                    "transacciones_promedio_mes transacciones_promedio_mes_activo transacciones_por_dia_activo "
                    "participacion_tipo_dominante").split()
FEATURE_DOUBLES = ["income_usd", *PRODUCT_TYPES, "Deuda_usd", "Activos_financieros_usd"]
MONTHLY_DOUBLES = [f"{m}_monthly" for m in (
    "num_transacciones", "monto_total_usd", "num_dias_activos", "num_productos", "num_tipos_transaccion", "num_monedas",
    "num_paises_transaccion", "num_ciudades_transaccion")]

# --- profiles and scores -----------------------------------------------------------------------
ALL_METRICS = MONTHLY_DOUBLES + [
    "monto_promedio_usd", "monto_mediano_usd", "monto_maximo_usd", "monto_p95_usd", "monto_std_usd",
    "transacciones_por_dia_activo", "porcentaje_fin_semana", "porcentaje_nocturnas", "tasa_aprobacion",
    "participacion_tipo_dominante"]


def long_values(behavior: str, metrics: list[str]) -> str:
    parts = [f"SELECT c.customer_id, c.cluster, '{m}' AS feature, {i} AS place, cast(b.{m} AS DOUBLE) AS value "
             f"FROM clusters c JOIN {behavior} b USING (customer_id)" for i, m in enumerate(metrics)]
    return " UNION ALL ".join(parts)


view("profile_values", long_values("baseline_behavior", ALL_METRICS))
view("profile_centers", """
SELECT cluster, feature, count(*) AS count, avg(value) AS mean, quantile_cont(value, 0.5) AS median,
       quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.95) AS p95
FROM profile_values WHERE value IS NOT NULL GROUP BY cluster, feature""")
view("profiles", """
SELECT c.*, m.mad FROM profile_centers c JOIN (
  SELECT v.cluster, v.feature, quantile_cont(abs(v.value - c.median), 0.5) AS mad
  FROM profile_values v JOIN profile_centers c USING (cluster, feature) WHERE v.value IS NOT NULL GROUP BY ALL) m
USING (cluster, feature)""")

DEVIATION = ("CASE WHEN value IS NULL THEN NULL WHEN mad > 0 THEN abs(value - median) / (mad * 1.4826) "
             "WHEN p75 - p25 > 0 THEN abs(value - median) / ((p75 - p25) / 1.349) "
             "WHEN value = median THEN 0.0 ELSE 'inf'::DOUBLE END")


def detail_sql(metrics: list[str], behavior: str = "recent_behavior") -> str:
    return f"""
SELECT customer_id, cluster, feature, value, median AS cluster_median, p25 AS cluster_p25, p75 AS cluster_p75,
       deviation_score, coalesce(deviation_score >= 3, false) AS is_suspicious, place
FROM (SELECT v.*, p.median, p.p25, p.p75, {DEVIATION} AS deviation_score
      FROM ({long_values(behavior, metrics)}) v JOIN profiles p USING (cluster, feature)) d"""


SCORED = ["num_transacciones_monthly", "monto_total_usd_monthly", "monto_promedio_usd", "monto_mediano_usd",
          "monto_maximo_usd"]
view("score_detail", detail_sql(SCORED))
view("score_detail_all", detail_sql(ALL_METRICS))
for _name, _detail in (("score_summary", "score_detail"), ("earlier_summary", "earlier_detail"), ("later_summary", "later_detail")):
    if _name != "score_summary":
        view(_detail, detail_sql(SCORED, _detail.replace("detail", "behavior")))
    view(_name, f"""
SELECT customer_id, cluster, avg(deviation_score) FILTER (WHERE deviation_score < 'inf'::DOUBLE) AS anomaly_score,
       cast(count(*) AS INT) AS n_features, cast(count(*) FILTER (WHERE is_suspicious) AS INT) AS n_suspicious,
       coalesce(string_agg(feature, ',' ORDER BY place) FILTER (WHERE is_suspicious), '') AS suspicious_features
FROM {_detail} GROUP BY customer_id, cluster""")

# --- rules -------------------------------------------------------------------------------------
view("logical_tx", """
SELECT transaction_id AS id, customer_id AS customer, transaction_date AS timestamp, amount, amount_usd, currency,
       product_id AS product, merchant_name AS merchant, merchant_category AS category, transaction_city AS city,
       transaction_country AS country, channel, transaction_type AS type, transaction_status AS status, response_code,
       fraud_score AS model_score, cast(is_fraud AS VARCHAR) AS fraud_label, latitude AS lat, longitude AS lon
FROM transactions""")
view("tx_history_rows", """
SELECT * FROM logical_tx QUALIFY row_number() OVER (PARTITION BY id ORDER BY timestamp DESC) = 1""")
view("rule_inputs", """
SELECT *, (hour(timestamp) < 5)::INT AS night, (hour(timestamp) > 0 OR minute(timestamp) > 0) AS timed,
       (lower(trim(status)) IN ('declined', 'rejected', 'denied', 'failed', 'rechazada', 'rechazado'))::INT AS declined,
       (lat IS NOT NULL AND lon IS NOT NULL AND (coalesce(channel, '') = '' OR lower(trim(channel)) IN
        ('atm', 'branch', 'pos'))) AS located
FROM tx_history_rows""")
view("rule_facts", f"""
SELECT *, count(*) OVER w AS prior_n, count(amount_usd) OVER w AS amt_n, avg(amount_usd) OVER w AS amt_mean,
       stddev_pop(amount_usd) OVER w AS amt_std, quantile_cont(amount_usd, 0.5) OVER w AS prior_median,
       coalesce(country <> '' AND row_number() OVER (PARTITION BY customer, country ORDER BY timestamp, id) = 1, false)
           AS new_country,
       coalesce(city <> '' AND row_number() OVER (PARTITION BY customer, city ORDER BY timestamp, id) = 1, false)
           AS new_city,
       coalesce(category <> '' AND row_number() OVER (PARTITION BY customer, category ORDER BY timestamp, id) = 1, false)
           AS new_category,
       coalesce(sum(night) OVER w, 0) AS night_prior, max(timed) OVER (PARTITION BY customer) AS has_time,
       max(timestamp) OVER (PARTITION BY customer) AS customer_last,
       count(*) OVER r - count(*) OVER s AS recent_n, coalesce(sum(declined) OVER r, 0) - sum(declined) OVER s
           AS recent_declines,
       last_value(CASE WHEN located THEN {{{{'lat': lat, 'lon': lon, 'ts': timestamp}}}} END IGNORE NULLS) OVER w AS last_point
FROM rule_inputs
WINDOW w AS (PARTITION BY customer ORDER BY timestamp, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
       r AS (PARTITION BY customer ORDER BY timestamp RANGE BETWEEN INTERVAL {BURST_MINUTES} MINUTE PRECEDING AND CURRENT ROW),
       s AS (PARTITION BY customer, timestamp ORDER BY id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
""".replace("{{", "{").replace("}}", "}"))
KM = ("CASE WHEN located THEN 6371.0 * 2 * asin(sqrt(pow(sin((radians(lat) - radians(last_point.lat)) / 2), 2) "
      "+ cos(radians(last_point.lat)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(last_point.lon)) / 2), 2))) END")
view("rule_moves", f"""
SELECT *, {KM} AS travel_km, (epoch_us(timestamp) - epoch_us(last_point.ts)) / 3600000000.0 AS travel_hours FROM rule_facts""")
view("rule_hits", """
SELECT *, coalesce(amt_n >= 5 AND amt_std > 0 AND (amount_usd - amt_mean) / amt_std >= 3 AND amount_usd > 2 * amt_mean, false)
           AS hit_amount,
       prior_n >= 5 AND new_country AS hit_country, prior_n >= 5 AND new_city AND NOT new_country AS hit_city,
       coalesce(prior_n >= 5 AND new_category AND amount_usd <> 0 AND amount_usd > prior_median, false) AS hit_category,
       coalesce(prior_n >= 5 AND has_time AND night = 1 AND night_prior / prior_n < 0.05, false) AS hit_night,
       has_time AND recent_n >= 2 AS hit_burst, has_time AND recent_declines >= 2 AS hit_declines,
       coalesce(located AND travel_km >= 300 AND (travel_hours <= 0 OR travel_km / travel_hours > 900), false) AS hit_travel
FROM rule_moves""")
view("rule_points", """
SELECT * REPLACE (CASE WHEN model_score IS NOT NULL THEN round_even(least(model_score, 100), 1) END AS model_score), cast(least(100, hit_amount::INT * 40
       + hit_country::INT * 30 + hit_city::INT * 15 + hit_category::INT * 10 + hit_night::INT * 15 + hit_burst::INT * 25
       + hit_declines::INT * 20 + hit_travel::INT * 35) AS INT) AS rule_score FROM rule_hits""")
REASONS = ", ".join([
    "CASE WHEN hit_amount THEN format('Monto {:.1f} veces mayor a su promedio ({:,.0f} USD)', amount_usd / amt_mean, amt_mean) END",
    "CASE WHEN hit_country THEN 'Primera transacción registrada en ' || country END",
    "CASE WHEN hit_city THEN 'Primera transacción registrada en ' || city END",
    "CASE WHEN hit_category THEN 'Categoría nueva para el cliente: ' || category END",
    "CASE WHEN hit_night THEN 'Hora inusual (' || strftime(timestamp, '%H:%M') || ') para sus hábitos' END",
    f"CASE WHEN hit_burst THEN (recent_n + 1)::BIGINT || ' transacciones en {BURST_MINUTES} minutos' END",
    "CASE WHEN hit_declines THEN recent_declines::BIGINT || ' intentos rechazados justo antes' END",
    "CASE WHEN hit_travel THEN format('Viaje imposible: {:,.0f} km desde la compra presencial anterior en {:.0f} minutos', "
    "travel_km, greatest(travel_hours, 0) * 60) END",
    "CASE WHEN model_score >= 30 THEN format('El modelo antifraude del banco le asignó {:.0f}/100', model_score) END"])
view("scored_tx", f"""
SELECT *, CASE WHEN score >= 60 THEN 'high' WHEN score >= 30 THEN 'medium' ELSE 'low' END AS level,
       list_filter([{REASONS}], lambda x: x IS NOT NULL) AS reasons
FROM (SELECT *, greatest(rule_score::DOUBLE, coalesce(model_score, 0)) AS score FROM rule_points) p""")
view("analysis_tx", f"""
SELECT * FROM scored_tx WHERE timestamp >= customer_last - INTERVAL {ANALYSIS_DAYS} DAY""")
view("labels_of_products", """
SELECT product_id, product_type, right(product_number, 4) AS last4, product_status,
       nullif(concat_ws(' ', nullif(product_type, ''), '****' || right(product_number, 4)), '') AS card
FROM products QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY last_updated DESC) = 1""")
