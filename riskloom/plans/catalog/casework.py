"""Cases from the queue, their details and state, and the routing to agents."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import functions as F

from riskloom.operators import analysis as A
from riskloom.operators import cases as K
from riskloom.operators import routing as G
from riskloom.operators import rules as R
from riskloom.operators.scaling import top_rows
from riskloom.plans import lifecycle
from riskloom.plans.bridge import BankTables
from riskloom.plans.catalog.common import ANALYSIS_DAYS, normalized
from riskloom.plans.catalog.registry import query, rounded, view
from riskloom.plans.catalog.rules import SETTINGS
from riskloom.plans.catalog.sources import scratch
from riskloom.sinks import Operations
from riskloom.sources.logical import latest_profiles, product_labels
from riskloom.sources.tables import active_agents
from riskloom.session import materialize

OPENED = "2024-02-01"

# Queue rows of the customers with events, some of them queued twice, some processed, some unknown.
view("case_queue", """
SELECT CASE WHEN k % 29 = 0 THEN 'X' || customer_id ELSE customer_id END AS customer_id, TIMESTAMP '2024-01-30' AS detected_at,
       'modelo' || v AS model_name, (k % 50 + v) / 100.0::DOUBLE AS anomaly_score,
       CASE WHEN k % 11 = 0 THEN TIMESTAMP '2024-01-31' END AS processed_at
FROM (SELECT DISTINCT customer_id, user_id AS k, v FROM (
        SELECT concat('C', lpad(cast(user_id AS VARCHAR), 8, '0')) AS customer_id, user_id, 0 AS v FROM events
        UNION ALL SELECT concat('C', lpad(cast(user_id AS VARCHAR), 8, '0')), user_id, 1 FROM events WHERE user_id % 4 = 0) u) q""")


def case_queue(t: BankTables):
    users = t.base("events").select(F.col("user_id").alias("k")).distinct()
    both = users.withColumn("v", F.explode(F.when(F.col("k") % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    customer = F.concat(F.lit("C"), F.lpad(F.col("k").cast("string"), 8, "0"))
    return both.select(
        F.when(F.col("k") % 29 == 0, F.concat(F.lit("X"), customer)).otherwise(customer).alias("customer_id"),
        F.lit("2024-01-30").cast("timestamp_ntz").alias("detected_at"),
        F.concat(F.lit("modelo"), F.col("v").cast("string")).alias("model_name"),
        ((F.col("k") % 50 + F.col("v")) / 100.0).alias("anomaly_score"),
        F.when(F.col("k") % 11 == 0, F.lit("2024-01-31").cast("timestamp_ntz")).alias("processed_at"))


# Cases that exist already: two per customer for some, in various states.
view("existing_cases", """
SELECT 'OLD-' || c_custkey || '-' || v AS case_id, concat('C', lpad(cast(c_custkey AS VARCHAR), 8, '0')) AS customer_id,
       TIMESTAMP '2024-01-01' + to_days(cast((c_custkey + v * 3) % 20 AS INT)) AS created_at,
       CASE WHEN (c_custkey + v) % 9 = 0 THEN 'public_demo' ELSE 'anomaly_model' END AS source,
       CASE (c_custkey + v) % 7 WHEN 0 THEN 'otp_sent' WHEN 1 THEN 'verified' WHEN 2 THEN 'escalated' ELSE 'closed' END AS status,
       '+57300' || (c_custkey % 40) AS contact_whatsapp
FROM (SELECT c_custkey, 0 AS v FROM customer WHERE c_custkey % 5 = 0 UNION ALL
      SELECT c_custkey, 1 AS v FROM customer WHERE c_custkey % 10 = 0) c""")


def existing_cases(t: BankTables):
    keys = t.base("customer").select("c_custkey").filter("c_custkey % 5 = 0")
    rows = keys.withColumn("v", F.explode(F.when(F.col("c_custkey") % 10 == 0, F.array(F.lit(0), F.lit(1)))
                                          .otherwise(F.array(F.lit(0)))))
    key, v = F.col("c_custkey"), F.col("v")
    state = (key + v) % 7
    return rows.select(
        F.concat(F.lit("OLD-"), key.cast("string"), F.lit("-"), v.cast("string")).alias("case_id"),
        F.concat(F.lit("C"), F.lpad(key.cast("string"), 8, "0")).alias("customer_id"),
        F.date_add(F.lit(dt.date(2024, 1, 1)), ((key + v * 3) % 20).cast("int")).cast("timestamp_ntz").alias("created_at"),
        F.when((key + v) % 9 == 0, "public_demo").otherwise("anomaly_model").alias("source"),
        F.when(state == 0, "otp_sent").when(state == 1, "verified").when(state == 2, "escalated").otherwise("closed").alias("status"),
        F.concat(F.lit("+57300"), (key % 40).cast("string")).alias("contact_whatsapp"))


view("requested", """
SELECT customer_id, max(anomaly_score) AS anomaly_score FROM case_queue WHERE processed_at IS NULL GROUP BY customer_id""")


@query("pending_queue", "SELECT * FROM requested ORDER BY customer_id LIMIT 100", rounds=["anomaly_score"])
def pending_queue(t: BankTables):
    return rounded(K.pending_queue(case_queue(t), 100))


view("open_now", """
SELECT customer_id, case_id FROM existing_cases
WHERE status IN ('otp_sent', 'verified', 'customer_reported_fraud', 'escalated') AND source <> 'public_demo'
QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY created_at DESC, case_id) = 1""")


@query("open_case_lookup", "SELECT * FROM open_now")
def open_case_lookup(t: BankTables):
    return K.open_case_lookup(existing_cases(t))


@query("open_case_by_phone", """
SELECT contact_whatsapp, case_id, customer_id, status FROM existing_cases WHERE status <> 'closed'
QUALIFY row_number() OVER (PARTITION BY contact_whatsapp ORDER BY created_at DESC, case_id) = 1""")
def open_case_by_phone(t: BankTables):
    return K.open_case_by_phone(existing_cases(t))


view("first_ids", """
SELECT customer, id FROM scored_tx WHERE id LIKE '%5' QUALIFY row_number() OVER (PARTITION BY customer ORDER BY id) <= 5""")
# Requests of every kind: flagged by the model, by the rules only, and with given transactions.
view("case_requests", """
SELECT customer_id, CASE WHEN substr(customer_id, 9, 1) IN ('1', '4', '7') THEN 'risk_engine' ELSE 'anomaly_model' END AS source,
       anomaly_score, (SELECT string_agg(id, ',' ORDER BY id) FROM first_ids s WHERE s.customer = customer_id
                       AND substr(customer_id, 9, 1) = '3') AS transaction_ids FROM requested""")
PICK_SCORE = 60       # a stricter limit than the default, so that some customers fall back to their top three
PICK_SETTINGS = replace(SETTINGS, suspicious=PICK_SCORE)


def requests(wanted, rows):
    named = rows.filter((F.substring("customer", 9, 1) == "3") & F.col("id").endswith("5")).select("customer", "id")
    listed = top_rows(named, ["customer"], ["id"], 5).groupBy("customer").agg(
        F.array_join(F.array_sort(F.collect_list("id")), ",").alias("transaction_ids"))
    source = F.when(F.substring("customer_id", 9, 1).isin("1", "4", "7"), "risk_engine").otherwise("anomaly_model")
    return wanted.join(listed.withColumnRenamed("customer", "customer_id"), "customer_id", "left").select(
        "customer_id", source.alias("source"), "anomaly_score", "transaction_ids")


view("picked", f"""
SELECT r.customer_id, 'anomaly_model' AS source, s.id, s.score, s.reasons,
       list_position(string_split(r.transaction_ids, ','), s.id) AS position
FROM case_requests r JOIN scored_tx s ON s.customer = r.customer_id AND list_contains(string_split(r.transaction_ids, ','), s.id)
UNION ALL
SELECT r.customer_id, r.source, a.id, a.score, a.reasons, epoch_us(a.timestamp) FROM case_requests r JOIN analysis_tx a ON a.customer = r.customer_id
WHERE r.transaction_ids IS NULL AND a.score >= {PICK_SCORE}
UNION ALL
SELECT customer_id, source, id, score, reasons, nth FROM (
  SELECT r.customer_id, r.source, a.*, row_number() OVER (PARTITION BY r.customer_id ORDER BY a.score DESC, a.timestamp, a.id) AS nth,
         max(a.score) OVER (PARTITION BY r.customer_id) AS top
  FROM case_requests r JOIN analysis_tx a ON a.customer = r.customer_id
  WHERE r.transaction_ids IS NULL AND r.source = 'anomaly_model') f WHERE top < {PICK_SCORE} AND nth <= 3""")


def case_inputs(t: BankTables):
    """All pending customers with the scores of their transactions; nobody else is scored."""
    wanted = materialize(K.pending_queue(case_queue(t), None), "pending")
    rows = materialize(R.score_transactions(t.transactions, SETTINGS, wanted.select(F.col("customer_id").alias("customer"))), "scored")
    return requests(wanted, rows), rows, A.analyze_window(rows, ANALYSIS_DAYS)


@query("case_transactions_pick", "SELECT customer_id, source, id, score, cast(position AS BIGINT) AS position FROM picked")
def case_transactions_pick(t: BankTables):
    wanted, rows, window = case_inputs(t)
    picked = K.case_transactions_pick(wanted, rows, window, PICK_SETTINGS)
    # Positions in a given list count from zero here and from one in SQL.
    listed = wanted.filter("transaction_ids IS NOT NULL").select("customer_id", F.lit(1).alias("first"))
    at = F.col("position") + F.coalesce("first", F.lit(0))
    return picked.join(listed, "customer_id", "left").select("customer_id", "source", "id", "score", at.alias("position"))


CASE_ID = f"'CASE-' || upper(left(md5(customer_id || '#{OPENED}'), 12))"
view("contacts_of_customers", r"""
SELECT customer_id, email, CASE WHEN replace(mobile_phone, ' ', '') LIKE '+%' THEN replace(mobile_phone, ' ', '') END AS whatsapp
FROM customers QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY last_updated DESC) = 1""")
view("new_cases", f"""
SELECT {CASE_ID} AS case_id, p.customer_id, p.source, max_score, p.transaction_ids,
       left(concat_ws(' | ', CASE WHEN p.source = 'anomaly_model' THEN '{K.CUSTOMER_FLAGGED}' END, nullif(reasons, '')), 2000) AS reasons,
       c.email AS contact_email, coalesce(regexp_replace(c.whatsapp, '[^0-9+]', '', 'g'), '') AS contact_whatsapp, 'otp_sent' AS status,
       r.anomaly_score
FROM (SELECT customer_id, source, max(score) AS max_score, string_agg(id, ',' ORDER BY position, id) AS transaction_ids FROM picked
      GROUP BY ALL) p
JOIN case_requests r USING (customer_id) JOIN contacts_of_customers c USING (customer_id)
LEFT JOIN (SELECT customer_id, string_agg(reason, ' | ' ORDER BY reason) AS reasons FROM (
             SELECT DISTINCT customer_id, unnest(reasons) AS reason FROM picked) d GROUP BY customer_id) w USING (customer_id)
WHERE customer_id NOT IN (SELECT customer_id FROM open_now)""")


def opened(t: BankTables):
    wanted, rows, window = case_inputs(t)
    contacts = K.contact_resolution(latest_profiles(t.customers))
    cases, links = K.open_cases(materialize(wanted, "requests"), rows, window, contacts, existing_cases(t), OPENED,
                                settings=PICK_SETTINGS)
    return wanted, rows, cases, links


@query("open_cases", "SELECT * FROM new_cases", rounds=["anomaly_score"])
def open_cases(t: BankTables):
    _, _, cases, _ = opened(t)
    return rounded(cases.drop("created_at", "updated_at", "demo_mode", "customer_comment"))


# The life cycle asks for all of them as flagged by the model, so any transaction in the window makes a case.
view("queue_cases", f"""
SELECT {CASE_ID} AS case_id, customer_id FROM requested JOIN contacts_of_customers USING (customer_id)
WHERE customer_id NOT IN (SELECT customer_id FROM open_now) AND customer_id IN (SELECT customer FROM analysis_tx)""")


@query("process_queue", """
SELECT q.customer_id, q.model_name, coalesce(o.case_id, n.case_id) AS case_id,
       CASE WHEN o.case_id IS NOT NULL THEN 'duplicate' WHEN n.case_id IS NOT NULL THEN 'case_opened' ELSE 'not_found' END AS result
FROM case_queue q JOIN requested USING (customer_id) LEFT JOIN open_now o USING (customer_id) LEFT JOIN queue_cases n USING (customer_id)
WHERE q.processed_at IS NULL""")
def process_queue(t: BankTables):
    """The whole queue worked off on operational tables; the outcomes are read back from them."""
    ops, queue = Operations(t.spark, scratch(t, "casework")), materialize(case_queue(t), "queue")
    empty = ops.empty("fraud_cases")
    held = existing_cases(t)
    ops.append("anomaly_queue", queue)
    ops.append("fraud_cases", held.select(*[F.col(f.name) if f.name in held.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in empty.schema]))
    ops.append("queue_outcomes", queue.filter("processed_at IS NOT NULL").select(
        "customer_id", "detected_at", "model_name", "processed_at", F.lit("earlier").alias("case_id"), F.lit("case_opened").alias("result")))
    lifecycle.process_queue(ops, t.transactions, t.customers, OPENED, ANALYSIS_DAYS, None, settings=SETTINGS)
    return ops.read("queue_outcomes").filter("case_id IS NULL OR case_id <> 'earlier'").select("customer_id", "model_name", "case_id", "result")


@query("case_details", f"""
SELECT n.case_id, n.customer_id, s.id AS transaction_id, s.score, s.level,
       array_to_string(CASE WHEN n.source = 'anomaly_model' THEN list_concat(['{K.TRANSACTION_FLAGGED}'], s.reasons) ELSE s.reasons END, ' | ')
       AS reasons, l.card
FROM (SELECT *, unnest(string_split(transaction_ids, ',')) AS tx FROM new_cases) n
JOIN scored_tx s ON s.customer = n.customer_id AND s.id = n.tx LEFT JOIN labels_of_products l ON l.product_id = s.product""")
def case_details(t: BankTables):
    _, rows, cases, links = opened(t)
    details = K.case_details(cases, links, rows, product_labels(t.products))
    return details.select("case_id", "customer_id", "transaction_id", "score", "level", F.array_join("reasons", " | ").alias("reasons"), "card")


# Updates of cases: the orders of a customer as steps of its case.
STATUS = "CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'verified' ELSE 'escalated' END"


@query("case_status_fold", f"""
SELECT 'CASE-' || o_custkey AS case_id, arg_max({STATUS}, o_orderdate + to_microseconds(o_orderkey)) AS status,
       arg_max(comment, o_orderdate + to_microseconds(o_orderkey)) FILTER (WHERE comment IS NOT NULL) AS customer_comment,
       max(o_orderdate + to_microseconds(o_orderkey)) AS updated_at
FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN 'nota ' || o_orderkey END AS comment FROM orders) o GROUP BY o_custkey""")
def case_status_fold(t: BankTables):
    orders = t.base("orders")
    status = F.when(F.col("o_orderstatus") == "F", "closed").when(F.col("o_orderstatus") == "O", "verified").otherwise("escalated")
    events = orders.select(
        F.concat(F.lit("CASE-"), F.col("o_custkey").cast("string")).alias("case_id"),
        (F.col("o_orderdate") + F.make_dt_interval(secs=F.col("o_orderkey").cast("decimal(18,6)") / 1000000)).alias("at"),
        status.alias("status"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("nota "), F.col("o_orderkey").cast("string"))).alias("comment"))
    return K.case_status_fold(events)


# --- routing -----------------------------------------------------------------------------------
def routed_cases(t: BankTables):
    """A case per customer: language, accent and country of the profile, hour by the id."""
    hour = F.col("customer_id").substr(8, 2).cast("int") % 24
    return latest_profiles(t.customers).select(
        F.concat(F.lit("K-"), "customer_id").alias("case_id"), "customer_id",
        F.when(F.col("customer_id").endswith("99"), "deutsch").otherwise(F.col("language")).alias("language"), "accent", "country",
        hour.alias("hour"), F.lit("no reconoce").alias("reason"), F.lit("resumen").alias("summary"))


view("routed", f"""
SELECT 'K-' || customer_id AS case_id, customer_id, CASE WHEN customer_id LIKE '%99' THEN 'deutsch' ELSE preferred_language END AS language,
       {normalized('detected_accent')} AS accent, {normalized('country')} AS country,
       cast(substr(customer_id, 8, 2) AS INT) % 24 AS hour
FROM customers QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY last_updated DESC) = 1""")
view("routed_languages", f"""
SELECT *, CASE WHEN left({normalized('language')}, 2) IN ('es', 'sp') THEN 'es' WHEN left({normalized('language')}, 2) IN ('pt', 'po') THEN 'pt'
       WHEN left({normalized('language')}, 2) IN ('en', 'in') THEN 'en' END AS lang FROM routed""")
view("chat_agents", f"""
SELECT *, {normalized('languages')} AS spoken, lower(agent_type) AS kind, {normalized('native_accent')} AS own_accent,
       {normalized('country_of_origin')} AS own_country, coalesce({normalized('specialty')}, '') LIKE '%fraude%' AS specialist,
       lower(coalesce(work_shift, '')) AS shift
FROM (SELECT DISTINCT * FROM service_agents WHERE agent_status = 'Active') a WHERE lower(agent_type) <> 'in-person'""")
SHIFT_SQL = ("(shift = 'rotating' OR (shift = 'morning' AND hour >= 6 AND hour < 14) OR (shift = 'afternoon' AND hour >= 14 AND hour < 22) "
             "OR (shift = 'night' AND (hour >= 22 OR hour < 6)))")
RANKED = f"""
SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY routing_score DESC, agent_id) AS rank FROM (
  SELECT *, round_even(specialist::INT * 40.0 + same_accent::INT * 20 + same_country::INT * 15 + working::INT * 15
         + (kind IN ('digital', 'hybrid'))::INT * 10
         + CASE lower(experience_level) WHEN 'specialist' THEN 10 WHEN 'senior' THEN 7 WHEN 'mid-senior' THEN 4 ELSE 0 END
         + coalesce(avg_csat, 3.5) * 3 - coalesce(total_monthly_interactions, 0) / 100, 1) AS routing_score,
         concat_ws('; ', 'habla ' || CASE lang WHEN 'es' THEN 'español' WHEN 'pt' THEN 'portugués' ELSE 'inglés' END,
           CASE WHEN specialist THEN 'especialista en fraudes' END,
           CASE WHEN same_accent THEN 'mismo acento (' || native_accent || ')' END,
           CASE WHEN same_country THEN 'mismo país (' || country_of_origin || ')' END,
           CASE WHEN working THEN 'en turno (' || work_shift || ')' END,
           CASE WHEN kind IN ('digital', 'hybrid') THEN 'atiende chat (' || agent_type || ')' END) AS routing_reasons
  FROM (SELECT c.case_id, c.customer_id, c.lang, a.*, coalesce(c.accent, '') NOT IN ('', 'neutral') AND own_accent = c.accent AS same_accent,
               coalesce(c.country, '') <> '' AND own_country = c.country AS same_country, {SHIFT_SQL} AS working
        FROM routed_languages c JOIN chat_agents a ON
          (c.lang = 'es' AND spoken LIKE '%espanol%') OR (c.lang = 'pt' AND spoken LIKE '%portugues%') OR (c.lang = 'en' AND spoken LIKE '%ingles%')) p) q"""
view("ranked_agents", RANKED)
view("routed_spoken", "SELECT * REPLACE (coalesce(lang, 'es') AS lang) FROM routed_languages")
view("ranked_spoken", RANKED.replace("routed_languages", "routed_spoken"))


@query("rank_agents", "SELECT case_id, rank, agent_id, routing_score, routing_reasons FROM ranked_agents WHERE rank <= 3")
def rank_agents(t: BankTables):
    ranked = G.rank_agents(routed_cases(t), active_agents(t.agents), top=3)
    return ranked.select("case_id", "rank", "agent_id", "routing_score", "routing_reasons")


@query("escalations", """
SELECT 'ESC-' || upper(left(md5(c.case_id), 12)) AS escalation_id, c.case_id, c.customer_id, r.agent_id,
       r.first_name || ' ' || r.last_name AS agent_name, c.lang AS language, r.routing_score,
       CASE WHEN r.agent_id IS NULL THEN 'pending_no_agent' ELSE 'open' END AS status
FROM routed_spoken c LEFT JOIN (SELECT * FROM ranked_spoken WHERE rank = 1) r USING (case_id)""")
def escalations(t: BankTables):
    rows = G.escalations(routed_cases(t), active_agents(t.agents), F.lit(OPENED).cast("timestamp_ntz"))
    return rows.select("escalation_id", "case_id", "customer_id", "agent_id", "agent_name", "language", "routing_score", "status")


@query("contact_resolution", """
SELECT customer_id, CASE WHEN customer_id LIKE '%3' THEN 'mapa@correo.example' ELSE coalesce(NULL, 'prueba@correo.example') END AS demo_email,
       CASE WHEN customer_id LIKE '%3' THEN NULL ELSE NULL END AS demo_whatsapp,
       CASE WHEN customer_id LIKE '%5' THEN 'directo@correo.example' ELSE email END AS email, whatsapp FROM contacts_of_customers""")
def contact_resolution(t: BankTables):
    """Both modes: with a contact map and a default, and with the customer's own contacts."""
    profiles = latest_profiles(t.customers)
    ids = profiles.select("customer_id")
    mapped = ids.filter(F.col("customer_id").endswith("3")).select(
        "customer_id", F.lit("mapa@correo.example").alias("email"), F.lit(None).cast("string").alias("whatsapp"))
    explicit = ids.filter(F.col("customer_id").endswith("5")).select(
        "customer_id", F.lit("directo@correo.example").alias("email"), F.lit(None).cast("string").alias("whatsapp"))
    demo = K.contact_resolution(profiles, mapped, "prueba@correo.example").withColumnsRenamed(
        {"email": "demo_email", "whatsapp": "demo_whatsapp"})
    return demo.join(K.contact_resolution(profiles, explicit=explicit), "customer_id")
