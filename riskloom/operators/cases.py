"""Fraud cases: from queued customers to case rows, their transactions and their state."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.numbers import micros
from riskloom.functions.text import normalize_phone
from riskloom.operators.rules import DEFAULTS, RuleSettings
from riskloom.operators.scaling import top_rows
from riskloom.session import materialize

# Case states that still block a new case, sources set by the model, and texts.
OPEN_STATUSES = ("otp_sent", "verified", "customer_reported_fraud", "escalated")
CLOSED_STATUS = "closed"
FIRST_STATUS = "otp_sent"
DEMO_SOURCE = "public_demo"
MODEL_SOURCES = ("anomaly_model", DEMO_SOURCE)
CUSTOMER_FLAGGED = "Cliente marcado por el modelo de detección de anomalías"
TRANSACTION_FLAGGED = "Marcada por el modelo de detección de anomalías del banco"
REASONS_LENGTH = 2000
FALLBACK_TRANSACTIONS = 3
QUEUE_LIMIT = 50


def pending_queue(queue: DataFrame, limit: int | None = QUEUE_LIMIT) -> DataFrame:
    """Pending customers with their highest score: the first by id, or all of them without a limit."""
    pending = queue.filter(F.col("processed_at").isNull()).groupBy("customer_id").agg(
        F.max("anomaly_score").alias("anomaly_score"))
    return pending if limit is None else pending.orderBy("customer_id").limit(limit)


def queue_state(queue: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The queue with what became of each row. Both tables are only ever appended to."""
    keys = ["customer_id", "detected_at", "model_name"]
    first = F.min(F.struct("processed_at", "case_id", "result")).alias("_done")
    done = outcomes.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(first)     # one per key, also after a repeated run
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return queue.join(done, same, "left").select(*queue.columns, "_done.*")


def open_case_lookup(cases: DataFrame) -> DataFrame:
    """Newest case of every customer that is still open; demonstration cases do not count."""
    open_now = cases.filter(F.col("status").isin(*OPEN_STATUSES) & (F.col("source") != DEMO_SOURCE))
    return top_rows(open_now, ["customer_id"], [F.col("created_at").desc(), F.col("case_id")]).select(
        "customer_id", "case_id")


def open_case_by_phone(cases: DataFrame) -> DataFrame:
    """Newest case per contact number that is not closed."""
    active = cases.filter((F.col("status") != CLOSED_STATUS) & (F.col("contact_whatsapp") != ""))
    return top_rows(active, ["contact_whatsapp"], [F.col("created_at").desc(), F.col("case_id")]).select(
        "contact_whatsapp", "case_id", "customer_id", "status")


def case_transactions_pick(requests: DataFrame, scored: DataFrame, window: DataFrame,
                           settings: RuleSettings = DEFAULTS) -> DataFrame:
    """Transactions of each requested case: customer_id, source, id, score, reasons and position.

    Given ids are taken as they are. Otherwise the suspicious transactions of the window; and for a
    customer flagged by the model without any, the few with the highest scores (ties: earliest).
    """
    fields = ["customer_id", "source", "id", "score", "reasons", "position"]
    asked = requests.filter(F.coalesce("transaction_ids", F.lit("")) != "").select(
        "customer_id", F.lit("anomaly_model").alias("source"),
        F.posexplode(F.split("transaction_ids", ",")).alias("position", "id")).filter(F.col("id") != "")
    given = asked.join(scored.select(F.col("customer").alias("customer_id"), "id", "score", "reasons"),
                       ["customer_id", "id"]).withColumn("position", F.col("position").cast("bigint"))

    free = requests.filter(F.coalesce("transaction_ids", F.lit("")) == "").select("customer_id", "source")
    rows = window.withColumnRenamed("customer", "customer_id").join(free, "customer_id")
    suspicious = rows.filter(F.col("score") >= settings.suspicious).withColumn(
        "position", micros(F.col("timestamp")))
    unusual = top_rows(rows.filter(F.col("source").isin(*MODEL_SOURCES)), ["customer_id"],
                       [F.col("score").desc(), F.col("timestamp"), F.col("id")], FALLBACK_TRANSACTIONS, rank="position")
    fallback = unusual.withColumn("position", F.col("position").cast("bigint")).join(
        suspicious.select("customer_id").distinct(), "customer_id", "left_anti")
    return given.select(*fields).unionByName(suspicious.select(*fields)).unionByName(fallback.select(*fields))


def case_identifier(opened: dt.date | str) -> Column:
    """Derived from customer and opening day, so that a repeated run gives the same ids."""
    return F.concat(F.lit("CASE-"), F.upper(F.left(F.md5(F.concat(F.col("customer_id"), F.lit(f"#{opened}"))), F.lit(12))))


def case_rows(picked: DataFrame) -> DataFrame:
    """One row per customer with a case: highest score, explanations and transaction ids.

    Explanations are made distinct before they are collected, and no more of them than can fit the
    fixed length of the text. The joined ids have all transactions, in their order; the linked table
    has them as rows.
    """
    keys = ["customer_id", "source"]
    totals = picked.groupBy(*keys).agg(F.max("score").alias("max_score"), F.count(F.lit(1)).alias("n_transactions"))
    ids = picked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("position", "id"))).alias("_ids"))
    texts = picked.select(*keys, F.explode("reasons").alias("reason")).distinct()
    # A reason and its separator take at least four characters.
    first = top_rows(texts, keys, [F.col("reason")], REASONS_LENGTH // 4 + 1)
    explained = first.groupBy(*keys).agg(F.array_sort(F.collect_list("reason")).alias("_reasons"))
    flagged = F.when(F.col("source").isin(*MODEL_SOURCES), F.array(F.lit(CUSTOMER_FLAGGED))).otherwise(
        F.array().cast("array<string>"))
    listed = F.concat(flagged, F.coalesce("_reasons", F.array().cast("array<string>")))
    return (totals.join(ids, keys, "left").join(explained, keys, "left")
                  .withColumns({"transaction_ids": F.array_join(F.transform("_ids", lambda x: x["id"]), ","),
                                "reasons": F.left(F.array_join(listed, " | "), F.lit(REASONS_LENGTH))})
                  .drop("_ids", "_reasons"))


def contact_resolution(profiles: DataFrame, mapped: DataFrame | None = None, default_email: str | None = None,
                       default_whatsapp: str | None = None, explicit: DataFrame | None = None) -> DataFrame:
    """customer_id, email, whatsapp. Explicit contacts come first.

    With a contact map (demonstration mode): the mapped contact, then the default. Without: the
    customer's own, where a phone must be in international form.
    """
    def given(name: str) -> Column:
        return F.nullif(F.col(name), F.lit(""))       # a blank contact is none

    result = profiles.select("customer_id", given("email").alias("_own_email"), F.col("phone").alias("_own_phone"))
    if explicit is not None:
        result = result.join(explicit.select("customer_id", given("email").alias("_email"),
                                             given("whatsapp").alias("_whatsapp")), "customer_id", "left")
    else:
        result = result.withColumns({"_email": F.lit(None).cast("string"), "_whatsapp": F.lit(None).cast("string")})
    if mapped is not None:
        result = result.join(mapped.select("customer_id", given("email").alias("_mapped_email"),
                                           given("whatsapp").alias("_mapped_whatsapp")), "customer_id", "left")
        email = F.coalesce("_email", "_mapped_email", F.lit(default_email).cast("string"))
        whatsapp = F.coalesce("_whatsapp", "_mapped_whatsapp", F.lit(default_whatsapp).cast("string"))
    else:
        phone = F.replace(F.coalesce("_own_phone", F.lit("")), F.lit(" "), F.lit(""))
        email = F.coalesce("_email", "_own_email")
        whatsapp = F.coalesce(F.col("_whatsapp"), F.when(phone.startswith("+"), phone))
    return result.select("customer_id", email.alias("email"), whatsapp.alias("whatsapp"))


def open_cases(requests: DataFrame, scored: DataFrame, window: DataFrame, contacts: DataFrame, existing: DataFrame,
               opened: dt.date | str, demo_mode: bool = False, settings: RuleSettings = DEFAULTS
               ) -> tuple[DataFrame, DataFrame]:
    """(cases, links) for the requested customers.

    `requests`: customer_id, source, anomaly_score, transaction_ids. Unknown customers (without
    contacts row), customers with an open case and customers without a transaction to show get none.
    `links` holds case_id, transaction_id and position, one row per transaction of a case.
    """
    fresh = (requests.join(contacts.select("customer_id"), "customer_id", "left_semi")
                     .join(open_case_lookup(existing).select("customer_id"), "customer_id", "left_anti"))
    picked = materialize(case_transactions_pick(fresh, scored, window, settings), "case-transactions")
    moment = F.lit(opened).cast("timestamp_ntz")
    cases = (case_rows(picked).join(fresh.select("customer_id", "anomaly_score"), "customer_id")
             .join(contacts, "customer_id")
             .select(case_identifier(opened).alias("case_id"), "customer_id", moment.alias("created_at"),
                     moment.alias("updated_at"), "source", "transaction_ids", "max_score", "reasons",
                     F.col("email").alias("contact_email"), normalize_phone(F.col("whatsapp")).alias("contact_whatsapp"),
                     F.lit(demo_mode).alias("demo_mode"), F.lit(FIRST_STATUS).alias("status"),
                     F.lit(None).cast("string").alias("customer_comment"), "anomaly_score"))
    links = picked.select(case_identifier(opened).alias("case_id"), F.col("id").alias("transaction_id"), "position")
    return cases, links


def queue_outcomes(queue: DataFrame, picked_customers: DataFrame, cases: DataFrame, existing: DataFrame,
                   processed_at: Column) -> DataFrame:
    """Outcome of every pending queue row of the processed customers."""
    duplicates = open_case_lookup(existing).withColumnRenamed("case_id", "_duplicate")
    opened = cases.select("customer_id", F.col("case_id").alias("_opened"))
    pending = queue.filter(F.col("processed_at").isNull()).join(
        picked_customers.select("customer_id").distinct(), "customer_id", "left_semi")
    result = (F.when(F.col("_duplicate").isNotNull(), "duplicate").when(F.col("_opened").isNotNull(), "case_opened")
               .otherwise("not_found"))
    return (pending.join(duplicates, "customer_id", "left").join(opened, "customer_id", "left")
            .select("customer_id", "detected_at", "model_name", processed_at.alias("processed_at"),
                    F.coalesce("_duplicate", "_opened").alias("case_id"), result.alias("result")))


def case_details(cases: DataFrame, links: DataFrame, scored: DataFrame, labels: DataFrame) -> DataFrame:
    """Transactions of the cases with their scores, explanations and card labels."""
    linked = links.join(cases.select("case_id", "customer_id", "source"), "case_id")
    rows = linked.join(scored.withColumnsRenamed({"customer": "customer_id", "id": "transaction_id"}),
                       ["customer_id", "transaction_id"])
    flagged = F.concat(F.array(F.lit(TRANSACTION_FLAGGED)), F.col("reasons"))
    rows = rows.withColumn("reasons", F.when(F.col("source").isin(*MODEL_SOURCES), flagged).otherwise(F.col("reasons")))
    return rows.join(labels.select(F.col("product_id").alias("product"), "card"), "product", "left").select(
        "case_id", "customer_id", "transaction_id", "position", "timestamp", "amount", "score", "level", "reasons", "card")


def links_from_text(cases: DataFrame) -> DataFrame:
    """The linked rows of cases that only have the joined ids."""
    parts = cases.select("case_id", F.posexplode(F.split("transaction_ids", ",")).alias("position", "transaction_id"))
    return parts.filter(F.col("transaction_id") != "").select(
        "case_id", "transaction_id", F.col("position").cast("bigint").alias("position"))


def current_cases(cases: DataFrame, updates: DataFrame) -> DataFrame:
    """The cases in their present state: as opened, or as the appended updates left them."""
    state = case_status_fold(updates).select(
        "case_id", F.col("status").alias("_status"), F.col("customer_comment").alias("_comment"), F.col("updated_at").alias("_at"))
    return cases.join(state, "case_id", "left").withColumns({
        "status": F.coalesce("_status", "status"), "customer_comment": F.coalesce("_comment", "customer_comment"),
        "updated_at": F.greatest("_at", "updated_at")}).select(*cases.columns)


def case_status_fold(events: DataFrame) -> DataFrame:
    """Current state of every case from appended updates (case_id, at, status, comment).

    The last status wins, and the last comment that is not null stays.
    """
    return events.groupBy("case_id").agg(
        F.max_by("status", F.when(F.col("status").isNotNull(), F.struct("at", "status"))).alias("status"),
        F.max_by("comment", F.when(F.col("comment").isNotNull(), F.struct("at", "comment"))).alias("customer_comment"),
        F.max("at").alias("updated_at"))


def deciding_updates(events: DataFrame) -> DataFrame:
    """The updates that `case_status_fold` still depends on, whatever comes later: per case the last with a
    status, the last with a comment and the last of all. At most three rows of a case stay."""
    row = F.struct("at", "status", "comment")
    last = events.groupBy("case_id").agg(F.array_distinct(F.array_compact(F.array(
        F.max_by(row, F.when(F.col("status").isNotNull(), F.struct("at", "status"))),
        F.max_by(row, F.when(F.col("comment").isNotNull(), F.struct("at", "comment"))),
        F.max_by(row, F.struct("at"))))).alias("rows"))
    return last.select("case_id", F.inline("rows"))
