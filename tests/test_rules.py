"""The rules against brute force on histories with ties, nulls and hot customers."""

import datetime as dt
import math
import random
import statistics
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from riskloom.operators import analysis as A
from riskloom.operators import rules as R

START = dt.datetime(2024, 1, 1)
SCHEMA = ("transaction_id string, customer_id string, transaction_date timestamp_ntz, amount double, amount_usd double, "
          "currency string, transaction_country string, transaction_city string, merchant_category string, channel string, "
          "transaction_status string, fraud_score double, is_fraud boolean, latitude double, longitude double")


def histories(seed=3):
    """Customers with 1 to 120 transactions; coarse times give many equal moments and bursts."""
    rng = random.Random(seed)
    rows = []
    for c, size in enumerate([1, 4, 5, 6, 30, 60, 120]):
        dates_only = c == 4
        for i in range(size):
            minute = rng.randrange(0, size * 40, 5)
            at = START + (dt.timedelta(days=minute // 60) if dates_only else dt.timedelta(minutes=minute))
            amount = rng.choice([None, 0.0, 10.0, 11.0, 12.0, 10.5, 300.0, rng.uniform(5, 20)])
            where = rng.choice([(None, None), (4.6, -74.1), (6.2, -75.5), (40.4, -3.7)])
            rows.append((f"T{c}-{i:03d}", f"C{c}", at, 1.0, amount, "USD", rng.choice(["CO", "CO", "CO", "MX", "", None, "BR"]),
                         rng.choice(["Bogotá", "Cali", None, ""]), rng.choice(["a", "b", "c", "d", "e", None, ""]),
                         rng.choice(["ATM", "Web", None, "", " pos ", "App"]),
                         rng.choice(["Approved", "Declined", " DECLINED ", "Rechazada", None]), rng.choice([None, 12.0, 55.55, 99.0]),
                         False, where[0], where[1]))
    return rows


def brute_force(rows, burst_minutes):
    """Rule hits per transaction by plain loops over each customer's earlier rows."""
    hits = {}
    for customer in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == customer), key=lambda r: (r[2], r[0]))
        timed = any((r[2].hour, r[2].minute) != (0, 0) for r in own)
        for n, row in enumerate(own):
            earlier, found = own[:n], set()
            values = [e[4] for e in earlier if e[4] is not None]
            if row[4] is not None and len(values) >= 5:
                deviation = statistics.pstdev(values)
                mean = statistics.fmean(values)
                if deviation > 0 and row[4] - mean >= 3 * deviation and row[4] > 2 * mean:
                    found.add("amount")
            if n >= 5:
                new = {name: bool(row[k]) and all(e[k] != row[k] for e in earlier) for name, k in
                       (("country", 6), ("city", 7), ("category", 8))}
                if new["country"]:
                    found.add("country")
                elif new["city"]:
                    found.add("city")
                if new["category"] and row[4] and values and row[4] > statistics.median(values):
                    found.add("category")
                if timed and row[2].hour < 5 and sum(e[2].hour < 5 for e in earlier) / n < 0.05:
                    found.add("night")
            close = [e for e in earlier if row[2] - e[2] <= dt.timedelta(minutes=burst_minutes)]
            if timed and len(close) >= 2:
                found.add("burst")
            if timed and sum((e[10] or "").strip().lower() in R.DECLINED for e in close) >= 2:
                found.add("declines")
            here = [e for e in earlier + [row] if e[13] is not None and (e[9] or "").strip().lower() in ("", "atm", "branch", "pos")]
            if len(here) >= 2 and here[-1] is row:
                a, b = here[-2], row
                p, q = math.radians(a[13]), math.radians(b[13])
                angle = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[14] - a[14]) / 2) ** 2
                km, hours = 2 * 6371 * math.asin(math.sqrt(angle)), (b[2] - a[2]).total_seconds() / 3600
                if km >= 300 and (hours <= 0 or km / hours > 900):
                    found.add("travel")
            hits[row[0]] = found
    return hits


RULES = ["amount", "country", "city", "category", "night", "burst", "declines", "travel"]


@pytest.mark.parametrize("large_customer", [2_000, 20, 0])
@pytest.mark.parametrize("burst", [10, 60])
def test_rules_equal_brute_force(spark, large_customer, burst):
    rows = histories()
    settings = replace(R.DEFAULTS, burst_minutes=burst, large_customer=large_customer)
    scored = R.score_transactions(spark.createDataFrame(rows, SCHEMA), settings, keep_hits=True)
    got = {r["id"]: {name for name in RULES if r[f"hit_{name}"]} for r in scored.collect()}
    expected = brute_force(rows, burst)
    assert {k: v for k, v in got.items() if v != expected[k]} == {}
    assert len(got) == len(rows)
    assert set().union(*got.values()) >= {"amount", "country", "city", "category", "burst", "declines", "travel"}


def test_score_level_and_reasons(spark):
    rows = [(f"T{i}", "C", START + dt.timedelta(days=i, hours=12), 1.0, 10.0 + i % 2, "USD", "CO", "Cali", "a", "Web", "Approved",
             10.0, False, None, None) for i in range(8)]
    rows.append(("T9", "C", START + dt.timedelta(days=20, hours=3, minutes=7), 1.0, 1050.0, "USD", "BR", "Rio", "z", "Web", "Approved",
                 55.55, True, None, None))
    scored = {r["id"]: r for r in R.score_transactions(spark.createDataFrame(rows, SCHEMA)).collect()}
    last = scored["T9"]
    assert last["rule_score"] == 40 + 30 + 10 + 15 and last["level"] == "high" and last["score"] == 95.0
    assert last["reasons"] == [
        "Monto 100.0 veces mayor a su promedio (10 USD)", "Primera transacción registrada en BR",
        "Categoría nueva para el cliente: z", "Hora inusual (03:07) para sus hábitos",
        "El modelo antifraude del banco le asignó 56/100"]
    assert scored["T3"]["reasons"] == [] and scored["T3"]["level"] == "low"


def test_label_does_not_change_the_score(spark):
    df = spark.createDataFrame(histories(), SCHEMA)
    names = ["id", "rule_score", "score"]
    flipped = R.score_transactions(df.withColumn("is_fraud", F.lit(True))).select(*names)
    assert flipped.exceptAll(R.score_transactions(df).select(*names)).count() == 0


def test_copies_do_not_count_twice(spark):
    rows = histories()
    once = R.score_transactions(spark.createDataFrame(rows, SCHEMA)).select("id", "rule_score")
    twice = R.score_transactions(spark.createDataFrame(rows + rows, SCHEMA)).select("id", "rule_score")
    assert once.exceptAll(twice).count() == 0 and twice.count() == len(rows)


def test_probability_scores_are_scaled_and_since_keeps_history(spark):
    df = spark.createDataFrame(histories(), SCHEMA).withColumn("fraud_score", F.col("fraud_score") / 100)
    scored = R.score_transactions(df)
    assert scored.agg(F.max("model_score")).first()[0] == 99.0
    later = R.score_since(scored, dt.datetime(2024, 1, 2))
    assert later.exceptAll(scored).count() == 0 and 0 < later.count() < scored.count()


def test_levels_and_boundaries(spark):
    levels = spark.createDataFrame([(29.9,), (30.0,), (59.9,), (60.0,)], "s double").select(R.risk_level(F.col("s")).alias("l"))
    assert [r["l"] for r in levels.collect()] == ["low", "medium", "medium", "high"]


def test_burst_counts_exactly_ten_minutes(spark):
    rows = [(f"T{i}", "C", START + dt.timedelta(hours=1, minutes=m, seconds=s), 1.0, 1.0, "USD", "CO", "x", "a", "Web", "Approved", None,
             False, None, None) for i, (m, s) in enumerate([(0, 0), (5, 0), (10, 0), (20, 1)])]
    got = {r["id"]: r["hit_burst"] for r in R.score_transactions(spark.createDataFrame(rows, SCHEMA), keep_hits=True).collect()}
    assert got == {"T0": False, "T1": False, "T2": True, "T3": False}


def test_recent_transactions_and_window(spark):
    df = spark.createDataFrame(histories(), SCHEMA)
    scored = R.score_transactions(df)
    window = A.analyze_window(scored, 1)
    for row in window.groupBy("customer").agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).collect():
        assert row["b"] - row["a"] <= dt.timedelta(days=1)
    recent = A.recent_transactions(scored, days=400, limit=500, ceiling=50)
    assert recent.groupBy("customer").count().agg(F.max("count")).first()[0] == 50


def subscription_rows():
    """Twenty customers that pay one constant amount; one payment is four times as large. One row has no id."""
    rows = []
    for c in range(20):
        for i in range(60):
            amount = (0.1 + c) * (4 if i == 46 else 1)
            rows.append((None if (c, i) == (3, 30) else f"S{c}-{i:03d}", f"C{c}", START + dt.timedelta(hours=7 * i), amount, amount, "USD", "CO", "Cali", "a",
                         "Web", "Approved", None, False, None, None))
    return rows


@pytest.mark.parametrize("limit", [2_000, 59, 1])
def test_constant_amounts_and_missing_ids_are_alike_on_both_paths(spark, limit):
    settings = replace(R.DEFAULTS, large_customer=limit)
    scored = R.score_transactions(spark.createDataFrame(subscription_rows(), SCHEMA), settings, keep_hits=True)
    assert scored.count() == 1200
    assert scored.filter("hit_amount").count() == 0          # nothing deviates before, so there is no deviation to exceed
    assert scored.filter("prior_n >= 5 AND prior_n <= 46 AND amt_std != 0").count() == 0
    assert scored.filter("id IS NULL").count() == 1


@pytest.mark.parametrize("limit", [2_000, 1])
def test_means_are_exact_and_texts_round_half_to_even(spark, limit):
    """The five amounts sum to 212.5, added one by one to a little more; 4.55 lies a little below its text."""
    amounts = [40.22, 43.52, 44.92, 42.97, 40.87, 193.375]
    rows = [(f"E{i}", "C", START + dt.timedelta(days=i, hours=9), a, a, "USD", "CO", "Cali", "a", "Web", "Approved", None, False, None, None)
            for i, a in enumerate(amounts)]
    settings = replace(R.DEFAULTS, large_customer=limit)
    scored = R.score_transactions(spark.createDataFrame(rows, SCHEMA), settings, keep_hits=True)
    last = scored.filter("id = 'E5'").first()
    assert last["amt_mean"] == 42.5 and last["reasons"] == ["Monto 4.5 veces mayor a su promedio (42 USD)"]


def test_tasks_hold_a_bounded_number_of_rows(spark):
    """Sixty customers of ten rows, forty rows to a task: not merged into a few tasks, whatever the number of cores."""
    rows = [(f"B{c}-{i}", f"C{c}", START + dt.timedelta(hours=i), 1.0, 1.0, "USD", "CO", "Cali", "a", "Web", "Approved", None, False, None, None)
            for c in range(60) for i in range(10)]
    scored = R.score_transactions(spark.createDataFrame(rows, SCHEMA), replace(R.DEFAULTS, rows_in_task=40))
    sizes = [r["count"] for r in scored.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()]
    assert sum(sizes) == 600 and len(sizes) >= 10 and max(sizes) <= 120


def test_newest_versions_are_picked_in_tasks_of_bounded_size(spark):
    """The rows lie in one task; no sort by their ids may run there."""
    rows = [(f"V{i % 300}", f"C{i % 7}", START + dt.timedelta(hours=i), 1.0, 1.0, "USD", "CO", "Cali", "a", "Web", "Approved", None, False, None, None)
            for i in range(600)]
    scored = R.score_transactions(spark.createDataFrame(rows, SCHEMA).coalesce(1), replace(R.DEFAULTS, rows_in_task=40))
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [_nth" in plan and scored.count() == 300


def test_facts_are_not_shuffled_again_for_the_medians(spark):
    rows = [(f"S{i}", f"C{i % 7}", START + dt.timedelta(hours=i), 1.0, 1.0, "USD", "CO", "Cali", "a", "Web", "Approved", None, False, None, None)
            for i in range(60)]
    plan = R.score_transactions(spark.createDataFrame(rows, SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [customer") == 3          # the facts, the rows of the medians, the medians
