"""Probes above the median of all earlier values, against sorting."""

import bisect
import random
import statistics

import pytest
from pyspark.sql import functions as F

from riskloom.operators.order_statistics import above_prior_median, above_prior_median_in_chunks

SCHEMA = "customer string, _us bigint, id string, _row bigint, category string, _amt double, new boolean"


def history(customer, size, kinds, seed, choices=None):
    rng = random.Random(seed)
    rows, seen = [], set()
    for i in range(size):
        category = f"k{rng.randrange(kinds)}"
        amount = rng.choice([None, 10.0, 10.5, 11.0, 300.0]) if choices == "few" else round(rng.lognormvariate(3, 1), 2)
        rows.append((customer, i // 3, f"{i:07d}", seed * 10_000_000 + i, category, amount, category not in seen))
        seen.add(category)
    return rows


def by_sorting(rows):
    found, values, customer = {}, [], None
    for r in rows:
        values = values if r[0] == customer else []
        customer = r[0]
        if r[5] is not None:
            if r[6]:
                n = len(values)
                median = None if not n else (values[n // 2] if n % 2 else (values[n // 2 - 1] + values[n // 2]) / 2)
                found[r[0], r[4]] = bool(n) and r[5] > median
            bisect.insort(values, r[5])
    return found


@pytest.mark.parametrize("sizes", [[(1, 1), (2, 2), (7, 3), (64, 64), (300, 9), (257, 256)], [(500, 500), (3, 1)], [(14 + n % 5, 6) for n in range(150)]])
@pytest.mark.parametrize("choices", ["few", None])
def test_both_forms_equal_sorting(spark, sizes, choices):
    rows = [r for n, (size, kinds) in enumerate(sizes) for r in history(f"C{n}", size, kinds, n + 1, choices)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    expected = by_sorting(rows)
    assert statistics.mean(expected.values()) not in (0, 1)
    got = above_prior_median(df, "customer", ["_us", "id"], F.col("category"), F.col("new"), "_amt")
    assert {(r.customer, r.probe): r.above for r in got.collect()} == expected
    key = {r[3]: (r[0], r[4]) for r in rows}
    chunked = above_prior_median_in_chunks(df, df.filter("new AND _amt IS NOT NULL").select("customer", "_row"), "customer", ["_us", "id"], "_row", "_amt", 7)
    assert {key[r["_row"]]: r.above for r in chunked.collect()} == expected


@pytest.mark.parametrize("kinds", [12, 30_000])
def test_a_customer_with_a_hundred_thousand_rows(spark, kinds):
    rows = history("hot", 100_000, kinds, 5) + history("other", 40, 5, 6)
    expected = by_sorting(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = above_prior_median(df, "customer", ["_us", "id"], F.col("category"), F.col("new"), "_amt")
    assert {(r.customer, r.probe): r.above for r in got.collect()} == expected
    key = {r[3]: (r[0], r[4]) for r in rows}
    chunked = above_prior_median_in_chunks(df, df.filter("new AND _amt IS NOT NULL").select("customer", "_row"), "customer", ["_us", "id"], "_row", "_amt")
    assert {key[r["_row"]]: r.above for r in chunked.collect()} == expected


def test_nothing_to_ask(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert above_prior_median(df, "customer", ["_us", "id"], F.col("category"), F.col("new"), "_amt").count() == 0


def test_the_rows_are_shuffled_once(spark):
    df = spark.createDataFrame(history("C", 30, 4, 1), SCHEMA)
    plan = above_prior_median(df, "customer", ["_us", "id"], F.col("category"), F.col("new"), "_amt")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(customer") in (1, 2) and plan.count("Exchange ") == plan.count("Exchange hashpartitioning(customer")


def test_the_rows_are_sorted_once(spark):
    df = spark.createDataFrame(history("C", 30, 4, 1), SCHEMA)
    plan = above_prior_median(df, "customer", ["_us", "id"], F.col("category"), F.col("new"), "_amt")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1


def test_nan_is_the_greatest_value(spark):
    nan = float("nan")
    amounts = [5.0, nan, nan, 9.0, nan, 1.0]                         # medians before: none, 5, nan, nan, nan, nan
    rows = [("C", i, str(i), i, f"k{i}", v, True) for i, v in enumerate(amounts)]
    got = above_prior_median(spark.createDataFrame(rows, SCHEMA), "customer", ["_us", "id"], F.col("category"), F.col("new"), "_amt")
    assert {r.probe: r.above for r in got.collect()} == {"k0": False, "k1": True, "k2": False, "k3": False, "k4": False, "k5": False}
