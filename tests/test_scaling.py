"""The distributed forms give the same results as the ordinary ones, also with a hot key."""

import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import scaling as S


@pytest.fixture(scope="module")
def rows(spark):
    """Key `a` holds two thirds of the rows; many rows share a position."""
    rng = random.Random(7)
    data = [("a" if i % 3 else rng.choice("bcdef"), rng.randrange(200), i, rng.choice([None, 1.0, 2.5, 7.0, -3.0]))
            for i in range(3000)]
    return spark.createDataFrame(data, "k string, at int, id int, v double").cache()


def collected(df):
    return sorted(tuple(r) for r in df.collect())


def test_running_values_in_chunks(rows):
    order = [F.col("at"), F.col("id")]
    sums, lasts = {"n": F.lit(1), "v": F.coalesce("v", F.lit(0.0))}, {"v2": F.col("v")}
    names = ["k", "at", "id", "before_n", "before_v", "before_v2"]
    plain = S.running_in_task(rows, ["k"], order, sums, lasts).select(*names)
    chunked = S.running_in_chunks(rows, ["k"], order, sums, lasts, chunks=13).select(*names)
    assert collected(plain.fillna(-99)) == collected(chunked.fillna(-99))


def test_chunk_count_is_more_than_one(rows, spark):
    ranged = rows.repartitionByRange(13, "k", "at", "id").select(F.spark_partition_id().alias("p"), "k").filter("k = 'a'")
    assert ranged.distinct().count() > 5          # the hot key is spread over chunks


@pytest.mark.parametrize("limit", [10, 1000, 10_000])
def test_quantiles_by_rank(rows, limit):
    probabilities = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q95": 0.95, "q1": 1.0}
    expected = S.quantiles_in_task(rows, ["k"], "v", probabilities)
    got = S.exact_quantiles(rows, ["k"], "v", probabilities, max_group_rows=limit)
    for a, b in zip(collected(expected), collected(got)):
        assert a[0] == b[0] and a[1:] == pytest.approx(b[1:])


def test_quantiles_of_nothing_are_null(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 2.0)], "k string, v double")
    got = {r["k"]: r["m"] for r in S.quantiles_by_rank(df, ["k"], "v", {"m": 0.5}).collect()}
    assert got == {"a": None, "b": 2.0}


def test_oversized_groups(rows):
    large, n = S.oversized_groups(rows, ["k"], 1500)
    assert n == 1 and [r["k"] for r in large.collect()] == ["a"]
    assert S.oversized_groups(rows, ["k"], 5000) == (None, 0)
    assert S.oversized_groups(rows, ["k"], 5000, rows=3000) == (None, 0)


@pytest.mark.parametrize("limit", [1, 1_000_000])
def test_left_join_many(spark, limit):
    left = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, x int")
    right = spark.createDataFrame([("a", 10), ("a", 11), ("b", 20), ("z", 9), (None, 0)], "k string, y int")
    got = S.left_join_many(left, right, "k", right.select("k"), limit).fillna(-1)
    assert collected(got.select("k", "x", "y")) == [("a", 1, 10), ("a", 1, 11), ("b", 2, 20), ("c", 3, -1)]


def test_row_limit_is_applied_before_the_shuffle(rows):
    plan = S.top_rows(rows, ["k"], [F.col("at").desc(), F.col("id")], 2)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_rows_are_spread_whatever_their_keys(spark):
    """One task and one key before; a scan task with many rows would sort them all before the shuffle by the key."""
    one = spark.range(2000, numPartitions=1).select(F.lit("a").alias("k"), "id")
    sizes = [r["count"] for r in S.spread_rows(one, 2000, 100).withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()]
    assert sum(sizes) == 2000 and len(sizes) == 20 and max(sizes) < 200
    assert S.spread_rows(one, 2000, 2000) is one
