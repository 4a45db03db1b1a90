"""Registered queries on small tables."""

import datetime as dt

from pyspark.sql import functions as F

from riskloom.plans.catalog import QUERIES
from riskloom.plans.catalog.clusters import same_scores


def test_position_of_a_pick_without_a_list(spark, tmp_path):
    """Customer 3 is asked for by a list of ids that end in 5, but has none: its pick is placed by time."""
    moment = dt.datetime(2024, 1, 2, 10)
    rows = [(e, moment + dt.timedelta(hours=e), user, "view", 10.0, "{}") for e, user in ((1, 3), (2, 3), (4, 3), (15, 13), (16, 13))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(
        str(tmp_path / "events.parquet"))
    found = {r["id"]: r["position"] for r in QUERIES["case_transactions_pick"](spark, str(tmp_path)).collect()}
    at = moment + dt.timedelta(hours=2)
    assert found == {"T000000000002": int((at - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000, "T000000000015": 1}


def test_scores_on_either_side_of_a_half_are_the_same(spark):
    """Added in another order a score may differ in its last bits, so that rounding gives two values."""
    score = "struct<cluster:int,anomaly_score:double,n_suspicious:int,suspicious_features:string>"
    near, far = 88.1234567885, 88.123457
    rows = [((1, near - 5e-14, 1, "x"), (1, near + 5e-14, 1, "x"), True), ((1, None, 0, ""), (1, None, 0, ""), True),
            ((1, None, 0, ""), (1, near, 0, ""), False), ((1, near, 1, "x"), (1, far, 1, "x"), False), ((1, near, 1, "x"), (2, near, 1, "x"), False)]
    found = spark.createDataFrame(rows, f"a {score}, b {score}, same boolean")
    assert found.filter(F.round("a.anomaly_score", 9) != F.round("b.anomaly_score", 9)).count() == 2
    assert found.filter(same_scores(F.col("a"), F.col("b")) != F.col("same")).count() == 0
    assert found.filter("same").count() == 2
