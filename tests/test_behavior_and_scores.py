import datetime as dt
import math
import statistics

import pandas as pd
import pytest
from pyspark.sql import functions as F
from samples import AS_OF, frame, purchase_table

from riskloom.functions.numbers import recent_and_baseline
from riskloom.operators import behavior as B
from riskloom.operators import contracts as C
from riskloom.operators import scoring as S

BASELINE, RECENT = recent_and_baseline(AS_OF)


@pytest.fixture(scope="module")
def table(spark):
    rows = purchase_table(spark, {"A": 61, "B": 240, "D": 7.5}, RECENT.start, RECENT.days, 8)
    rows.loc[rows.index % 5 == 0, "amount_usd"] = None
    rows.loc[rows.index % 10 == 0, "currency"] = "COP"
    rows.loc[rows.index % 4 == 0, "transaction_type"] = "Transfer"
    rows.loc[rows.index % 7 == 0, "transaction_status"] = "Declined"
    return rows


def by_customer(df):
    return {r["customer_id"]: r.asDict() for r in df.collect()}


def test_metrics_of_a_customer(spark, table):
    got = by_customer(B.build_transaction_behavior(frame(spark, table), RECENT))["A"]
    own = table[table.customer_id == "A"]
    amount = own.amount_usd.fillna(own.amount.where(own.currency == "USD"))
    assert got["num_transacciones"] == len(own) and got["num_meses_activos"] == own.transaction_date.dt.month.nunique()
    assert got["num_dias_activos"] == own.transaction_date.dt.date.nunique()
    assert got["monto_total_usd"] == pytest.approx(amount.sum()) and got["monto_std_usd"] == pytest.approx(amount.std())
    assert got["monto_mediano_usd"] == pytest.approx(amount.median())
    assert got["monto_p95_usd"] == pytest.approx(amount.quantile(0.95))
    assert got["tasa_aprobacion"] == pytest.approx((own.transaction_status == "Approved").mean())
    assert got["porcentaje_amount_usd_faltante"] == pytest.approx(amount.isna().mean())
    assert got["porcentaje_fin_semana"] == pytest.approx((own.transaction_date.dt.dayofweek >= 5).mean())
    assert got["tipo_transaccion_dominante"] == own.transaction_type.mode()[0]
    assert got["transacciones_promedio_mes"] == len(own) / 2


def test_copies_and_rows_outside_do_not_change_the_metrics(spark, table):
    other = table.assign(transaction_id=table.transaction_id + "x", transaction_date=table.transaction_date - pd.Timedelta(days=60))
    df = frame(spark, table)
    extended = df.unionByName(df).unionByName(frame(spark, other))
    plain = by_customer(B.window_behavior(df, RECENT))
    assert by_customer(B.window_behavior(extended, RECENT)) == plain


def test_large_customers_take_the_other_path(spark, table):
    df = frame(spark, table)
    plain, by_rank = (by_customer(B.window_behavior(df, RECENT, limit)) for limit in (1_000_000, 22))
    assert set(plain) == set(by_rank)
    for customer, row in plain.items():
        for name, value in row.items():
            assert by_rank[customer][name] == (pytest.approx(value) if isinstance(value, float) else value), name


def test_invalid_transactions_leave(spark):
    rows = purchase_table(spark, {"A": 33, "B": 12}, RECENT.start, RECENT.days, 9)
    rows.loc[0, "transaction_status"] = "Desconocido"
    behavior = B.build_transaction_behavior(frame(spark, rows), RECENT)
    assert behavior.agg(F.sum("num_transacciones")).first()[0] == len(rows) - 1
    rows["transaction_status"] = "Desconocido"
    with pytest.raises(C.ContractError, match="transaction_status"):
        B.build_transaction_behavior(frame(spark, rows), RECENT)


def test_no_transactions_give_no_rows(spark, table):
    assert B.window_behavior(frame(spark, table).filter("false"), RECENT).count() == 0


def test_window_is_half_open(spark):
    times = [dt.datetime.combine(RECENT.start, dt.time()), dt.datetime.combine(RECENT.end, dt.time()) - dt.timedelta(microseconds=1),
             dt.datetime.combine(RECENT.end, dt.time()), dt.datetime.combine(RECENT.start, dt.time()) - dt.timedelta(microseconds=1)]
    df = spark.createDataFrame([(t,) for t in times], "transaction_date timestamp_ntz")
    assert B.select_window(df, RECENT).count() == 2
    assert B.select_window(spark.createDataFrame([("2026-06-01",), ("nada",)], "transaction_date string"), RECENT).count() == 1


def test_monthly_scale(spark):
    df = spark.createDataFrame([("A", 36)], "customer_id string, num_transacciones bigint")
    assert B.normalize_period(df, 360).first()["num_transacciones_monthly"] == 3.0


@pytest.mark.parametrize("value, median, mad, p25, p75, expected", [
    (13.0, 10.0, 2.0, 9.0, 11.0, 3 / (1.4826 * 2)), (14.0, 10.0, 0.0, 9.0, 11.0, 4 / (2 / 1.349)),
    (10.0, 10.0, 0.0, 10.0, 10.0, 0.0), (10.1, 10.0, 0.0, 10.0, 10.0, math.inf), (None, 10.0, 1.0, 9.0, 11.0, None)])
def test_robust_deviation(spark, value, median, mad, p25, p75, expected):
    df = spark.createDataFrame([(value, median, mad, p25, p75)], "v double, m double, d double, a double, b double")
    got = df.select(S.robust_deviation(*map(F.col, "vmdab")).alias("r")).first()["r"]
    assert got is None if expected is None else got == pytest.approx(expected)


@pytest.mark.parametrize("limit", [1_000_000, 5])
def test_profiles(spark, limit):
    values = [1.0, 2.0, 4.0, 8.0, 100.0, None, 3.0, 5.0]
    behavior = spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "customer_id string, x double")
    clusters = spark.createDataFrame([(str(i), 0) for i in range(20)], "customer_id string, cluster int")
    row = S.cluster_profiles(behavior, clusters, ["x"], limit).first()
    present = [v for v in values if v is not None]
    median = statistics.median(present)
    assert row["count"] == 7 and row["median"] == median and row["mean"] == pytest.approx(statistics.fmean(present))
    assert row["mad"] == statistics.median(abs(v - median) for v in present)
    assert row["p25"] == pytest.approx(pd.Series(present).quantile(0.25)) and row["p95"] == pytest.approx(pd.Series(present).quantile(0.95))


def test_detail_and_summary(spark):
    profiles = spark.createDataFrame([(0, f, 9, 1.0, 10.0, 9.0, 11.0, 12.0, m) for f, m in (("x", 1.0), ("y", 0.0), ("z", 1.0))],
                                     "cluster int, feature string, count bigint, mean double, median double, p25 double, p75 double, p95 double, mad double")
    behavior = spark.createDataFrame([("A", 30.0, 10.0, None), ("B", 10.0, 10.0, 10.0), ("Q", 1.0, 1.0, 1.0)],
                                     "customer_id string, x double, y double, z double")
    clusters = spark.createDataFrame([("A", 0), ("B", 0), ("Q", 7)], "customer_id string, cluster int")
    detail, summary = S.score_customers(behavior, clusters, profiles, ["x", "y", "z", "unknown"])
    got = {r["customer_id"]: r for r in summary.collect()}
    assert set(got) == {"A", "B"} and detail.count() == 6
    assert (got["A"]["n_features"], got["A"]["n_suspicious"], got["A"]["suspicious_features"]) == (3, 1, ["x"])
    assert got["A"]["anomaly_score"] == pytest.approx((20 / 1.4826 + 0) / 2)
    assert S.flagged_customers(summary, 1).first()["anomaly_score"] == pytest.approx(1 / 3)


def test_damaged_profiles_are_refused(spark):
    profiles = spark.createDataFrame([(0, "x", 9, 1.0, 1.0, 2.0, 1.0, 3.0, 0.5)],
                                     "cluster int, feature string, count bigint, mean double, median double, p25 double, p75 double, p95 double, mad double")
    nobody = spark.createDataFrame([], "customer_id string, x double")
    with pytest.raises(C.ContractError, match="p25 > p75"):
        S.score_customers(nobody, spark.createDataFrame([], "customer_id string, cluster int"), profiles, ["x"])


def test_profiles_are_worked_out_once_for_all_windows(spark, monkeypatch):
    from riskloom.plans.catalog import evaluation as E
    asked = []
    one = spark.createDataFrame([("a", 1)], "customer_id string, n int")
    monkeypatch.setattr(E, "profiles", lambda t: asked.append(t) or one)
    monkeypatch.setattr(E, "recent_behavior", lambda t, window: one)
    monkeypatch.setattr(E.S, "score_customers", lambda behavior, clusters, usual, metrics: (one, one))
    monkeypatch.setattr(E.V, "window_labels", lambda transactions, window: one)
    monkeypatch.setattr(E.V, "evaluation_data", lambda found, labels, name: one.withColumn("window", F.lit(name)))
    rows = E.evaluated_windows(type("Tables", (), {"clusters": one, "transactions": one})())
    assert len(asked) == 1 and rows.count() == 2


def test_rows_of_a_customer_meet_before_their_sets_are_built(spark):
    """Sets and quantiles of a customer are never shuffled."""
    schema = ("transaction_id string, transaction_date timestamp_ntz, product_id string, customer_id string, transaction_type string, amount double, "
              "currency string, amount_usd double, transaction_country string, transaction_city string, transaction_status string")
    plan = B.behavior_metrics(spark.createDataFrame([], schema), 1, rows=0)._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("partial_collect_set")]
    assert "Exchange" not in above[above.index("collect_set"):]
