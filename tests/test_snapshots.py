"""States of several tables: what readers see while a run is written, and two writers at once."""

import datetime as dt
import random
import threading

import pytest
from pyspark.sql import functions as F

from riskloom import sinks
from riskloom.operators import cases as K
from riskloom.plans.lifecycle import ScoringResult
from riskloom.snapshots import Change, CommitConflict, SnapshotStore

DAY = dt.date(2026, 6, 17)
TABLES = ["customer_cluster", "behavior_anomalies", "customer_anomaly", "anomaly_queue", "scoring_runs"]


def scoring(spark, customers, suspicious=5, day=DAY):
    rows = [(f"C{i}", i % 3) for i in range(customers)]
    clusters = spark.createDataFrame(rows, "customer_id string, cluster int")
    detail = clusters.select("customer_id", "cluster", F.lit("m").alias("feature"), *[F.lit(1.0).alias(c) for c in (
        "value", "cluster_median", "cluster_p25", "cluster_p75", "deviation_score")], F.lit(True).alias("is_suspicious"))
    summary = clusters.select("customer_id", "cluster", F.lit(4.0).alias("anomaly_score"), F.lit(5).alias("n_features"), F.lit(suspicious).alias("n_suspicious"),
                              F.array(F.lit("a"), F.lit("b")).alias("suspicious_features"))
    return ScoringResult(day, "clusters_1", clusters, detail, summary, ["m"])


def contents(ops):
    return {t: sorted(map(tuple, ops.read(t).collect()), key=repr) for t in TABLES}


@pytest.mark.parametrize("table", TABLES)
def test_a_run_that_breaks_off_after_any_table_is_not_seen(spark, tmp_path, monkeypatch, table):
    ops = sinks.Operations(spark, str(tmp_path / "ops"))
    sinks.write_results(ops, scoring(spark, 10))
    before = contents(ops)
    write = SnapshotStore.write_part

    def breaking(self, name, rows, key=None):
        part = write(self, name, rows, key)
        if name == table:
            raise RuntimeError("lost")
        assert contents(ops) == before          # a reader between two writes of the run
        return part
    monkeypatch.setattr(SnapshotStore, "write_part", breaking)
    with pytest.raises(RuntimeError):
        sinks.write_results(ops, scoring(spark, 25))
    monkeypatch.setattr(SnapshotStore, "write_part", write)
    assert contents(ops) == before
    assert sinks.write_results(ops, scoring(spark, 25))["n_enqueued"] == 15
    after = contents(ops)
    assert [len(after[t]) for t in TABLES] == [25, 25, 25, 25, 2]
    assert after["customer_anomaly"][0] == (DAY, "clusters_1", "C0", 0, 4.0, 5, 5, "a,b")


def test_two_interleaved_runs_queue_once(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "ops")
    first, second = sinks.Operations(spark, root), sinks.Operations(spark, root)
    publish, runs = SnapshotStore.publish, []

    def late(self, state):
        if not runs:                            # the other writer gets in between the decision and its publication
            runs.append(None)
            runs.append(sinks.write_results(second, scoring(spark, 12)))
        return publish(self, state)
    monkeypatch.setattr(SnapshotStore, "publish", late)
    run = sinks.write_results(first, scoring(spark, 20))
    assert runs[1]["n_enqueued"] == 12 and run["n_enqueued"] == 8
    queue = first.read("anomaly_queue")
    assert queue.count() == queue.select("customer_id").distinct().count() == 20
    assert first.store.numbers() == [1, 2] and first.read("scoring_runs").count() == 2
    assert first.read("customer_cluster").count() == 20 and first.read("customer_cluster", first.store.state(1)).count() == 12


def test_writers_in_threads_lose_nothing(spark, tmp_path):
    ops = sinks.Operations(spark, str(tmp_path / "ops"))
    rows = [spark.createDataFrame([(f"C{i}", dt.datetime(2026, 1, 1), "m", 1.0) for i in range(n, n + 6)], sinks.SCHEMAS["anomaly_queue"]) for n in range(4)]
    threads = [threading.Thread(target=ops.enqueue_once, args=(r,)) for r in rows]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(r.customer_id for r in ops.read("anomaly_queue").collect()) == [f"C{i}" for i in range(9)]


def test_numbers_are_created_once(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    state = store.state()
    part = store.write_part("t", spark.range(3))
    assert store.publish(state.after([Change("t", part)])) and not store.publish(state.after([Change("t", part)]))
    assert store.read("t", "id bigint").count() == 3 and store.read("other", "id bigint").count() == 0

    def never_first(held):
        other = SnapshotStore(spark, store.root)
        other.publish(held.after([Change("t", part)]))
        return [Change("t", part)]
    with pytest.raises(CommitConflict):
        store.commit(never_first)


def test_a_run_is_read_from_its_own_files(spark, tmp_path):
    ops = sinks.Operations(spark, str(tmp_path / "ops"))
    for n, day in enumerate((DAY, DAY + dt.timedelta(days=1), DAY)):
        ops.replace_run("customer_cluster", scoring(spark, 5 + n).clusters, day, "v")
    assert ops.read_run("customer_cluster", DAY, "v").count() == 7 and ops.read("customer_cluster").count() == 13
    assert len(ops.read_run("customer_cluster", DAY, "v").inputFiles()) < len(ops.read("customer_cluster").inputFiles())
    assert ops.store.expire(1) == 1 and ops.read("customer_cluster").count() == 13 and ops.store.numbers() == [3]


def test_compacted_updates_give_the_same_state_whatever_comes_later(spark, tmp_path):
    rng = random.Random(1)
    ops, rows = sinks.Operations(spark, str(tmp_path / "ops")), []
    schema = sinks.SCHEMAS["case_updates"]
    plain = lambda: sorted(map(tuple, K.case_status_fold(spark.createDataFrame(rows, schema)).collect()))       # noqa: E731
    for step in range(6):
        new = [(f"K{rng.randrange(4)}", dt.datetime(2026, 1, 1) + dt.timedelta(minutes=rng.randrange(500)), rng.choice([None, "closed", "verified"]),
                rng.choice([None, "uno", "dos"])) for _ in range(5)]
        rows += new
        ops.update_cases(spark.createDataFrame(new, schema))
        ops.compact_updates(parts=2)
        held = ops.read("case_updates")
        assert sorted(map(tuple, K.case_status_fold(held).collect())) == plain()
        assert len(ops.store.state().parts("case_updates")) <= 2
    assert ops.read("case_updates").count() <= 12 + 5 < len(rows)
