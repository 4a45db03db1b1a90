"""Operational tables: every step publishes the rows of all its tables at once and can be repeated.

Tables of a run are replaced by run and queue rows are inserted once. See `snapshots` for how a step is
published; a step that breaks off before that has changed nothing.
"""

from __future__ import annotations

import datetime as dt
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.cases import current_cases, deciding_updates
from riskloom.operators.scoring import DEFAULT_MIN_SUSPICIOUS, flagged_customers
from riskloom.session import materialize, materialize_counted
from riskloom.snapshots import Change, Part, SnapshotStore, State

RUN_KEYS = ["as_of", "model_version"]
# Columns of the operational tables.
SCHEMAS = {
    "customer_cluster": "as_of date, model_version string, customer_id string, cluster int",
    "behavior_anomalies": "as_of date, model_version string, customer_id string, cluster int, feature string, "
                          "value double, cluster_median double, cluster_p25 double, cluster_p75 double, "
                          "deviation_score double, is_suspicious boolean",
    "customer_anomaly": "as_of date, model_version string, customer_id string, cluster int, anomaly_score double, "
                        "n_features int, n_suspicious int, suspicious_features string",
    "scoring_runs": "run_id string, as_of date, model_version string, started_at timestamp_ntz, "
                    "finished_at timestamp_ntz, n_customers bigint, n_scored bigint, n_flagged bigint, "
                    "n_enqueued bigint, min_suspicious int, features string, status string",
    "anomaly_queue": "customer_id string, detected_at timestamp_ntz, model_name string, anomaly_score double",
    "queue_outcomes": "customer_id string, detected_at timestamp_ntz, model_name string, processed_at timestamp_ntz, "
                      "case_id string, result string",
    "fraud_cases": "case_id string, customer_id string, created_at timestamp_ntz, updated_at timestamp_ntz, "
                   "source string, transaction_ids string, max_score double, reasons string, contact_email string, "
                   "contact_whatsapp string, demo_mode boolean, status string, customer_comment string, "
                   "anomaly_score double",
    "case_transactions": "case_id string, transaction_id string, position bigint",
    "case_updates": "case_id string, at timestamp_ntz, status string, comment string",
    "escalations": "escalation_id string, case_id string, customer_id string, agent_id string, agent_name string, "
                   "language string, reason string, summary string, routing_score double, routing_reasons string, "
                   "created_at timestamp_ntz, status string",
}
RUN_TABLES = ("customer_cluster", "behavior_anomalies", "customer_anomaly")


# Parts of updates that are read one by one before they are compacted.
UPDATE_PARTS = 16


class Operations:
    """The operational tables below one folder. A step that writes several of them publishes them together."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, SnapshotStore(spark, root)

    def empty(self, table: str) -> DataFrame:
        return self.spark.createDataFrame([], SCHEMAS[table])

    def read(self, table: str, state: State | None = None) -> DataFrame:
        """The table in the newest state, or in the given one."""
        return self.store.read(table, SCHEMAS[table], state)

    def read_run(self, table: str, as_of: dt.date, version: str, state: State | None = None) -> DataFrame:
        """The rows of one run; the files of other runs are not opened."""
        return self.store.read(table, SCHEMAS[table], state, _run_key(as_of, version))

    def setup(self) -> None:
        """Publish a first state with every table empty, where there is none."""
        self.store.commit(lambda state: [] if state.number else [Change(t, self.part(t, self.empty(t))) for t in SCHEMAS])

    def part(self, table: str, rows: DataFrame, key: str | None = None) -> Part:
        """Write rows for a later commit."""
        return self.store.write_part(table, rows.select(*self.empty(table).columns), key)

    def run_part(self, table: str, rows: DataFrame, as_of: dt.date, version: str) -> Part:
        named = rows.withColumns({"as_of": F.lit(as_of), "model_version": F.lit(version)})
        return self.part(table, named, _run_key(as_of, version))

    def append(self, table: str, rows: DataFrame) -> None:
        part = self.part(table, rows)
        self.store.commit(lambda state: [Change(table, part)])

    def new_rows(self, table: str, rows: DataFrame, keys: list[str], state: State) -> list[Change]:
        """The change that adds the rows whose key the state does not have."""
        have = self.read(table, state).select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
        part = self.part(table, rows.join(have, same, "left_anti"))
        return [] if self.store.read(table, SCHEMAS[table], State(0, {table: (part,)})).isEmpty() else [Change(table, part)]

    def append_new(self, table: str, rows: DataFrame, keys: list[str]) -> None:
        """Append the rows whose key is not there yet, so that a broken-off step can be repeated."""
        self.store.commit(lambda state: self.new_rows(table, rows, keys, state))

    def current_cases(self, state: State | None = None) -> DataFrame:
        """The cases with every update applied."""
        state = state or self.store.state()
        return current_cases(self.read("fraud_cases", state), self.read("case_updates", state))

    def update_cases(self, updates: DataFrame) -> None:
        """Append updates (case_id, at, status, comment); a null status or comment leaves what was there."""
        self.append_new("case_updates", updates, ["case_id", "at", "status", "comment"])
        self.compact_updates()

    def compact_updates(self, parts: int = UPDATE_PARTS) -> None:
        """Where the updates have more parts than that, rewrite them as one with the rows that still decide something."""
        def prepare(state: State) -> list[Change]:
            held = state.parts("case_updates")
            if len(held) <= parts:
                return []
            merged = self.part("case_updates", deciding_updates(self.read("case_updates", state)))
            return [Change("case_updates", merged, tuple(p.folder for p in held))]
        self.store.commit(prepare)

    def replace_run(self, table: str, rows: DataFrame, as_of: dt.date, version: str) -> None:
        """Replace the rows of one run, also by none."""
        part = self.run_part(table, rows, as_of, version)
        self.store.commit(lambda state: [Change(table, part)])

    def enqueue_once(self, rows: DataFrame) -> int:
        """Append the customers that were never queued for this model and day; returns how many."""
        counted: list[int] = []

        def prepare(state: State) -> list[Change]:
            changes, count = self.queue_changes(rows, state)
            counted.append(count)
            return changes
        self.store.commit(prepare)
        return counted[-1]

    def queue_changes(self, rows: DataFrame, state: State) -> tuple[list[Change], int]:
        """What the queue of a state still lacks, and how many rows that is."""
        new, count = materialize_counted(not_yet_queued(rows, self.read("anomaly_queue", state)), "queue")
        return ([Change("anomaly_queue", self.part("anomaly_queue", new))] if count else []), count


def _run_key(as_of: dt.date, version: str) -> str:
    return f"{as_of.isoformat()}/{version}"


def not_yet_queued(rows: DataFrame, queue: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["customer_id", "model_name", "detected_at"]
    return rows.join(queue.select(*keys), keys, "left_anti")


def queue_rows(summary: DataFrame, as_of: dt.date, version: str, min_suspicious: int = DEFAULT_MIN_SUSPICIOUS) -> DataFrame:
    return flagged_customers(summary, min_suspicious).select(
        "customer_id", F.lit(as_of).cast("timestamp_ntz").alias("detected_at"), F.lit(version).alias("model_name"),
        "anomaly_score")


def now() -> dt.datetime:
    return dt.datetime.now().replace(microsecond=0)


def write_results(ops: Operations, result, min_suspicious: int = DEFAULT_MIN_SUSPICIOUS) -> dict:
    """Write a scoring result and queue its flagged customers, published together.

    Repeating a run never queues twice, also when two writers repeat it at once: the later one decides on the
    queue again from what the earlier one published.
    """
    as_of, version = result.as_of, result.model_version
    joined = result.summary.withColumn("suspicious_features", F.array_join("suspicious_features", ","))
    parts = {table: ops.run_part(table, rows, as_of, version) for table, rows in
             (("customer_cluster", result.clusters), ("behavior_anomalies", result.detail), ("customer_anomaly", joined))}
    queue, flagged = materialize_counted(queue_rows(result.summary, as_of, version, min_suspicious), "flagged")
    run = {
        "run_id": uuid.uuid4().hex[:12], "as_of": as_of, "model_version": version, "started_at": result.started_at,
        "n_customers": result.clusters.count(), "n_scored": result.summary.count(), "n_flagged": flagged,
        "min_suspicious": min_suspicious, "features": ",".join(result.metrics), "status": "ok",
    }
    names = ops.empty("scoring_runs").columns

    def prepare(state: State) -> list[Change]:
        queued, run["n_enqueued"] = ops.queue_changes(queue, state)
        run["finished_at"] = now()
        row = ops.spark.createDataFrame([tuple(run[n] for n in names)], SCHEMAS["scoring_runs"])
        return [*[Change(t, p) for t, p in parts.items()], *queued, Change("scoring_runs", ops.part("scoring_runs", row))]

    ops.store.commit(prepare)
    return run


def append_audit(path: str, records: DataFrame) -> None:
    """Append-only audit trail, one JSON object per line."""
    records.write.mode("append").option("ignoreNullFields", "false").json(path)


def audit_records(top: DataFrame, source: str, at: dt.datetime, demo_mode: bool) -> DataFrame:
    """One record per alerted customer with the transactions shown and their scores.

    `top` holds a few ranked rows per customer.
    """
    listed = top.groupBy("customer").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("_t"))
    return listed.select(
        F.lit(at.isoformat(timespec="seconds")).alias("timestamp"), F.lit(source).alias("source"),
        F.col("customer").alias("customer_id"), F.lit(demo_mode).alias("demo_mode"),
        F.transform("_t", lambda t: t["id"]).alias("transactions"), F.transform("_t", lambda t: t["score"]).alias("scores"))


def write_report(report: DataFrame, folder: str, name: str) -> None:
    """The long-form report as JSON lines and as Parquet."""
    report.write.mode("overwrite").json(f"{folder}/{name}.json")
    report.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
