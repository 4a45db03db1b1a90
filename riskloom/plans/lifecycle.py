"""Training, scoring, casework and evaluation from table to table."""

from __future__ import annotations

import datetime as dt
import json
import platform
import uuid
import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field

import pyspark
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import sinks
from riskloom.functions.numbers import as_date, history_window, recent_and_baseline
from riskloom.operators import cases as casework
from riskloom.operators import clustering, evaluation, routing, rules, scoring
from riskloom.operators.analysis import DEFAULT_DAYS, analyze_window
from riskloom.operators.behavior import profile_metrics, window_behavior
from riskloom.operators.contracts import CLUSTER_PROFILES, validate
from riskloom.operators.currency import require_usd_rates
from riskloom.operators.features import build_customer_features
from riskloom.operators.fingerprints import fingerprint
from riskloom.operators.scaling import union_all
from riskloom.session import materialize
from riskloom.snapshots import Change, Part, SnapshotStore, State
from riskloom.sources.files import currency_frames
from riskloom.sources.logical import latest_profiles
from riskloom.sources.tables import customers_with_products, transactions_in_window

RECENT_DAYS = 30
MODEL_PARTS = ("pipeline", "profiles", "activity", "metadata")


class VersionError(RuntimeError):
    """The model was saved with another version of the library."""


@dataclass
class BankInputs:
    """The input tables; countries and rates default to the fixed ones."""

    customers: DataFrame
    products: DataFrame
    transactions: DataFrame
    countries: DataFrame | None = None
    rates: DataFrame | None = None

    def __post_init__(self) -> None:
        countries, rates = currency_frames(self.customers.sparkSession)
        self.countries = countries if self.countries is None else self.countries
        self.rates = rates if self.rates is None else self.rates

    def features(self, as_of: dt.date) -> DataFrame:
        return build_customer_features(customers_with_products(self.customers, self.products), as_of, self.countries,
                                       self.rates)


@dataclass
class TrainedModel:
    pipeline: PipelineModel
    profiles: DataFrame
    activity: DataFrame
    metadata: dict


@dataclass
class ScoringResult:
    as_of: dt.date
    model_version: str
    clusters: DataFrame
    detail: DataFrame
    summary: DataFrame
    metrics: list[str]
    started_at: dt.datetime = field(default_factory=sinks.now)


def model_version(as_of: dt.date | str) -> str:
    return f"clusters_{as_date(as_of):%Y%m%d}"


def train(inputs: BankInputs, as_of: dt.date | str, components: int = clustering.N_COMPONENTS,
          clusters: int = clustering.N_CLUSTERS, seed: int = clustering.SEED, months: int = 12,
          starts: int = clustering.N_STARTS) -> TrainedModel:
    """Fit the clusters and their profiles with data up to `as_of` only."""
    as_of = as_date(as_of)
    require_usd_rates(inputs.rates)
    features = inputs.features(as_of)
    pipeline = clustering.fit_customer_clusters(features, components, clusters, seed, starts, checked=True)
    assigned = materialize(clustering.assign_clusters(pipeline, features, checked=True), "clusters")

    window = history_window(as_of, months)
    transactions = transactions_in_window(inputs.transactions, window, assigned)
    behavior = window_behavior(transactions, window, unique=True)
    metrics = profile_metrics(behavior.columns)
    profiles = scoring.cluster_profiles(behavior, assigned, metrics)
    activity = clustering.cluster_activity(assigned, behavior)
    sizes = {str(r["cluster"]): r["count"] for r in assigned.groupBy("cluster").count().orderBy("cluster").collect()}
    rates = {r["currency"]: r["usd_rate"] for r in inputs.rates.collect()}
    metadata = {
        "model_version": model_version(as_of), "as_of": as_of.isoformat(),
        "profile_window": {"start": window.start.isoformat(), "end_inclusive": window.last_day.isoformat()},
        "recent_window_days": RECENT_DAYS, "n_customers": features.count(), "n_customers_with_activity": behavior.count(),
        "n_transactions": behavior.agg(F.coalesce(F.sum("num_transacciones"), F.lit(0))).first()[0],
        "cluster_sizes": sizes, "n_clusters": clusters, "n_pca_components": components, "random_state": seed,
        "pca_explained_variance": round(clustering.explained_variance(pipeline), 4), "profile_features": metrics,
        "usd_rates": rates,
        "data_fingerprint": {"customer_features": fingerprint(features).first()[0],
                             "behavior": fingerprint(behavior).first()[0]},
        "versions": {"python": platform.python_version(), "pyspark": pyspark.__version__},
    }
    return TrainedModel(pipeline, profiles, activity, metadata)


def save_model(model: TrainedModel, models_dir: str) -> str:
    """Write pipeline, profiles, activity and metadata below a folder named after the version, published together.

    Training a version again writes fresh folders, so a reader never mixes the parts of two trainings.
    """
    folder = f"{models_dir}/{model.metadata['model_version']}"
    spark = model.profiles.sparkSession
    store = SnapshotStore(spark, folder)
    text = spark.createDataFrame([(json.dumps(model.metadata, ensure_ascii=False),)], "value string")
    parts = {"profiles": store.write_part("profiles", model.profiles, "model"), "activity": store.write_part("activity", model.activity, "model"),
             "metadata": store.write_part("metadata", text, "model"), "pipeline": Part(f"pipeline/{uuid.uuid4().hex}", "model")}
    model.pipeline.save(f"{folder}/{parts['pipeline'].folder}")
    store.commit(lambda state: [Change(name, part) for name, part in parts.items()])
    return folder


def load_model(spark: SparkSession, folder: str) -> TrainedModel:
    """Read a saved model; one from another minor version of the library is refused."""
    state = SnapshotStore(spark, folder).state()
    paths = {name: f"{folder}/{p.folder}" for name in MODEL_PARTS for p in state.parts(name)}
    missing = sorted(set(MODEL_PARTS) - set(paths))
    if missing:
        raise FileNotFoundError(f"{folder} has no {', '.join(missing)}")
    metadata = json.loads(spark.read.parquet(paths["metadata"]).first()["value"])
    saved = metadata["versions"]["pyspark"]
    if saved.split(".")[:2] != pyspark.__version__.split(".")[:2]:
        raise VersionError(f"{folder} was saved with pyspark {saved}, this is {pyspark.__version__}: train again")
    profiles, _ = validate(spark.read.parquet(paths["profiles"]), CLUSTER_PROFILES)
    return TrainedModel(PipelineModel.load(paths["pipeline"]), profiles, spark.read.parquet(paths["activity"]), metadata)


def latest_model_folder(spark: SparkSession, models_dir: str) -> str:
    """The saved model with the highest version name; folders without a published model do not count."""
    found = [n for n in SnapshotStore(spark, models_dir).folders() if n.startswith("clusters_") and SnapshotStore(spark, f"{models_dir}/{n}").numbers()]
    if not found:
        raise FileNotFoundError(f"no model in {models_dir}")
    return f"{models_dir}/{max(found)}"


def score_as_of(inputs: BankInputs, model: TrainedModel, as_of: dt.date | str,
                metrics: Sequence[str] = tuple(scoring.SCORED_METRICS), recent_days: int = RECENT_DAYS) -> ScoringResult:
    """Score the days that end on `as_of`. Nothing is written to the operational tables."""
    as_of, started = as_date(as_of), sinks.now()
    if inside_training(model, as_of):
        warnings.warn(f"the scored window ends on {as_of}, inside the training data of {model.metadata['model_version']}: "
                      "its customers shaped the profiles they are compared with", stacklevel=2)
    wanted = model.profiles.sparkSession.createDataFrame([(m,) for m in metrics], "feature string")
    missing = sorted(r["feature"] for r in wanted.join(model.profiles, "feature", "left_anti").distinct().collect())
    if missing:
        raise KeyError(f"the model {model.metadata['model_version']} has no profile for {missing}")
    features = inputs.features(as_of)
    clusters = materialize(clustering.assign_clusters(model.pipeline, features, checked=True), "clusters")
    _, recent = recent_and_baseline(as_of, recent_days=recent_days)
    behavior = window_behavior(transactions_in_window(inputs.transactions, recent, clusters), recent, unique=True)
    detail, summary = scoring.score_customers(behavior, clusters, model.profiles, metrics)
    return ScoringResult(as_of, model.metadata["model_version"], clusters, detail, summary, list(metrics), started)


def inside_training(model: TrainedModel, as_of: dt.date | str) -> bool:
    """True when the scored window belongs to the training data."""
    return as_date(as_of) <= as_date(model.metadata["as_of"])


def process_queue(ops: sinks.Operations, transactions: DataFrame, customers: DataFrame, opened: dt.date | str,
                  days: int = DEFAULT_DAYS, limit: int | None = casework.QUEUE_LIMIT, contact_map: DataFrame | None = None,
                  settings: rules.RuleSettings = rules.DEFAULTS) -> DataFrame:
    """Open cases for pending customers and append the outcome of each queue row; `limit` None takes all of them.

    A second worker of the same customers finds their rows done and adds nothing.
    """
    state = ops.store.state()
    queue = casework.queue_state(ops.read("anomaly_queue", state), ops.read("queue_outcomes", state))
    requested = materialize(casework.pending_queue(queue, limit).select(
        "customer_id", F.lit("anomaly_model").alias("source"), "anomaly_score",
        F.lit(None).cast("string").alias("transaction_ids")), "requests")
    return _work_off(ops, requested, transactions, customers, opened, days, contact_map, settings)


def _work_off(ops: sinks.Operations, requested: DataFrame, transactions: DataFrame, customers: DataFrame, opened: dt.date | str,
              days: int, contact_map: DataFrame | None, settings: rules.RuleSettings, queued: bool = True) -> DataFrame:
    """Open the requested cases; links, cases and outcomes are published together. Returns the outcomes, or the new cases
    where the customers did not come from the queue."""
    chosen = requested.select(F.col("customer_id").alias("customer"))
    scored = materialize(rules.score_transactions(transactions, settings, chosen), "scored")
    contacts = casework.contact_resolution(latest_profiles(customers.join(requested, "customer_id", "left_semi")), contact_map)
    window = analyze_window(scored, days)
    result: list[DataFrame] = []

    def prepare(now: State) -> list[Change]:
        existing = materialize(ops.current_cases(now), "existing-cases")
        cases, links = casework.open_cases(requested, scored, window, contacts, existing, opened, contact_map is not None, settings)
        cases = materialize(cases, "cases")
        changes = ops.new_rows("case_transactions", links, ["case_id", "transaction_id"], now) + ops.new_rows("fraud_cases", cases, ["case_id"], now)
        result.append(cases)
        if queued:
            queue = casework.queue_state(ops.read("anomaly_queue", now), ops.read("queue_outcomes", now))
            outcomes = casework.queue_outcomes(queue, requested, cases, existing, F.lit(sinks.now()).cast("timestamp_ntz"))
            result.append(materialize(outcomes, "outcomes"))
            changes += [] if result[-1].isEmpty() else [Change("queue_outcomes", ops.part("queue_outcomes", result[-1]))]
        return changes

    ops.store.commit(prepare)
    return result[-1]


def open_listed_cases(ops: sinks.Operations, listed: DataFrame, transactions: DataFrame, customers: DataFrame, opened: dt.date | str,
                      days: int = DEFAULT_DAYS, contact_map: DataFrame | None = None, settings: rules.RuleSettings = rules.DEFAULTS
                      ) -> DataFrame:
    """Cases for the customers of a file (customer_id, anomaly_score); returns the new ones."""
    requested = materialize(listed.groupBy("customer_id").agg(F.max("anomaly_score").alias("anomaly_score")).select(
        "customer_id", F.lit("anomaly_model").alias("source"), "anomaly_score", F.lit(None).cast("string").alias("transaction_ids")), "requests")
    return _work_off(ops, requested, transactions, customers, opened, days, contact_map, settings, queued=False)


def escalate_cases(ops: sinks.Operations, cases: DataFrame, agents: DataFrame, at: dt.datetime) -> DataFrame:
    """Hand cases (case_id, customer_id, language, accent, country, hour, reason, summary) to the best agent.

    The escalation, under an id that follows from the case, and the new status are published together; a
    repeated call adds neither a second time.
    """
    rows = materialize(routing.escalations(cases, agents, F.lit(at).cast("timestamp_ntz")), "escalations")

    def prepare(now: State) -> list[Change]:
        open_cases = ops.current_cases(now).filter(F.col("status") != "escalated").select("case_id")
        updates = rows.join(open_cases, "case_id", "left_semi").select(
            "case_id", F.lit(at).cast("timestamp_ntz").alias("at"), F.lit("escalated").alias("status"), F.lit(None).cast("string").alias("comment"))
        return ops.new_rows("escalations", rows, ["escalation_id"], now) + ops.new_rows(
            "case_updates", updates, ["case_id", "at", "status", "comment"], now)

    ops.store.commit(prepare)
    return rows


def evaluate_window(inputs: BankInputs, model: TrainedModel, as_of: dt.date | str, seed: int = 42, recent_days: int = RECENT_DAYS) -> DataFrame:
    """One row per customer of a held-out window. A window inside the training data is refused."""
    as_of = as_date(as_of)
    if inside_training(model, as_of):
        raise ValueError(f"the window ends on {as_of}, not after the training data ({model.metadata['as_of']})")
    _, window = recent_and_baseline(as_of, recent_days=recent_days)
    result = score_as_of(inputs, model, as_of, recent_days=recent_days)
    labels = evaluation.window_labels(inputs.transactions, window)
    return materialize(evaluation.evaluation_data(result.summary, labels, as_of.isoformat(), seed), "evaluation")


def report_header(model: TrainedModel, eval_as_of: Sequence[dt.date | str], recent_days: int = RECENT_DAYS) -> DataFrame:
    """(window, window_start, window_end_inclusive, model_version, train_as_of), one row per evaluated window."""
    rows = []
    for day in map(as_date, eval_as_of):
        _, window = recent_and_baseline(day, recent_days=recent_days)
        rows.append((day.isoformat(), window.start, window.last_day, model.metadata["model_version"], model.metadata["as_of"]))
    return model.profiles.sparkSession.createDataFrame(
        rows, "window string, window_start date, window_end_inclusive date, model_version string, train_as_of string")


def evaluate(inputs: BankInputs, model: TrainedModel, eval_as_of: Sequence[dt.date | str], rules_negatives: int | None = 0, seed: int = 42,
             recent_days: int = RECENT_DAYS, settings: rules.RuleSettings = rules.DEFAULTS) -> DataFrame:
    """Report rows of every window and of all windows together; `report_header` has the bounds and the model.

    `rules_negatives` = 0 leaves the rules out; None evaluates them on every customer. Their rows come with the sizes of
    the sample, per window and pooled.
    """
    windows = {as_date(d): evaluate_window(inputs, model, d, seed, recent_days) for d in eval_as_of}
    data = union_all(list(windows.values()))
    parts = [evaluation.report_rows(data), evaluation.report_rows(evaluation.pooled(data), with_random=False)]
    if rules_negatives != 0:
        samples = []
        for day, frame in windows.items():
            _, window = recent_and_baseline(day, recent_days=recent_days)
            sample = materialize(evaluation.weighted_sample(frame, rules_negatives, seed), "rules-sample")
            scored = rules.score_transactions(inputs.transactions, settings, sample.select(F.col("customer_id").alias("customer")))
            samples.append(materialize(sample.join(evaluation.rules_scores(sample, scored, window), "customer_id"), "rules-baseline"))
        sampled = union_all(samples)
        for rows in (sampled, evaluation.pooled(sampled)):
            parts += [evaluation.long_rows(evaluation.ranking_metrics(rows, "rule_score", "weight"), "rules", ["average_precision", "roc_auc"]),
                      evaluation.long_rows(evaluation.at_thresholds(rows, "rule_score", evaluation.RULE_THRESHOLDS, "weight"), "rules",
                                           evaluation.FLAG_METRICS, "threshold"), evaluation.sample_rows(rows)]
    return union_all([p.select(*evaluation.REPORT_COLUMNS) for p in parts])
