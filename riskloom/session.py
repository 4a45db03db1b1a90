"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_own_folders: dict[str, str] = {}


def build_session(app_name: str = "riskloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans expect; anything can be overridden by `conf`."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.ui.enabled": "false",
        # Recording the call site of every column expression takes longer than planning the queries.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        # Aggregates with small buffers per customer stay in the hash map instead of sorting.
        "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, else one beside the tables of the warehouse: both are
    places that every executor can reach. A local session removes what it put there when it ends."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/riskloom-scratch-{app}"
        if spark.sparkContext.master.startswith("local"):
            atexit.register(shutil.rmtree, urlparse(_own_folders[app]).path, ignore_errors=True)
    return _own_folders[app]


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query are removed when it ends, not whenever the driver collects its plan. For steps
    that are written (`materialize`): a plan that is run twice would be shuffled twice."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A handful of rows from the driver, at least one. They travel with the plan; a list given to `createDataFrame` is a
    Python RDD instead, which keeps a second set of Python workers beside those of the scans on every executor."""
    kinds = StructType.fromDDL(schema)
    return spark.createDataFrame(pa.table(dict(zip(kinds.names, map(list, zip(*rows))))), kinds)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Cuts the lineage so that several consumers do not recompute the input, and survives the loss
    of executors. The table is columnar, so each consumer still reads only its own columns.
    """
    path = os.path.join(shared_folder(df.sparkSession), "riskloom", f"{label}-{uuid.uuid4().hex}")
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_measured(df: DataFrame, label: str, **measures: Column) -> tuple[DataFrame, dict[str, int]]:
    """`materialize` that also returns aggregates of the rows, taken while they are written.

    The measures are observed in the tasks of the write itself, so they cost no pass of their own
    and count every row once, also when tasks are repeated.
    """
    seen = Observation()
    table = materialize(df.observe(seen, *[c.alias(n) for n, c in measures.items()]), label)
    return table, seen.get


def materialize_counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    table, seen = materialize_measured(df, label, rows=F.count(F.lit(1)))
    return table, seen["rows"]
