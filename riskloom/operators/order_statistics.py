"""Order statistics of a growing history: which new values lie above the median of all values before.

A group's rows come in time order; some of them are probes (here: the first transaction of a
category). Whether a probe's value exceeds the median of the earlier values follows from how many of these are
smaller and, where an even number of them is split in half, from the two values next to the probe.

Groups that fit a task are sorted once, by time. A pass over the sorted rows keeps the values of the current
group in order, so that a probe finds its place and the two values in the middle at once.

Larger groups are counted by merging, not per probe. Rows are first compressed to ranks among the probes: `s`, the
probes up to the row in time, and `v`, the probes up to the row in value. Rows that agree in both are one cell with a
count, a least and a greatest value. The cells before probe j are those with s < j: as many dyadic blocks
of s as j has one bits. Each cell stands in its block of every level, each probe asks the blocks it
needs, and inside a block one running sum in the order of value answers all of its probes. So n rows and m
probes cost two sorts of n rows and log m times the cells, whatever the shares of a group are.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.scaling import running_before, running_in_chunks
from riskloom.session import materialize

# Levels of dyadic blocks: those that a cell stands in and some probe asks, and those that a probe asks.
STANDS_IN = ("filter(sequence(0, cast(log2(greatest(m, 1)) AS INT)), "
             "b -> shiftright(s, b) % 2 = 0 AND shiftleft(shiftright(s, b) + 1, b) <= m)")
ASKS = "filter(sequence(0, cast(log2(s) AS INT)), b -> shiftright(s, b) % 2 = 1)"
Running = Callable[..., DataFrame]


def _answers(cells: DataFrame, probes: DataFrame, group: str, running: Running) -> DataFrame:
    """(group, probe, above) from cells (group, m, s, v, n, low, high) and probes (group, s, v, probe, value)."""
    held = cells.select(group, F.explode(F.expr(STANDS_IN)).alias("level"), "s", "v", "n", "low", "high").select(
        group, "level", F.expr("shiftright(s, level)").alias("block"), "v", F.lit(1).alias("kind"), "n", "low", "high")
    asked = probes.select(group, F.explode(F.expr(ASKS)).alias("level"), "s", "v", "probe", "value").select(
        group, "level", F.expr("shiftright(s, level) - 1").alias("block"), "v", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("n"),
        "probe", "value")
    both = held.unionByName(asked, allowMissingColumns=True)
    keys = [group, "level", "block"]
    # A probe comes before the cells of its own rank, which hold no smaller value; cells of one rank go by value.
    up = running(both, keys, [F.col("v"), F.col("kind"), F.col("high")], {"below": F.col("n")}, {"high": F.col("high")})
    down = running(up.withColumnsRenamed({"before_below": "below", "before_high": "lower"}), keys, [-F.col("v"), 1 - F.col("kind"), -F.col("low")],
                   {"rest": F.col("n")}, {"low": F.col("low")})
    found = down.filter("kind = 0").groupBy(group, "probe").agg(
        F.first("value").alias("value"), F.sum("below").alias("below"), F.sum("before_rest").alias("rest"), F.max("lower").alias("lower"),
        F.min("before_low").alias("upper"))
    n = F.col("below") + F.col("rest")
    half = F.floor(n / 2)
    split = (n % 2 == 0) & (F.col("below") == half)
    above = F.when(n == 0, False).when(split, F.col("value") > (F.col("lower") + F.col("upper")) / 2).otherwise(F.col("below") > half)
    return found.select(group, "probe", above.alias("above"))


def _cells(ranked: DataFrame, group: str) -> DataFrame:
    return ranked.groupBy(group, "m", "s", "v").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


class _Earlier:
    """The earlier values of one group in order. NaN counts as the greatest value, as in Spark, and stands apart."""

    def __init__(self) -> None:
        self.values: list[float] = []
        self.nans = 0

    def add(self, value: float) -> None:
        if math.isnan(value):
            self.nans += 1
        else:
            insort(self.values, value)

    def _at(self, place: int) -> float:
        return self.values[place] if place < len(self.values) else math.nan

    def median_is_below(self, value: float) -> bool:
        n = len(self.values) + self.nans
        if n == 0:
            return False
        below, half = len(self.values) if math.isnan(value) else bisect_left(self.values, value), n // 2
        if n % 2 == 0 and below == half:
            return value > (self._at(half - 1) + self._at(half)) / 2
        return below > half


def _probes_above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, probe, above) from rows (group, probe, value, new, nth) that come group by group, numbered in time order."""
    earlier = _Earlier()
    for batch in batches:
        at, found = [], []
        for i, (value, new, nth) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("value", "new", "nth")])):
            if nth == 1:
                earlier = _Earlier()
            if new:
                at.append(i)
                found.append(earlier.median_is_below(value))
            earlier.add(value)
        asked = batch.select([0, 1]).take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([*asked.columns, pa.array(found, pa.bool_())], [*asked.schema.names, "above"])


def above_prior_median(rows: DataFrame, group: str, order: list[str], probe: Column, is_probe: Column, value: str) -> DataFrame:
    """(group, probe, above) for the probes of groups that fit a task.

    `probe` names a probe within its group. Only rows with a value count, as probes too. The rows are shuffled by the
    group and sorted once; numbering them in time order makes Spark bring them that way.
    """
    known = rows.select(group, probe.alias("probe"), F.col(value).cast("double").alias("value"), is_probe.alias("new"), *order).filter("value IS NOT NULL")
    nth = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    numbered = known.withColumn("nth", nth).select(group, "probe", "value", "new", "nth")
    asked = numbered.select(group, "probe").schema
    return numbered.mapInArrow(_probes_above, asked.add("above", "boolean"))


def above_prior_median_in_chunks(rows: DataFrame, probes: DataFrame, group: str, order: list[str], row: str, value: str,
                                 chunks: int | None = None) -> DataFrame:
    """(row, above) for groups of any size.

    `probes` holds the rows (group, row) that ask; rows are told apart by `row`, which closes the order. Ranks
    come from running counts over range-partitioned chunks. `rows` should be cheap to read several times.
    """
    marked = probes.select(F.col(row).alias("probe"), F.lit(1).alias("new"))
    counts = probes.groupBy(group).agg(F.count(F.lit(1)).alias("m"))
    known = rows.filter(F.col(value).isNotNull()).select(group, *order, row, F.col(value).alias("value"))
    known = known.join(marked, F.col(row) == F.col("probe"), "left").withColumn("new", F.coalesce("new", F.lit(0)))
    timed = running_in_chunks(known, [group], [F.col(c) for c in [*order, row]], {"s": F.col("new")}, chunks=chunks)
    timed = materialize(timed.select(group, row, "value", "new", (F.col("before_s") + F.col("new")).alias("s")), "time-ranks")
    # In the order of value the probes stand before all rows of their value.
    events = timed.withColumn("kind", F.lit(1)).unionByName(timed.filter("new = 1").withColumn("kind", F.lit(0)))
    placed = running_in_chunks(events, [group], [F.col("value"), F.col("kind"), F.col(row)], {"v": F.when(F.col("kind") == 0, 1).otherwise(0)},
                               chunks=chunks)
    placed = materialize(placed.join(counts, group), "value-ranks")
    cells = _cells(placed.filter("kind = 1").withColumn("v", F.col("before_v")), group)
    asking = placed.filter("kind = 0").select(group, "s", (F.col("before_v") + 1).alias("v"), F.col(row).alias("probe"), "value")
    # The cells are written because their number decides on the form of the running sums.
    found = _answers(materialize(cells, "cells"), asking, group, running_before)
    return found.select(F.col("probe").alias(row), "above")
