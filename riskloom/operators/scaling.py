"""Building blocks that stay exact when one key holds a large share of the rows.

Three situations need care: picking one or k rows per key, running values along an ordered group,
and exact quantiles of a group. Each has an ordinary form for groups that fit a task and a
distributed form for the groups that do not; both give the same result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import materialize

# A group with more rows than this is processed in chunks spread over the cluster.
MAX_GROUP_ROWS = 1_000_000
# A table with at most this many rows of keys and numbers (tens of MB) may be broadcast.
MAX_BROADCAST_ROWS = 500_000


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int = 1,
             rank: str | None = None) -> DataFrame:
    """The first k rows of each key.

    Spark turns `row_number() <= k` into a group limit that each map task applies before the
    shuffle, so a key with many copies sends at most k rows per task.
    """
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col(name) <= k)
    return kept if rank else kept.drop(name)


def latest_rows(df: DataFrame, keys: Sequence[str], newest_by: str,
                tiebreak: Sequence[Column] = ()) -> DataFrame:
    """Newest row per key; remaining ties are broken by the given columns."""
    return top_rows(df, keys, [F.col(newest_by).desc_nulls_last(), *tiebreak])


def oversized_groups(df: DataFrame, keys: Sequence[str], max_rows: int = MAX_GROUP_ROWS, rows: int | None = None
                     ) -> tuple[DataFrame | None, int]:
    """Keys with more than `max_rows` rows and how many there are; (None, 0) when there are none.

    One aggregation over the key columns only. The result has at most rows/max_rows entries. When
    the number of `rows` is known and within the limit, no group can exceed it and nothing is run.
    """
    if rows is not None and rows <= max_rows:
        return None, 0
    return measured_groups(df, keys, max_rows)[:2]


def measured_groups(df: DataFrame, keys: Sequence[str], max_rows: int = MAX_GROUP_ROWS) -> tuple[DataFrame | None, int, int]:
    """`oversized_groups` and, from the same aggregation, the number of all rows."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    large = F.col("_rows") > max_rows
    n, rows = counts.agg(F.count_if(large), F.coalesce(F.sum("_rows"), F.lit(0))).first()
    return (materialize(counts.filter(large), "oversized") if n else None), n, rows


def in_tasks_of(df: DataFrame, keys: Sequence[str], rows: int, rows_in_task: int) -> DataFrame:
    """Shuffled by the keys into as many partitions as the number of rows asks for. A number that is given is kept by
    adaptive execution, which would otherwise merge partitions until there are as many as cores."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // rows_in_task)), *keys)


def spread_rows(df: DataFrame, rows: int, rows_in_task: int) -> DataFrame:
    """The rows dealt evenly over tasks of about `rows_in_task`, whatever their keys. A scan gives a task a share of the
    files, however many rows that holds, and a sort before the shuffle would hold them all."""
    if rows <= rows_in_task:
        return df
    return in_tasks_of(df.withColumn("_nth", F.monotonically_increasing_id()), ["_nth"], rows, rows_in_task).drop("_nth")


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint when the known row count allows it; otherwise Spark shuffles the join."""
    return F.broadcast(df) if rows <= MAX_BROADCAST_ROWS else df


def left_join_many(left: DataFrame, right: DataFrame, key: str, sizes: DataFrame,
                   max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Left join of a table that is unique on `key` with one where a key may be very frequent.

    Adaptive execution can split a frequent key on either side of an inner join but not on the
    right side of a left join. When `sizes` (any frame with the keys of the right side) has such a
    key, the unmatched rows are therefore added by an anti join instead.
    """
    large, _ = oversized_groups(sizes, [key], max_group_rows)
    if large is None:
        return left.join(right, key, "left")
    matched = left.join(right, key, "inner")
    unmatched = left.join(right.select(key).distinct(), key, "left_anti")
    return matched.unionByName(unmatched, allowMissingColumns=True)


def _running(df: DataFrame, partition: Sequence[str], order: Sequence[Column],
             sums: Mapping[str, Column], lasts: Mapping[str, Column], prefix: str) -> DataFrame:
    before = (Window.partitionBy(*partition).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    columns = {f"{prefix}{name}": F.sum(value).over(before) for name, value in sums.items()}
    columns |= {f"{prefix}{name}": F.last(value, ignorenulls=True).over(before)
                for name, value in lasts.items()}
    return df.withColumns(columns)


def _no_null_sums(df: DataFrame, sums: Mapping[str, Column]) -> DataFrame:
    return df.withColumns({f"before_{n}": F.coalesce(F.col(f"before_{n}"), F.lit(0)) for n in sums})


def running_in_task(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                    sums: Mapping[str, Column], lasts: Mapping[str, Column] | None = None
                    ) -> DataFrame:
    """`before_<name>`: sum (or last non-null value) over the strictly earlier rows of the group."""
    return _no_null_sums(_running(df, keys, order, sums, lasts or {}, "before_"), sums)


def running_in_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                      sums: Mapping[str, Column], lasts: Mapping[str, Column] | None = None,
                      chunks: int | None = None) -> DataFrame:
    """Same result as `running_in_task` for groups of any size.

    The rows are range-partitioned on (keys, order), which cuts a large group into contiguous
    chunks of similar size. Each chunk is scanned on its own, and the totals of the earlier
    chunks of the group are added. The chunk number is written out, so a lost task recomputes
    against the same chunks.
    """
    lasts = lasts or {}
    by = [*[F.col(k) for k in keys], *order]
    ranged = df.repartitionByRange(chunks, *by) if chunks else df.repartitionByRange(*by)
    ranged = materialize(ranged.withColumn("_chunk", F.spark_partition_id()), "chunks")

    position = F.struct(*order)   # orders are ascending wherever a last value is asked for
    totals = ranged.groupBy(*keys, "_chunk").agg(
        *[F.sum(v).alias(f"_t_{n}") for n, v in sums.items()],
        *[F.max_by(v, F.when(v.isNotNull(), position)).alias(f"_t_{n}") for n, v in lasts.items()])
    # One row per (group, chunk): at most groups + chunks rows in all.
    carry = _running(totals, keys, [F.col("_chunk")],
                     {n: F.col(f"_t_{n}") for n in sums}, {n: F.col(f"_t_{n}") for n in lasts},
                     "_carry_").drop(*[f"_t_{n}" for n in [*sums, *lasts]])
    local = _running(ranged, [*keys, "_chunk"], order, sums, lasts, "_local_")
    joined = local.join(carry, [*keys, "_chunk"], "left")
    combined = {f"before_{n}": F.coalesce(F.col(f"_local_{n}"), F.lit(0))
                + F.coalesce(F.col(f"_carry_{n}"), F.lit(0)) for n in sums}
    combined |= {f"before_{n}": F.coalesce(F.col(f"_local_{n}"), F.col(f"_carry_{n}")) for n in lasts}
    return joined.withColumns(combined).drop(
        "_chunk", *[f"{p}{n}" for p in ("_local_", "_carry_") for n in [*sums, *lasts]])




def running_before(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                   sums: Mapping[str, Column], lasts: Mapping[str, Column] | None = None,
                   max_group_rows: int = MAX_GROUP_ROWS, rows: int | None = None) -> DataFrame:
    """Running values before each row, choosing the form by the size of the largest group.

    `df` should be cheap to read twice: unless few `rows` are known, its groups are counted first.
    """
    large, _ = oversized_groups(df, keys, max_group_rows, rows)
    form = running_in_task if large is None else running_in_chunks
    return form(df, keys, order, sums, lasts)


def quantiles_in_task(df: DataFrame, keys: Sequence[str], value: str,
                      probabilities: Mapping[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation; each group is merged in one task."""
    return df.groupBy(*keys).agg(
        *[F.percentile(value, F.lit(p)).alias(name) for name, p in probabilities.items()])


def quantiles_by_rank(df: DataFrame, keys: Sequence[str], value: str,
                      probabilities: Mapping[str, float]) -> DataFrame:
    """Exact quantiles of groups of any size, found by rank instead of collecting the values."""
    counts = (df.filter(F.col(value).isNotNull())
                .groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")))
    ranked = running_in_chunks(counts, keys, [F.col(value)], {"rank": F.col("_n")})
    totals = df.groupBy(*keys).agg(F.count(value).alias("_total"))
    placed = ranked.join(totals, list(keys))

    aggregates = []
    for name, p in probabilities.items():
        position = F.lit(p) * (F.col("_total") - 1)
        for side, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            covers = (F.col("before_rank") <= rank) & (rank < F.col("before_rank") + F.col("_n"))
            aggregates.append(F.max(F.when(covers, F.col(value))).alias(f"_{side}_{name}"))
    # Groups without any value keep a row of nulls, as in the other form.
    found = placed.groupBy(*keys, "_total").agg(*aggregates)
    result = totals.join(found.drop("_total"), list(keys), "left")
    columns = []
    for name, p in probabilities.items():
        position = F.lit(p) * (F.col("_total") - 1)
        lo, hi, at = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), position - F.floor(position)
        columns.append(F.when(lo == hi, lo).otherwise((1 - at) * lo + at * hi).alias(name))
    return result.select(*keys, *columns)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                    probabilities: Mapping[str, float], max_group_rows: int = MAX_GROUP_ROWS,
                    rows: int | None = None) -> DataFrame:
    """Exact quantiles per group; oversized groups go by rank, the others in a task.

    `df` should be cheap to read more than once.
    """
    large, n = oversized_groups(df, keys, max_group_rows, rows)
    if large is None:
        return quantiles_in_task(df, keys, value, probabilities)
    marker = small_side(large.select(*keys), n)
    ordinary = quantiles_in_task(df.join(marker, list(keys), "left_anti"), keys, value, probabilities)
    by_rank = quantiles_by_rank(df.join(marker, list(keys), "left_semi"), keys, value, probabilities)
    return ordinary.unionByName(by_rank)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
