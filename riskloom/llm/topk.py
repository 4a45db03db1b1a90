"""Exact nearest customers by integer inner product, by distributed histogram selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import materialize

BINS = 32
QUERY_BLOCK = 2048
EXACT = 1 << 53       # products of whole numbers below this are exact in doubles


def _vectors(batch: pa.RecordBatch) -> list[np.ndarray]:
    """floor(256 x) of each vector; those that are null or hold null or non-finite parts are empty."""
    found = []
    for values in batch["features"].to_pylist():
        x = np.array([np.nan if v is None else v for v in values or ()], np.float64)
        found.append(np.floor(256 * x) if len(x) and np.isfinite(x).all() else np.empty(0))
    return found


def _fast_vectors(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their whole-number vectors padded or cut to the width)."""
    column = batch["features"]
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if column.null_count == 0 and len(sizes) and (sizes == width).all():
        flat = column.flatten()
        x = np.floor(256 * flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width))
        good = np.isfinite(x).all(axis=1)
        return np.flatnonzero(good), x[good]
    found = _vectors(batch)
    rows = np.array([i for i, v in enumerate(found) if len(v)], np.int64)
    x = np.zeros((len(rows), width))
    for at, i in enumerate(rows):
        part = found[i][:width]
        x[at, :len(part)] = part
    return rows, x


def _scores(queries: np.ndarray, vectors: np.ndarray, bound: float) -> np.ndarray:
    if bound < EXACT:
        return (queries @ vectors.T).astype(np.int64)
    return queries.astype(object) @ vectors.T.astype(object)


def nearest_customers(customers: DataFrame, is_query: Column, k: int = 5, customer_id: str = "customer_id",
                      features: str = "features", query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, customer_id, score): for each query the k customers with the largest scores.

    Vectors are feature arrays; a part x counts as floor(256 x). The score is the inner product of
    whole numbers (shorter vectors count as padded with zeros). Every row but those with the query's
    own id is a candidate; ties go to the smaller id; fewer than k candidates give fewer rows. Null
    and empty vectors and those with null or non-finite parts take no part. Of several query rows
    with one id the least vector counts; repeated candidate rows stay repeated; null ids take no part.

    Queries are taken in blocks of `query_block`, so that a block and its counts have a fixed size. In
    each pass every candidate is scored, and histograms of BINS counts narrow each query's interval
    for the kth score until it is one value. The last pass keeps what is above it, and of what is
    equal to it each task keeps its k smallest ids.
    """
    rows = customers.select(F.col(f"`{customer_id}`").alias("customer_id"), F.col(f"`{features}`").alias("features"),
                            F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.filter("customer_id IS NOT NULL AND size(features) > 0 AND NOT exists(features, x -> x IS NULL OR isnan(x) "
                       "OR abs(x) = double('inf'))")
    asked = rows.filter("asks").groupBy("customer_id").agg(F.min("features").alias("features"))
    largest = rows.agg(F.max(F.sqrt(F.aggregate("features", F.lit(0.0), lambda a, x: a + F.pow(F.floor(256.0 * x).cast("double"), F.lit(2.0))))),
                       F.max(F.size("features"))).first()
    result, last = None, None
    while True:
        block = (asked if last is None else asked.filter(F.col("customer_id") > F.lit(last))).orderBy("customer_id").limit(query_block).collect()
        if not block:
            break
        last = block[-1]["customer_id"]
        found = materialize(_select(rows, block, k, *largest), "nearest")
        result = found if result is None else result.unionByName(found)
    if result is None:
        kind = rows.schema["customer_id"].dataType.simpleString()
        return customers.sparkSession.createDataFrame([], f"query_id {kind}, rank int, customer_id {kind}, score bigint")
    return result


def _select(rows: DataFrame, block: list, k: int, norm: float, width: int) -> DataFrame:
    """One block of queries: at most QUERY_BLOCK vectors and intervals travel with the tasks."""
    ids = [r["customer_id"] for r in block]
    place = {x: i for i, x in enumerate(ids)}
    queries = np.zeros((len(ids), width))
    for i, r in enumerate(block):
        queries[i, :len(r["features"])] = np.floor(256 * np.array(r["features"], np.float64))
    bound = norm * norm * width + 1
    reach = np.floor(np.linalg.norm(queries, axis=1) * norm * (1 + 1e-9)).astype(object) + 1
    low, high = np.array([-int(r) for r in reach]), np.array([int(r) + 1 for r in reach])    # low <= kth score < high
    above = np.zeros(len(ids), np.int64)                                # scores of high and more
    rows = rows.select("customer_id", "features")
    first = True
    while first or (high - low > 1).any():
        step = np.maximum(1, -(-(high - low) // BINS))

        def count(batches: Iterator[pa.RecordBatch], low=low, high=high, step=step) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(ids), BINS), np.int64)
            for b in batches:
                for part, own, _, found in _scored(b, queries, place, bound):
                    inside = (found >= low[part, None]) & (found < high[part, None])
                    inside[own] = False
                    at = (found - low[part, None]) // step[part, None]
                    flat = (np.arange(len(low))[part][:, None] * BINS + at)[inside].astype(np.int64)
                    total += np.bincount(flat, minlength=total.size).reshape(total.shape)
            q, at = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(at, pa.int32()), pa.array(total[q, at])], ["q", "bin", "n"])

        counts = rows.mapInArrow(count, "q int, bin int, n bigint").groupBy("q", "bin").agg(F.sum("n").alias("n")).toPandas()
        table = np.zeros((len(ids), BINS), np.int64)                     # at most QUERY_BLOCK x BINS counts
        table[counts["q"], counts["bin"]] = counts["n"]
        upward = above[:, None] + table[:, ::-1].cumsum(axis=1)[:, ::-1]    # scores in this bin or higher
        enough = upward >= k
        pick = np.where(enough.any(axis=1), BINS - 1 - enough[:, ::-1].argmax(axis=1), 0)
        found = enough.any(axis=1)
        new_low = np.where(found, low + pick * step, low)                # fewer than k in all: keep everything
        new_high = np.where(found, np.minimum(high, new_low + step), low + 1)
        higher = np.where(pick + 1 < BINS, np.take_along_axis(upward, np.minimum(pick + 1, BINS - 1)[:, None], 1)[:, 0], above)
        above = np.where(found, higher, above)
        low, high, first = new_low, new_high, False

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            names = b["customer_id"].to_pylist()
            sortable = np.array(names)
            for part, own, at, found in _scored(b, queries, place, bound):
                good = found >= low[part, None]
                good[own] = False
                for q in np.flatnonzero(good.any(axis=1)):
                    c = np.flatnonzero(good[q])
                    if len(c) > k:
                        c = c[np.lexsort((sortable[at[c]], -found[q, c]))[:k]]
                    held.setdefault(part.start + int(q), []).extend((-int(found[q, i]), names[at[i]]) for i in c)
            for q in held:
                held[q] = sorted(held[q])[:k]
        flat = [(q, -s, c) for q, best in held.items() for s, c in best]
        q, s, c = zip(*flat) if flat else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x in q], kinds), pa.array(c, kinds), pa.array(s, pa.int64())],
                                         ["query_id", "customer_id", "score"])

    kind = rows.schema["customer_id"].dataType.simpleString()
    kinds = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()
    best = rows.mapInArrow(keep, f"query_id {kind}, customer_id {kind}, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "customer_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "customer_id", "score")


def _scored(batch: pa.RecordBatch, queries: np.ndarray, place: dict, bound: float):
    """(slice of queries, pairs with one id, rows of the candidates, scores) in parts of fixed size."""
    rows, vectors = _fast_vectors(batch, queries.shape[1])
    names = batch["customer_id"].to_pylist()
    mine = [(place[names[i]], c) for c, i in enumerate(rows) if names[i] in place]
    step = max(1, (1 << 21) // max(1, len(rows)))
    for at in range(0, len(queries), step):
        part = slice(at, min(at + step, len(queries)))
        own = [(q - at, c) for q, c in mine if part.start <= q < part.stop]
        yield part, tuple(np.array(own, np.int64).reshape(-1, 2).T), rows, _scores(queries[part], vectors, bound)
