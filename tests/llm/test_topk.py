import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import topk
from tests.llm.helpers import with_clashes


def customers(spark, rows):
    return with_clashes(spark.createDataFrame(rows, "customer_id bigint, features array<float>").repartition(4))


def slow(rows, k):
    good = []
    for key, x in rows:
        if key is not None and x and all(v is not None and np.isfinite(np.float32(v)) for v in x):
            good.append((key, [int(np.floor(256 * float(np.float32(v)))) for v in x]))
    out, asked = [], {}
    for key, x in good:
        if key % 5 == 0:
            asked[key] = min(asked.get(key, x), x)
    for q, x in asked.items():
        found = sorted((-sum(a * b for a, b in zip(x, y)), c) for c, y in good if c != q)[:k]
        out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("block, k", [(2048, 5), (3, 5), (2048, 1)])
def test_equal_to_scoring_everything(spark, block, k):
    rng = np.random.default_rng(block)
    rows = [(int(i), [float(v) for v in rng.normal(size=6)]) for i in range(90)]
    rows += [(int(i), [1.0] * 6) for i in range(100, 160)]                    # ties in large number
    rows += [(200, None), (205, []), (210, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (215, [float("nan")] * 6), (220, [float("inf")] * 6), (None, [9.0] * 6),
             (225, [0.5, 0.25]), (230, [0.0] * 6), (235, [1e-3] * 6), (235, [1e-3] * 6), (240, [30000.0] * 6)]
    got = topk.nearest_customers(customers(spark, rows), F.col("customer_id") % 5 == 0, k=k, query_block=block).collect()
    assert sorted((r.query_id, r["rank"], r.customer_id, r.score) for r in got) == slow(rows, k)


def test_scores_beyond_the_exact_range_of_doubles(spark):
    rows = [(0, [2e6, 1.0]), (1, [2e6, 1.0]), (2, [2e6, 2.0]), (3, [-2e6, 5.0])]
    got = topk.nearest_customers(customers(spark, rows), F.col("customer_id") == 0, k=3).collect()
    assert [(r.customer_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(c, s) for _, _, c, s in slow([r for r in rows], 3)]


def test_few_rows_and_none(spark):
    find = lambda rows: topk.nearest_customers(customers(spark, rows), F.col("customer_id") % 5 == 0).collect()
    assert find([]) == [] and find([(5, [1.0])]) == [] and find([(1, [1.0]), (2, [1.0])]) == []
    assert [(r.query_id, r.customer_id, r.score) for r in find([(5, [1.0]), (6, [2.0])])] == [(5, 6, 131072)]
