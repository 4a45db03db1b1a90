import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from riskloom.llm import simhash
from riskloom.llm.graph import components
from tests.llm.helpers import empty, odd_rows, transcripts


def slow_fingerprint(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_roots(values, radius=4):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("text", [None, "", "  \n", "one", "A b C", "a b c d", "a b c d a b c d a b c d", "É Ü x y z é", "a\x1cb c\xa0d e f"])
def test_fingerprint_of_short_texts(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_fingerprint_of_a_text_cut_into_pieces(monkeypatch):
    from riskloom.llm import texts
    rng = random.Random(3)
    text = " ".join(rng.choice(["ab", "cde", "f", "ghij"]) for _ in range(4000))
    monkeypatch.setattr(texts.pieces, "__defaults__", (97,))
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_every_difference_within_the_radius_is_avoided_by_some_mask():
    masks = simhash.covering_masks(4)
    rng = random.Random(5)
    assert len(masks) == 31 and min(bin(m).count("1") for m in masks) >= 30
    for _ in range(3000):
        difference = sum(1 << i for i in rng.sample(range(64), 4))
        assert any(m & difference == 0 for m in masks)


def test_fingerprints_under_all_masks_are_not_sent_to_the_driver(spark):
    prints = spark.range(5000).select(F.xxhash64("id").alias("fingerprint"))
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"       # the table is far below it, with its 31 masks it need not be
    found = simhash.links(prints)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("block", [1024, 7])
def test_links_have_the_components_of_all_pairs(spark, block):
    rng = random.Random(block)
    values = set()
    for _ in range(12):
        value = rng.getrandbits(64)
        for _ in range(12):                     # chains and dense clusters, also across the sign bit
            values.add(value)
            value ^= 1 << rng.randrange(64) | 1 << rng.choice([63, rng.randrange(64)])
    values = sorted(values)
    signed = [simhash._signed(v) for v in values]
    prints = spark.createDataFrame([(i, v) for i, v in enumerate(signed)], "transcript_id bigint, fingerprint bigint")
    found = {r.node: r.root for r in components(simhash.links(prints, 4, block)).collect()}
    groups = {}
    for place, root in enumerate(slow_roots(values)):
        groups.setdefault(root, set()).add(signed[place])
    for members in groups.values():
        assert {found.get(m, m) for m in members} == {min(members)}


def test_near_duplicates_of_odd_rows(spark):
    rows = odd_rows()
    found = simhash.near_duplicate_transcripts(transcripts(spark, rows)).collect()
    values = [slow_fingerprint(t) for _, t in rows]
    roots = slow_roots(values)
    least = {}
    for (key, _), root in zip(rows, roots):
        if key is not None:
            least[root] = min(key, least.get(root, key))
    expected = sorted([(k if k is not None else -1, v, least.get(r, -1)) for (k, _), v, r in zip(rows, values, roots)])
    got = sorted((r.transcript_id if r.transcript_id is not None else -1, r.fingerprint & (1 << 64) - 1,
                  -1 if r.component_id is None else r.component_id) for r in found)
    assert got == expected
    assert simhash.near_duplicate_transcripts(empty(spark)).count() == 0


def test_one_of_each_group_stays_with_all_columns(spark):
    table = transcripts(spark, odd_rows())
    kept = simhash.keep_one_per_group(table)
    assert kept.columns == table.columns
    assert sorted(r.transcript_id or -1 for r in kept.collect()) == [-1, 1, 4, 5, 6, 8, 9, 10]


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)] + [(1000, 1000)]
    found = {r.node: r.root for r in components(spark.createDataFrame(chain + star, "a bigint, b bigint")).collect()}
    assert found == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1300), 1000)}


def test_spanning_links_of_one_block():
    values = np.array([0, 1, 3, 7, 15, 31, 1 << 63, (1 << 63) | 1, (1 << 40) - 1], np.uint64)
    assert len(simhash._spanning(values, 1)) == 7
