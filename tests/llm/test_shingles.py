import random
import re

import numpy as np
import pytest

import corpus_pipeline
from riskloom.llm import shingles
from tests.llm.helpers import empty, odd_rows, transcripts


def slow_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i:i + 5]) for i in range(len(words) - 4)} or {b" ".join(words)}


def slow_groups(rows):
    sets, own = [slow_set(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j]):
                own = [own[j] if o == own[i] else o for o in own]
    return {k: min(rows[j][0] for j in range(len(rows)) if own[j] == own[i]) for i, (k, _) in enumerate(rows)}


def planted(seed=4):
    """Texts with copies of which some words differ, so that similarities lie on both sides of 0.8."""
    rng, rows = random.Random(seed), []
    for group in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(30, 200))]
        for copy in range(4):
            own = list(words)
            for _ in range(copy * rng.randrange(1, 4)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(5000)}"
            rows.append((len(rows), " ".join(own)))
    return rows + [(900, None), (901, ""), (902, "uno dos"), (903, "Uno  dos")]


def test_shared_shingles_are_counted_by_products(monkeypatch):
    monkeypatch.setattr(shingles, "COLUMNS", 7)
    rng = np.random.default_rng(1)
    for _ in range(100):
        base = rng.integers(0, 1 << 40, 60, np.uint64)
        sets = [np.unique(np.concatenate([base[:rng.integers(1, 60)], rng.integers(0, 1 << 40, rng.integers(0, 15), np.uint64)])) for _ in range(rng.integers(1, 12))]
        near = shingles.similar_pairs(sets)
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                assert near[i, j] == near[j, i] == (both * 5 >= 4 * (len(sets[i]) + len(sets[j]) - both))


def test_members_of_one_root_are_not_compared():
    sets = [np.arange(n, n + 100, dtype=np.uint64) for n in (0, 1, 2, 500, 501)]
    assert shingles.spanning([1, 2, 3, 4, 5], [7, 7, 7, 7, 7], sets) == []
    assert len(shingles.spanning([1, 2, 3, 4, 5], [1, 2, 3, 4, 5], sets)) == 3
    assert len(shingles.spanning([1, 2, 3, 4, 5], [1, 1, 3, 4, 4], sets)) == 1


@pytest.mark.parametrize("block", [512, 3])
def test_groups_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(shingles, "BLOCK", block)
    rows = planted()
    assert {r.transcript_id: r.component_id for r in shingles.near_copies(transcripts(spark, rows)).collect()} == slow_groups(rows)


def test_members_and_units_are_not_sent_to_the_driver(spark, monkeypatch):
    plans, write = {}, shingles.materialize

    def kept(df, label):
        plans.setdefault(label, []).append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(shingles, "materialize", kept)
    shingles.near_copies(transcripts(spark, planted()[:40])).collect()
    for label, keys in (("shingle-units", r"\[t#\d+, k#\d+L?\]"), ("shingle-links", r"\[key#\d+L?\]")):
        assert len(plans[label]) == 2                       # candidates by fingerprint, then by bands
        for plan in plans[label]:
            assert re.search(rf"SortMergeJoin(\(skew=true\))? {keys}, {keys}, Inner", plan)
            assert not re.search(rf"BroadcastHashJoin {keys}, {keys}, Inner", plan)


def test_the_stage_drops_near_copies_above_the_limit(spark):
    """The first and last word of a document replaced, and one word added: similarity 0.8 to 0.99."""
    rng = random.Random(1)
    words = [[f"w{rng.randrange(9000)}" for _ in range(n)] for n in (40, 60, 90, 140)]
    rows = [(i, " ".join(w)) for i, w in enumerate(words)] + [(10 + i, " ".join(["uno", *w[1:-1], "dos"])) for i, w in enumerate(words)] \
        + [(20 + i, " ".join([*w, "fin"])) for i, w in enumerate(words)]
    docs = transcripts(spark, rows).withColumnsRenamed({"transcript_id": "doc_id", "full_text": "text"})
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3] and kept.columns == docs.columns


def test_odd_rows(spark):
    found = shingles.near_copies(transcripts(spark, odd_rows())).collect()
    got = {r.transcript_id: r.component_id for r in found}
    assert len(found) == len(odd_rows()) and got[2] == got[3] == 1 and got[7] == 6 and got[5] == 5
    assert shingles.keep_one_per_group(empty(spark)).count() == 0
    assert (shingles.shingle_set("a b c d e " * 300_000) == shingles.shingle_set("a b c d e " * 2)).all() and shingles.shingle_set("a").dtype == np.uint64
