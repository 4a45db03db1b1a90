import hashlib
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from riskloom.llm import mixing
from tests.llm.helpers import with_clashes

SCHEMA = "transcript_id bigint, main_topics string, detected_language string, transcription_model string, full_text string"


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def share(nodes, budget):
    """{name: tokens} by filling: deal out, fix the full ones, deal the rest to the others."""
    given, left = {}, dict(nodes)
    while True:
        weight = sum(w for w, _ in left.values())
        full = [n for n, (w, c) in left.items() if Fraction(budget * w, weight) >= c]
        if not full:
            break
        for n in full:
            given[n] = left.pop(n)[1]
            budget -= given[n]
        if not left:
            return given
    weight = sum(w for w, _ in left.values())
    order = sorted(left, key=lambda n: (left[n][1] / left[n][0], n))
    for n in order:
        given[n] = budget * left[n][0] // weight
    for n in order[:budget - sum(given[n] for n in left)]:
        given[n] += 1
    return given


def slow(rows, weights, budget, epochs, seed):
    leaves = {}
    for key, a, b, c, text in rows:
        leaves.setdefault((a or "", b or "", c or ""), []).append((key, text))
    supply = {k: sum(n_words(t) for _, t in v) for k, v in leaves.items()}
    known = {tuple(w[:3]): w[3] for w in weights}

    def deal(prefix, budget):
        depth = len(prefix)
        if depth == 3:
            return {prefix: budget}
        nodes = {}
        for leaf in leaves:
            if leaf[:depth] == prefix:
                name = leaf[depth]
                w = known.get(leaf[:depth + 1] + (None,) * (2 - depth), 1)
                nodes[name] = (w, nodes.get(name, (0, 0))[1] + supply[leaf] * epochs)
        out = {}
        for name, given in share(nodes, budget).items():
            out |= deal(prefix + (name,), given)
        return out
    chosen = []
    for leaf, given in deal((), min(budget, sum(supply.values()) * epochs)).items():
        passes = given // supply[leaf] if supply[leaf] else 0
        for epoch in range(passes):
            chosen += [(str(k), *leaf, epoch, n_words(t), n_words(t)) for k, t in leaves[leaf]]
        rest = given - passes * supply[leaf]

        def drawn(x):
            name = "|".join([seed, str(passes)] + ([] if x[0] is None else [str(x[0])]))
            return hashlib.md5(name.encode()).hexdigest(), x[0] or 0
        start = 0
        for k, t in sorted(leaves[leaf], key=drawn):
            if start < rest:
                chosen.append((str(k), *leaf, passes, n_words(t), min(n_words(t), rest - start)))
            start += n_words(t)
    return sorted(chosen)


def table(spark, rows):
    return with_clashes(spark.createDataFrame(rows, SCHEMA).repartition(3))


def some_rows(seed, n=240):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.choice(["pagos"] * 6 + ["fraude", "otros", None]), rng.choice(["es", "es", "pt", None]), rng.choice(["m1", "m2", "m3"])
        rows.append((i, a, b, c, " ".join(["palabra"] * rng.choice([0, 1, 5, 30])) if i % 17 else None))
    return rows


@pytest.mark.parametrize("seed, budget, epochs", [(1, 500, 2), (2, 0, 2), (3, 10 ** 9, 3), (4, 2500, 1), (5, 3333, 4), (6, 1, 1)])
def test_equal_to_dealing_step_by_step(spark, seed, budget, epochs):
    rows = some_rows(seed)
    weights = [("fraude", None, None, 7), ("pagos", "es", None, 3), ("pagos", "es", "m2", 5), ("otros", "pt", "m1", 2), ("missing", None, None, 9)]
    given = spark.createDataFrame(weights, "main_topics string, detected_language string, transcription_model string, weight bigint")
    found = mixing.mix_transcripts(table(spark, rows), given, budget=budget, epochs=epochs, seed="s")
    got = sorted((str(r.transcript_id), r.main_topics, r.detected_language, r.transcription_model, r.epoch, r.tokens, r.taken) for r in found.collect())
    assert got == slow(rows, weights, budget, epochs, "s")
    assert sum(g[-1] for g in got) == min(budget, epochs * sum(n_words(r[4]) for r in rows))


def test_siblings_make_up_for_a_shortage_before_other_branches(spark):
    rows = [(1, "a", "x", "m", "w " * 10), (2, "a", "y", "m", "w " * 500), (3, "b", "x", "m", "w " * 500)]
    found = mixing.mix_transcripts(table(spark, rows), None, budget=400, epochs=1)
    assert {r.transcript_id: r.taken for r in found.collect()} == {1: 10, 2: 190, 3: 200}


def test_odd_tables(spark):
    assert mixing.mix_transcripts(table(spark, [])).count() == 0
    assert mixing.mix_transcripts(table(spark, [(1, "a", "b", "c", None), (2, "a", "b", "c", " ")])).count() == 0
    rows = [(1, "a", "b", "c", "uno dos")] * 3 + [(None, "a", "b", "c", "tres"), (2, "a", "b", "c", "w " * 100_000)]
    got = mixing.mix_transcripts(table(spark, rows), budget=2 * 100_007, epochs=2).collect()
    assert sorted((r.transcript_id or 0, r.epoch) for r in got) == sorted([(1, e) for e in (0, 1)] * 3 + [(i, e) for i in (0, 2) for e in (0, 1)])


def test_no_python_in_the_plan(spark, capsys):
    mixing.mix_transcripts(table(spark, some_rows(1))).explain("formatted")
    plan = capsys.readouterr().out
    assert "EvalPython" not in plan and "InPandas" not in plan and "InArrow" not in plan and "Cartesian" not in plan
