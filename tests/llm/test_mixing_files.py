import random
from collections import Counter

import pytest

import corpus_pipeline
from riskloom.llm import mixing
from tests.llm.test_mixing import table


@pytest.mark.parametrize("budget, epochs", [(1500, 1), (2500, 2), (7001, 3)])
def test_tokens_of_each_leaf_are_its_budget(spark, budget, epochs):
    rng = random.Random(budget)
    rows = [(i, rng.choice("ab"), rng.choice("xy"), rng.choice("mn"), " \n".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(40)))) for i in range(90)]
    rows += [(200 + i, a, b, "m", "lang " * 2000) for i, (a, b) in enumerate(["ax", "ay", "bx", "by"])] + [(300, "a", "x", "m", "eins zwei drei")] * 3 + [
        (None, "b", None, "m", "vier  fuenf"), (301, "b", "x", "n", None)]
    source = table(spark, rows)
    chosen = mixing.mix_transcripts(source, budget=budget, epochs=epochs)
    levels = list(mixing.LEVELS)
    wanted, held, texts = Counter(), Counter(), {}
    for r in chosen.collect():
        wanted[tuple(r[c] for c in levels)] += r.taken
    for k, *_, text in rows:
        texts.setdefault(k, set()).add(text)
    taken = mixing.take_chosen(source, chosen)
    assert taken.columns == source.columns and taken.count() == chosen.count()
    for r in taken.collect():
        held[tuple(r[c] or "" for c in levels)] += len((r.full_text or "").split())
        assert any(r.full_text == t or (t or "").startswith(r.full_text or "!") for t in texts[r.transcript_id])
    assert +held == +wanted and sum(held.values()) == budget


def test_the_stage_cuts_the_document_at_the_edge(spark):
    rows = [(i, " ".join(["wort"] * 5000), "en", f"src{i % 3}", 24_999) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    mixed = corpus_pipeline.mix_sources(spark, docs, "").collect()
    assert sum(len(r.text.split()) for r in mixed) == 45_000 * 3 // 4
    assert all(r.n_chars == len(r.text) for r in mixed)
