import random
import re

import pytest

from riskloom.llm import decontamination
from tests.llm.helpers import empty, odd_rows, transcripts, with_clashes


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow(rows, items):
    windows = {}
    for key, text in items:
        found = words(text)
        for s in range(max(1, len(found) - 12) if found else 0):
            windows.setdefault(tuple(found[s:s + 13]), set()).add(str(key))
    out = []
    for key, text in rows:
        own, hit, held = words(text), set(), set()
        for window, keys in windows.items():
            for s in range(len(own) - len(window) + 1):
                if tuple(own[s:s + len(window)]) == window:
                    hit |= set(range(s, s + len(window)))
                    held |= keys
        out.append((str(key), len(own), len(hit), tuple(sorted(held)), bool(hit) and 20 * len(hit) >= len(own)))
    return sorted(out)


def complaints(spark, items):
    return with_clashes(spark.createDataFrame(items, "complaint_id bigint, description string"))


def judged(spark, rows, items):
    found = decontamination.contamination(transcripts(spark, rows), complaints(spark, items)).collect()
    return sorted((str(r.transcript_id), r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in found)


def test_equal_to_looking_everywhere(spark):
    rng = random.Random(4)
    vocabulary = ["el", "la", "Cargo", "no", "reconocido", "tarjeta", "banco", "ayer", "ÑU"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([1, 2, 3, 5, 12, 13, 14, 20, 30])]
    items += [(50, items[6][1]), (51, None), (52, " ... "), (53, "el el el el el el el el el el el el el el el")]
    rows = []
    for i in range(60):
        parts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 40))) for _ in range(3)]
        parts.insert(rng.randrange(3), (items[rng.randrange(len(items))][1] or "").upper().replace("ÑU", "Ñu"))
        rows.append((i, "--".join(parts)))
    rows += [(100, "el " * 300), (101, "tarjeta" + " relleno" * 500), *[(200 + i, rows[0][1]) for i in range(40)]]
    assert judged(spark, rows, items) == slow(rows, items)


def test_odd_rows(spark):
    rows = odd_rows()
    items = [(1, "uno dos tres cuatro cinco"), (2, " ".join(rows[5][1].split()[100:140])), (1, "x" * 200_000)]
    assert judged(spark, rows, items) == slow(rows, items)
    assert judged(spark, rows, []) == slow(rows, [])
    assert decontamination.contamination(empty(spark), complaints(spark, items)).count() == 0


@pytest.mark.parametrize("n, stays", [(260, False), (261, True)])
def test_the_share_of_hit_words_decides(spark, n, stays):
    item = "uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece"
    table = transcripts(spark, [(1, item + " y" * (n - 13)), (None, item), (2, "nada que ver")])
    kept = decontamination.without_contaminated(table, complaints(spark, [(7, item)]))
    assert kept.columns == table.columns
    assert sorted(r.transcript_id for r in kept.collect()) == ([1, 2] if stays else [2])


def test_no_python_in_the_plan(spark, capsys):
    found = decontamination.contamination(transcripts(spark, [(1, "uno")]), complaints(spark, [(1, "uno")]))
    found.explain("formatted")
    plan = capsys.readouterr().out
    assert "EvalPython" not in plan and "InPandas" not in plan and "InArrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
