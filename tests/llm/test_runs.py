import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from riskloom.llm import queries, runs
from tests.llm.helpers import empty, odd_rows, transcripts

SMALL = "/root/testdata/sf0.001"


def slow_runs(words, shortest=6, exponent=4):
    """All maximal stretches by every period, of which those with a smaller period are left out."""
    found = {}
    codes = {w: i for i, w in enumerate(dict.fromkeys(words))}
    x = np.array([codes[w] for w in words], np.int64)
    for q in range(1, len(x) // exponent + 1):
        same = np.concatenate([[False], x[q:] == x[:-q], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(edges[::2].tolist(), (edges[1::2] + q).tolist()):
            if e - s >= max(shortest, exponent * q):
                found.setdefault((s, e), q)
    return sorted((s, e - s, q) for (s, e), q in found.items() if q == min(
        p for p in range(1, q + 1) if (x[s + p:e] == x[s:e - p]).all()))


def slow_collapse(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def fast_runs(words):
    (_, found), = runs.runs_of_texts([" ".join(words)])
    return found


def repeated(rng, letters, depth):
    """Words with runs inside runs."""
    if depth == 0:
        return [rng.choice(letters) for _ in range(rng.randrange(1, 4))]
    parts = []
    for _ in range(rng.randrange(1, 4)):
        parts += repeated(rng, letters, depth - 1) * rng.choice([1, 1, 4, 5, 7])
    return parts


@pytest.mark.parametrize("seed", range(60))
def test_runs_of_random_sequences(seed):
    rng = random.Random(seed)
    letters = [f"w{i}" for i in range(rng.choice([1, 2, 3, 8]))]
    if seed % 2:
        words = repeated(rng, letters, rng.choice([2, 3]))[:6000]
    else:
        words = [rng.choice(letters) for _ in range(rng.randrange(0, 400))]
    assert fast_runs(words) == slow_runs(words)


@pytest.mark.parametrize("period", [1, 2, 5, 7, 8, 9, 15, 16, 17, 31, 33, 100, 127, 128, 500])
@pytest.mark.parametrize("times", [3.9, 4, 4.5, 9])
def test_one_run_among_other_words(period, times):
    rng = random.Random(period)
    unit = [f"u{i}" for i in range(period)]
    length = int(period * times)
    words = [f"a{i}" for i in range(rng.randrange(30))] + (unit * 10)[:length] + [f"b{i}" for i in range(rng.randrange(30))]
    found = fast_runs(words)
    assert found == slow_runs(words)
    assert bool(found) == (length >= max(6, 4 * period))


@pytest.mark.parametrize("seed", range(6))
def test_runs_whose_unit_is_highly_periodic(seed):
    rng = random.Random(seed)
    unit = ["a"] * rng.randrange(10, 60) + ["b"] + ["a", "b"] * rng.randrange(5, 30)
    words = ["x"] + unit * 4 + unit[:rng.randrange(len(unit))] + ["y"] + ["a"] * 200
    assert fast_runs(words) == slow_runs(words)


def test_a_member_of_the_set_depends_on_its_context_only():
    rng = np.random.default_rng(2)
    words = np.tile(rng.integers(0, 3, 500), 2)
    scale, h = 1, runs._scattered(words.astype(np.uint64))
    while scale < 16:
        h, scale = runs._doubled(h, scale), 2 * scale
    members = set(runs.synchronising_set(h, scale, np.zeros(len(words), bool)).tolist())
    assert {m for m in members if m < 500 - 2 * scale} == {m - 500 for m in members if 500 <= m < 1000 - 2 * scale}
    assert all(members & set(range(i, i + scale)) for i in range(len(words) - 3 * scale))


def test_texts_put_together_do_not_meet(monkeypatch):
    texts = ["a b", "a b", None, "", "a b a b a b a b", "b a b a b a b a", "a a a a a a"]
    expected = [(re.findall(r"[^\x20\x09-\x0D]+", t or ""), slow_runs((t or "").split())) for t in texts]
    assert list(runs.runs_of_texts(texts)) == expected
    monkeypatch.setattr(runs, "TOGETHER", 3)
    assert list(runs.runs_of_texts(texts)) == expected


def test_table_of_odd_transcripts(spark):
    rows = odd_rows() + [(20, "sí no " * 5000), (21, "ha\t" * 5), (22, "ha " * 6), (23, ("uno dos tres cuatro cinco seis siete ocho nueve " * 4).strip())]
    got = runs.transcript_runs(transcripts(spark, rows)).collect()
    expected = []
    for key, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        found = slow_runs(words) if len(set(words)) < 30 else []
        expected.append((key, len(words), found, " ".join(slow_collapse(words, found))))
    assert sorted(((r.transcript_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed_text) for r in got), key=repr) == sorted(expected, key=repr)


def test_empty_table(spark):
    assert runs.transcript_runs(empty(spark)).count() == 0


def test_the_query_against_every_period(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op11_periodic_runs"](spark, SMALL).collect()}
    docs = spark.read.parquet(SMALL + "/documents.parquet").collect()
    assert len(got) == len(docs)
    n_runs = 0
    for d in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", d.text or "")
        h = zlib.crc32(str(d.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        found = slow_runs(words)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        row = got[d.doc_id]
        assert (row.n_runs, row.start, row.length, row.period) == (len(found), *best)
        assert row.exponent_milli == (None if best[0] is None else 1000 * best[1] // best[2])
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in found).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(" ".join(slow_collapse(words, found)).encode()).hexdigest()
        n_runs += len(found)
    assert n_runs > 10
