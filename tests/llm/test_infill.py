import hashlib
import random
import re

import numpy as np
import pytest

from riskloom.llm import infill
from tests.llm.helpers import empty, odd_rows, transcripts


def slow(text, key, rate=100, spm_rate=50, seed="7"):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    form = "spm" if h4 % 100 < spm_rate else "psm"
    return n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def random_text(rng):
    letters = ["a", "ñ", "\n", "\n", " ", "€", "\U0001F600", "<", "P>", "\r", "\x0b", "\x8a", "ਊ", "\0"]
    return "".join(rng.choice(letters) for _ in range(rng.randrange(0, 60)))


@pytest.mark.parametrize("seed", range(5))
def test_marks_count_and_find_bytes(seed):
    rng = np.random.default_rng(seed)
    data = rng.choice(np.array([0x0A, 0x0B, 0x09, 0x00, 0x8A, 0x4A, 0xFF], np.uint8), 1000).tobytes()
    marks = infill.line_ends(infill.as_words(data))
    places = [i for i, b in enumerate(data) if b == 0x0A]
    assert marks.select(np.arange(len(places))).tolist() == places
    at = np.arange(len(data) + 1)
    assert marks.rank(at).tolist() == [data[:i].count(b"\n") for i in at]


def test_code_points_are_counted():
    rng = random.Random(3)
    text = "".join(rng.choice(["a", "ñ", "€", "\U0001F600"]) for _ in range(500))
    raw = text.encode()
    assert infill.code_points(infill.as_words(raw)).rank(np.array([0, len(raw)])).tolist() == [0, len(text)]


@pytest.mark.parametrize("held", [1 << 23, 40])
def test_transcripts_against_regular_expressions(spark, monkeypatch, held):
    monkeypatch.setattr(infill, "HELD", held)
    rng = random.Random(held)
    rows = odd_rows() + [(100 + i, random_text(rng)) for i in range(400)] + [(600, "\n"), (601, "\n\n\n"), (602, "uno\n" * 20_000), (603, "hola <M>")]
    for options in ({}, {"rate": 40, "spm_rate": 0, "seed": "x"}):
        made = infill.restore_transcripts(infill.fill_in_middle(transcripts(spark, rows), **options)).collect()
        got = sorted(((r.transcript_id, r.n_lines, r.form, r.prefix_chars, r.middle_chars, r.output, r.full_text) for r in made), key=repr)
        assert got == sorted(((k, *slow(t, k, **options), t or "") for k, t in rows), key=repr)
        assert {r.form for r in made} == ({"plain", "psm", "spm"} if not options else {"plain", "psm"})


def test_other_ends_of_lines(spark):
    made = infill.fill_in_middle(transcripts(spark, [(i, "uno. dos. tres") for i in range(20)]), line_end=".").collect()
    assert {r.n_lines for r in made} == {3}
    with pytest.raises(ValueError):
        infill.fill_in_middle(empty(spark), line_end="ab")


def test_restoring_keeps_other_columns_and_nulls(spark):
    df = spark.createDataFrame([(1, None, "psm", "x"), (2, "<P>a<S>c<M>b", "psm", "y"), (3, "<S>c<P>a<M>b", "spm", "z"), (4, "t", "plain", None)],
                               "transcript_id bigint, output string, form string, full_text string")
    assert sorted((r.transcript_id, r.full_text) for r in infill.restore_transcripts(df).collect()) == [(1, None), (2, "abc"), (3, "abc"), (4, "t")]


def test_empty_table(spark):
    assert infill.restore_transcripts(infill.fill_in_middle(empty(spark))).count() == 0
