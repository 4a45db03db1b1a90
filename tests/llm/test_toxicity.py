import random
import zlib

import pytest

from riskloom.llm import toxicity
from tests.llm.helpers import empty, odd_rows, transcripts, with_clashes


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("errors", [0, 1, 2])
def test_automaton_and_trie_find_what_edit_distance_finds(errors):
    rng = random.Random(errors)
    terms = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(60)})
    trie = toxicity.Trie(terms)
    for _ in range(300):
        word = "".join(rng.choice("abcd") for _ in range(rng.randrange(0, 8)))
        expected = sorted((i, d) for i, t in enumerate(terms) if (d := edit_distance(word, t)) <= errors)
        assert sorted(toxicity.intersect(trie, word, errors)) == expected, word


def test_one_error_is_found_and_two_are_not():
    lexicon = toxicity.Lexicon({"miserable": 4.0, "payaso": 3.0, "imbec*": 5.0})
    assert lexicon.match("miserable") == ("miserable", 4.0)
    assert lexicon.match("imbecilidad") == ("imbec*", 5.0)
    for word in ("miserble", "misserable", "mizerable", "iserable", "miserabl"):
        assert lexicon.match(word) == ("miserable~", 2.0), word
    for word in ("mizerble", "payas" + "itos", "cuenta", "im"):
        assert lexicon.match(word) is None, word


def test_every_single_error_passes_the_check_of_the_halves():
    rng = random.Random(6)
    terms = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(5, 10))) for _ in range(30)]
    lexicon = toxicity.Lexicon(dict.fromkeys(terms, 1.0))
    for term in terms:
        for i in range(len(term)):
            for word in {term[:i] + term[i + 1:], term[:i] + "x" + term[i:], term[:i] + "x" + term[i + 1:]} - {term}:
                assert lexicon.misspelt(word) is not None, (term, word)


@pytest.mark.parametrize("text, quoted", [
    ("usted es un payaso y ya", False), ("el cliente dijo que es un payaso", True), ('me gritó "payaso" al salir', True),
    ("«es un payaso» fue la frase", True), ('"bueno" pero un payaso', False), ("payaso", False)])
def test_quotation_and_abuse(text, quoted):
    at = text.index("payaso")
    assert toxicity.is_quoted(text, at, at + 6) is quoted


INSULTS = ["payaso", "miserable", "imbecil", "basura"]


def labelled(n=900, seed=2):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["ca", "re", "mi", "to", "lu", "se"]) for _ in range(3)) for _ in range(200)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        toxic = int(i % 5 == 0)
        if toxic:
            word = rng.choice(INSULTS) if i % 2 else "estup" + rng.choice(["ido", "ida", "idez", "idos", "idamente"])
            text.insert(rng.randrange(len(text)), word.upper() if i % 3 else word)
        rows.append((i, " ".join(text)))
        labels.append((i, toxic))
    return rows, labels


def test_held_out_transcripts_are_told_apart(spark):
    rows, labels = labelled()
    rows += [(5000, "cadena de mieserable cosa"), (5001, "hola buenos dias"), *[(6000 + i, t) for i, (_, t) in enumerate(odd_rows())]]
    given = with_clashes(spark.createDataFrame([*labels, (9999, 1), (1, None), (None, 1)], "transcript_id bigint, toxic int"))
    found = {r.transcript_id: r for r in toxicity.score_transcripts(transcripts(spark, rows), given).collect()}
    assert len(found) == len(rows)
    truth = dict(labels)
    held = [k for k in truth if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in found.items())
    assert sum(found[k].predicted == truth[k] for k in held) >= 0.99 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found.values())
    assert found[5001].predicted == 0 and found[5000].predicted == 1 and found[6000].score == found[6001].score


def test_labels_of_held_out_rows_change_nothing(spark):
    rows, labels = labelled(400)
    flipped = [(k, 1 - t if zlib.crc32(str(k).encode()) % 4 == 2 else t) for k, t in labels]
    scores = [sorted((r.transcript_id, r.score) for r in toxicity.score_transcripts(
        transcripts(spark, rows), spark.createDataFrame(given, "transcript_id bigint, toxic int")).collect()) for given in (labels, flipped)]
    assert scores[0] == scores[1]


def test_without_labels_or_texts(spark):
    none = spark.createDataFrame([], "transcript_id bigint, toxic int")
    rows = odd_rows()
    got = toxicity.score_transcripts(transcripts(spark, rows), none).collect()
    assert len(got) == len(rows) and len({r.score for r in got}) == 1 and got[0].predicted == 0
    assert toxicity.score_transcripts(empty(spark), none).count() == 0


def test_only_toxic_ones_go(spark):
    rows, labels = labelled(500)
    table = transcripts(spark, [*rows, (None, "payaso"), (0, "otra vez cero")])
    kept = toxicity.without_toxic(table, spark.createDataFrame(labels, "transcript_id bigint, toxic int"))
    assert kept.columns == table.columns
    assert sorted(r.transcript_id if r.transcript_id is not None else -1 for r in kept.collect()) == [-1] + [k for k, t in labels if not t]
