import random

import pytest

from riskloom.llm import toxicity

LEXICON = {"idiot": 3.0, "scum": 3.0, "pathet*": 2.0, "stup*": 2.0}


@pytest.mark.parametrize("text, entry", [
    ("ein idi0t hier", "idiot~"), ("ein id-iot hier", "idiot~"), ("so pathet1c", "pathet*"), ("so path3tic", "pathet*~"), ("so pahtetic", None), ("so pathatic", "pathet*~"),
    ("a 1diot", "idiot~"), ("very phthitically", None), ("wholly unrelated-words here", None), ("an idiot-word", "idiot")])
def test_errors_in_words_and_beginnings(text, entry):
    found = [h[2] for h in toxicity.hits(text, toxicity.Lexicon(LEXICON))]
    assert found == ([entry] if entry else [])


def test_short_terms_need_another_match_near():
    lexicon = toxicity.Lexicon(LEXICON)
    assert toxicity.hits("you scvm of the earth", lexicon) == []
    assert [h[2] for h in toxicity.hits("you scvm and idiot", lexicon)] == ["scum~", "idiot"]
    assert [h[2] for h in toxicity.hits("you sc-um and idiot", lexicon)] == ["scum~", "idiot"]
    assert [h[2] for h in toxicity.hits("idiot " + "word " * 30 + "scvm", lexicon)] == ["idiot"]


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row


def test_beginnings_equal_brute_force():
    rng = random.Random(5)
    stems = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(4, 7))) for _ in range(12)})
    lexicon = toxicity.Lexicon({s + "*": 1.0 for s in stems})
    for _ in range(600):
        word = "".join(rng.choice("abc") for _ in range(rng.randrange(3, 10)))
        best = {s: min(slow_distance(s, word)) for s in stems}
        wanted = None if any(word.startswith(s) and len(s) < len(word) for s in stems) else min((s + "*" for s, d in best.items() if d == 1), default=None)
        assert lexicon.misspelt(word) == wanted, word


def test_every_significant_word_is_learned_once(spark):
    """Every toxic word has five tied beginnings, of which pruning leaves one; no bound takes any word away."""
    rng = random.Random(2)
    words = ["".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(5)) for _ in range(300)]
    clean = ["".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(4)) for _ in range(3000)]
    rows = [(" ".join([*rng.sample(clean, 5), *(words if i % 2 else [])]), i % 2) for i in range(200)]
    found = toxicity.learn_lexicon(spark.createDataFrame(rows, "full_text string, toxic int"), {0: 1.0, 1: 1.0})
    assert all(any(w == t or (t[-1] == "*" and w.startswith(t[:-1])) for t in found) for w in words)
    assert len(found) == len(words)


def test_borders_of_pieces_make_no_difference(monkeypatch):
    """Quotations, joined runs and weak matches that reach over a border are judged as in one piece."""
    from riskloom.llm import texts
    rng = random.Random(8)
    lexicon = toxicity.Lexicon({"payaso": 3.0, "scum": 2.0, "misera*": 2.5, "scum~": 1.5, "payaso~": 1.0})
    words = ["payaso", "payazo", "scun", "scum", "miserable", "miz3rable", "idi-ota", "pa-yaso", "dijo", "\"hola", "fin\"", *[f"w{i}" for i in range(12)], "uno", "dos"]
    for _ in range(200):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 120)))
        whole = toxicity.hits(text, lexicon), toxicity.evidence(text, lexicon)
        with monkeypatch.context() as m:
            m.setattr(texts.pieces, "__defaults__", (rng.choice([5, 17, 60]),))
            assert (toxicity.hits(text, lexicon), toxicity.evidence(text, lexicon)) == whole


def test_halves_never_hide_a_misspelling():
    rng = random.Random(4)
    terms = {"".join(rng.choice("abc") for _ in range(rng.randrange(3, 9))) + rng.choice(["", "*"]): 1.0 for _ in range(25)}
    lexicon = toxicity.Lexicon(terms)
    for _ in range(4000):
        word = "".join(rng.choice("abcd") for _ in range(rng.randrange(2, 11)))
        near = bool(toxicity.intersect(lexicon.trie, word, 1)) or bool(toxicity.intersect(lexicon.stem_trie, word, 1, beginning=True))
        assert lexicon.may_be_misspelt(word) or not near
